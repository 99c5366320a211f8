"""Text normalisation, tokens and the facts that the guard compares."""

from __future__ import annotations

import unicodedata
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words of each polarity family.
POLARITY = {
    "NEG": "not no never none nothing neither nor nobody nowhere cannot",
    "EXCEPT": "except excepting exception exceptions exclude excludes excluding excluded unless without omit omits omitting omitted",
    "ALWAYS": "always ever",
    "BEFORE": "before prior",
    "AFTER": "after",
    "ABOVE": "above over exceed exceeds exceeded exceeding greater higher more larger",
    "BELOW": "below under less fewer lower smaller beneath",
    "PERMIT": "allow allows allowed allowing permit permits permitted permitting authorize authorizes authorized grant grants granted enable enables enabled enabling",
    "FORBID": "deny denies denied denying forbid forbids forbidden prohibit prohibits prohibited disallow disallows disallowed refuse refuses refused reject rejects rejected "
    "disable disables disabled prevent prevents prevented avoid avoids avoided refrain refrains revoke revokes revoked",
    "REQUIRE": "require requires required requiring requirement requirements mandatory need needs needed necessary",
    "OPTIONAL": "optional optionally",
}
#: Words that are values of their own.
VALUE_WORDS = (
    "production prod staging stage preprod pre-production development dev sandbox canary qa test testing local live "
    "hourly daily nightly weekly biweekly fortnightly monthly quarterly annually yearly true false null nil"
)
#: Characters stripped from both ends of a token, and from its end only; sentence ends.
LEADING, TRAILING, SENTENCE_ENDS = "\"'`([{<«“‘", "\"'`)]}>»”’.,;:!?", ".!?:;"


#: Characters that no composition changes or takes in: a text of these is NFC as it is.
INERT = r"\x{0}-\x{2FF}\x{400}-\x{482}\x{48A}-\x{52F}\x{2002}-\x{20CF}\x{2100}-\x{2125}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}\x{1F300}-\x{1FAFF}"


@F.arrow_udf(StringType())
def _composed(text: pa.Array) -> pa.Array:
    """NFC of the texts, of a few hundred at once as Python strings; a batch in NFC is given back as it is."""
    parts, same = [], True
    for at in range(0, len(text), 256):
        part = text.slice(at, 256)
        own = part.to_pylist()
        if all(x is None or unicodedata.is_normalized("NFC", x) for x in own):
            parts.append(part)
        else:
            same = False
            parts.append(pa.array([x and unicodedata.normalize("NFC", x) for x in own], text.type))
    return text if same else pa.concat_arrays(parts)


def nfc(text: Column) -> Column:
    """Unicode NFC, for which Spark has no function: texts with characters beyond INERT, and only those, go to Python."""
    other = text.rlike(r"[^\x{0}-\x{2FF}]") & text.rlike(f"[^{INERT}]")  # the first is quick
    return F.when(other, _composed(F.when(other, text))).otherwise(text)


def tidied(text: Column) -> Column:
    """LF line ends, no blanks at line ends, at most one empty line in a row, none at either end. Case and indentation stay."""
    # `contains` is quicker than a search by pattern that finds nothing.
    x = F.when(text.contains("\r"), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)
    # A run of blanks is tried from its first only, else long ones would take the square of their length.
    x = F.when(x.rlike(r"[ \t\x0B\f](?:\n|\z)"), F.regexp_replace(x, r"(?<![ \t\x0B\f])[ \t\x0B\f]++(?=\n|\z)", "")).otherwise(x)
    x = F.when(x.contains("\n\n\n"), F.regexp_replace(x, r"\n{3,}", "\n\n")).otherwise(x)
    return F.trim(x, F.lit("\n"))


def normalized(text: Column) -> Column:
    """NFC, and tidied."""
    return tidied(nfc(text))


def content_hash(text: Column) -> Column:
    return F.sha2(normalized(text), 256)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up, 1 at least."""
    return F.greatest(F.lit(1), F.floor((F.char_length(text) + 3) / 4)).cast("int")


def stripped(token: Column) -> Column:
    """A token without quotes and brackets around it and sentence marks after it; a leading dash stays."""
    return F.rtrim(F.ltrim(token, F.lit(LEADING)), F.lit(TRAILING))


TELLING = sorted({*VALUE_WORDS.split(), *(x for words in POLARITY.values() for x in words.split())})


def may_tell(token: Column) -> Column:
    """Whether a stripped token may have a polarity family or be an entity: a quick test that leaves out most words."""
    return F.lower(token).isin(TELLING) | token.rlike(r"[0-9_/\\@=.:\p{Lu}-]|[nN]['’][tT]$")


#: Signs of a plain word: letters without capitals, and signs that neither `may_tell` nor `stripped` looks at.
_QUIET = r"\p{Ll}\p{Lo}\p{M}#$%&*+|~^"
_TELLING = "|".join(f"{a}(?:{'|'.join(w[1:] for w in words)})" for a, words in groupby(TELLING, key=lambda w: w[0]))
#: The rest of a plain word, and what it may end with; a word of TELLING is none. A sentence's first word may have a capital.
_REST, _NO_TELLING = rf"[{_QUIET}!?,;]*+[.,:;!?]*+", rf"(?!(?i:{_TELLING})(?![{_QUIET}]))"
_STARTS = r"(?:(?<![^\n])|(?<=[\p{L}0-9][.!?:;] ))"
PLAIN = rf"{_NO_TELLING}[{_QUIET}]{_REST}"
PLAIN_OR_FIRST = rf"{_NO_TELLING}(?:[{_QUIET}]|{_STARTS}\p{{Lu}}){_REST}"


def thinned(text: Column) -> Column:
    """text without words that tell nothing, where a plain word of their line follows: what may tell stays, and so does the word before it.

    At most 32 words go at once, as Java keeps a place in its stack for each.
    """
    return F.regexp_replace(text, rf"(?<!\S)(?:{PLAIN_OR_FIRST}[ \t]++){{1,32}}(?={PLAIN}(?!\S))", "")


def polarity_family(token: Column) -> Column:
    """The family of a stripped token, null if it has none; contractions of not count as NEG."""
    low = F.lower(token)
    out = F.when(low.endswith("n't") | low.endswith("n’t"), F.lit("NEG"))
    for family, words in POLARITY.items():
        out = out.when(low.isin(words.split()), F.lit(family))
    return out


def entity(token: Column, sentence_start: Column) -> Column:
    """class:token of a stripped token that carries a value (flag, num, id, val, name; the first that fits), else null."""
    value = F.when(sentence_start, F.lower(token)).otherwise(token)
    inner = token.rlike(r"^.\P{Lu}*\p{Lu}") & F.substring(token, 2, 1 << 30).rlike(r"\p{Lu}")
    return (
        F.when(token.rlike(r"^--?[A-Za-z][A-Za-z0-9._-]*$"), F.concat(F.lit("flag:"), token))
        .when(token.rlike("[0-9]"), F.concat(F.lit("num:"), token))
        .when(token.rlike(r"[A-Za-z0-9][_/\\@=][A-Za-z0-9]|[A-Za-z0-9]\.[A-Za-z0-9]|::"), F.concat(F.lit("id:"), token))
        .when(F.lower(token).isin(VALUE_WORDS.split()), F.concat(F.lit("val:"), value))
        .when(inner | (token.rlike(r"\p{Lu}") & ~sentence_start), F.concat(F.lit("name:"), token))
    )
