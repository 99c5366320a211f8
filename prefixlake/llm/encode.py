"""Encoding whole texts with a public tokenizer, each distinct piece of text once.

A text's ids are those of its pieces in order if it is cut only where the tokenizer's own rules
split as well: at blanks, and between ASCII letters, digits and other characters. Pieces are found
on the bytes of a whole batch, told apart by Arrow, and only those that a worker doesn't remember
go to the tokenizer: words of Latin letters, nearly all of them, straight to its model, others
through all its steps. Texts for which a cut might matter (special tokens, blanks outside ASCII)
go to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Pieces that a worker remembers in either of two generations, and characters of the longest of them: some 150 MB in all at most.
REMEMBERED, LONGEST = 300_000, 64
_ODD = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Kinds of bytes: blanks, ASCII letters, digits and others; 0 for those (no ASCII, control characters, the apostrophe) next to which only blanks cut.
_BLANK, _KIND = np.zeros(256, bool), np.zeros(256, np.uint8)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_KIND[33:127] = 3
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[39] = 0
#: The first character behind those Latin ones that are letters or not in every version of Unicode.
_BEYOND = "\u0250"
#: How byte-level vocabularies write bytes: visible Latin-1 characters as they are, the others from U+0100 on.
_SHOWN = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}
_LOADED: dict[str, "_Encoder"] = {}


class _Encoder:
    def __init__(self, name: str, path: str | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_blanks = name == BYTE_BPE
        special = [re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([_ODD, *special])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        tokenize, lower = self.tokenizer.model.tokenize, not self.keeps_blanks
        rest = []
        for i, piece in enumerate(pieces):
            word = piece[1:] if piece[0] == " " else piece
            own = word.lower() if lower else word
            if own.isalpha() and word.isalpha() and (piece.isascii() or max(own) < _BEYOND > max(word)):
                shown = "Ġ" + own if piece[0] == " " else own
                if not piece.isascii():
                    shown = (piece.lower() if lower else piece).encode().decode("latin-1").translate(_SHOWN)
                out[i] = struct.pack(f"<{len(ids)}H", *ids) if len(ids := [x.id for x in tokenize(shown)]) else b""
            else:
                rest.append(i)
        for i, ids in zip(rest, self._ids([pieces[i] for i in rest])):
            out[i] = np.array(ids, "<u2").tobytes()
        return out

    def _remembered(self, pieces: list[str]) -> list[bytes]:
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        out = list(map(young.get, pieces))
        rest = [i for i, x in enumerate(out) if x is None]
        new = []
        for i in rest:
            x = pieces[i]
            if (got := old.get(x)) is None:
                new.append(i)
            else:
                out[i] = young[x] = got
        for i, got in zip(new, self._new([pieces[i] for i in new])):
            out[i] = got
            if len(pieces[i]) <= LONGEST and len(young) <= 2 * REMEMBERED:
                young[pieces[i]] = got
        return out

    def plain(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, `end` behind each, and how many each text has."""
        if not len(texts):
            return np.zeros(0, "<u2"), np.zeros(0, np.int64)
        stops = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[stops[0] : stops[-1]]
        stops = stops - stops[0]
        n = len(data)
        blank = _BLANK[data]
        first = np.zeros(n + 1, bool)
        first[stops] = True
        cut = np.empty(n, bool)
        cut[:1] = True
        np.not_equal(blank[1:], blank[:-1], out=cut[1:])
        cut |= first[:n]
        kind = _KIND[data]
        cut[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        if self.keeps_blanks:
            # A blank before a word is part of it; what stands before that blank, or before another kind of it, is one piece.
            at = np.flatnonzero(cut)
            stop = np.append(at[1:], n)[: len(at)]
            stop = stop[blank[at] & ~first[stop]]
            cut[stop - 1] = True
            cut[stop[data[stop - 1] == 32]] = False
            at = np.flatnonzero(cut)
            edges = np.append(at, n)
        else:
            at = np.flatnonzero(cut & ~blank)
            cut = np.flatnonzero(cut)
            size = np.diff(np.append(cut, n))[~blank[cut]] if n else at
            edges = np.append(0, np.cumsum(size))
            data = data[~blank]
        pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
        told = pieces.dictionary_encode()
        code = told.indices.to_numpy(zero_copy_only=False)
        known = self._remembered(told.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(known), "<u2")
        long = np.fromiter(map(len, known), np.int64, len(known)) >> 1
        start = np.cumsum(long) - long
        size = long[code]
        sums = np.append(0, np.cumsum(size))
        ids = flat[np.repeat(start[code] - sums[:-1], size) + np.arange(sums[-1])]
        per_text = np.diff(sums[np.searchsorted(at, stops)]) + 1
        out = np.full(len(ids) + len(texts), end, "<u2")
        own = np.ones(len(out), bool)
        own[np.cumsum(per_text) - 1] = False
        out[own] = ids
        return out, per_text


def encode(texts: pa.Array | Sequence[str | None], name: str, end: int, path: str | None = None) -> list[np.ndarray]:
    """The ids (uint16) of each text, null as empty, and `end` after them. Texts of a call should be a few MB."""
    key = path or name
    if key not in _LOADED:
        _LOADED[key] = _Encoder(name, path)
    own = _LOADED[key]
    texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.string()).fill_null("")
    odd = pc.match_substring_regex(texts, own.odd).to_numpy(zero_copy_only=False).astype(bool)
    ids, n = own.plain(texts.filter(pa.array(~odd)) if odd.any() else texts, end)
    plain = iter(np.split(ids, np.cumsum(n)[:-1]) if len(n) else [])
    if not odd.any():
        return list(plain)
    whole = iter(own._ids(texts.filter(pa.array(odd)).to_pylist()))
    return [np.array([*next(whole), end], "<u2") if x else next(plain) for x in odd.tolist()]
