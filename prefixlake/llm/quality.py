"""Quality rules: a decision list learned by sequential covering, applied as Spark conditions.

All of it is DataFrame operations. Rules are grown one threshold at a time by information gain on
two thirds of the labelled rows, pruned on the last third, and kept while they are right there;
what a rule covers is then set aside. The list becomes one ordered CASE WHEN.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixlake.llm.common import id_fold, table, words, written

#: Windows of so many words count as repeats.
WINDOW = 8
FEATURES = ("symbol_share", "word_length", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "n_words")


def statistics(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to doc_id and whole-text counts, all long. Null and blank texts: zeros."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", text.alias("text"))
    d = d.select("doc_id", "text", words(F.col("text")).alias("w"), F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "").alias("lines"))
    n = F.size("w")
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("w"), i, WINDOW)))).otherwise(
        F.array().cast("array<bigint>")
    )
    d = d.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        hashes.alias("h"),
    )
    # Texts in which no window occurs twice, nearly all, skip the sort of (hash, place).
    twice = F.size(F.array_distinct("h")) < F.size("h")
    pairs = F.when(twice, F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.withColumn("pairs", pairs).drop("h")
    own = F.transform(
        "pairs",
        lambda p, k: F.when((p["h"] == F.get("pairs", k - 1)["h"]) | (p["h"] == F.get("pairs", k + 1)["h"]), p["i"]),
    )
    d = d.withColumn("places", F.sort_array(F.array_compact(own))).drop("pairs")
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + (p + WINDOW) - F.greatest(p, a["end"])).alias("n")),
        lambda a: a["n"].cast("long"),
    )
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("places")


def with_features(stats: DataFrame) -> DataFrame:
    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return stats.withColumns(
        {
            "symbol_share": share("n_symbols", "word_chars"),
            "word_length": share("word_chars", "n_words"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "distinct_share": share("n_distinct", "n_words"),
            "upper_share": share("n_upper", "word_chars"),
        }
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


Condition = tuple[str, str, float]


def holds(rule: list[Condition]) -> Column:
    out = F.lit(True)
    for name, sign, at in rule:
        out = out & ((F.col(name) > F.lit(at)) if sign == ">" else (F.col(name) <= F.lit(at)))
    return out


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as one ordered condition: false for what a rule covers, else true."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(holds(rule), F.lit(False)).otherwise(out)
    return out


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> tuple[dict[Condition, list[int]], list[int]]:
    """Of [bad, good] rows: under each threshold and over it, and in all. One aggregation over every feature's bins."""
    names = list(cuts)
    bins = [F.struct(F.lit(k).alias("f"), _bin(name, cuts[name]).alias("b")) for k, name in enumerate(names)]
    got = rows.select("good", F.explode(F.array(*bins)).alias("x")).groupBy("x.f", "x.b", "good").count().collect()
    out: dict[Condition, list[int]] = {}
    total = [0, 0]
    for r in got:
        if r["f"] == 0:
            total[r["good"]] += r["count"]
    for k, name in enumerate(names):
        for j, at in enumerate(cuts[name]):
            under = [sum(r["count"] for r in got if r["f"] == k and r["good"] == g and r["b"] <= j) for g in (0, 1)]
            out[(name, "<=", at)] = under
            out[(name, ">", at)] = [total[0] - under[0], total[1] - under[1]]
    return out, total


def _bin(name: str, cuts: list[float]) -> Column:
    """The number of thresholds below a value."""
    out = F.lit(0)
    for at in cuts:
        out = out + (F.col(name) > F.lit(at)).cast("int")
    return out


def learn(labelled: DataFrame, max_rules: int = 8, max_conditions: int = 4, cuts: int = 24, purity: float = 0.8) -> list[list[Condition]]:
    """Rules for the rows to turn away, from rows with FEATURES, good (0 or 1) and fold (0 to 2; fold 2 prunes).

    All labelled rows count. Only counts for each feature and threshold reach the driver. Without
    labels, or with one class only, there are no rules.
    """
    points = [(k + 0.5) / cuts for k in range(cuts)]
    got = labelled.agg(*[F.percentile_approx(x, points, 2000).alias(x) for x in FEATURES], *[F.percentile_approx(F.when(F.col("good") == 0, F.col(x)), points, 2000).alias(f"{x}_bad") for x in FEATURES]).first()
    thresholds = {x: sorted({float(v) for v in [*(got[x] or []), *(got[f"{x}_bad"] or [])]}) for x in FEATURES}
    thresholds = {k: v for k, v in thresholds.items() if v}
    rules: list[list[Condition]] = []
    grow, prune = labelled.where("fold < 2"), labelled.where("fold = 2")
    while thresholds and len(rules) < max_rules:
        left = verdict(rules)
        rule: list[Condition] = []
        while len(rule) < max_conditions:
            counts, (bad, good) = _counts(grow.where(left & holds(rule)), thresholds)
            if not bad or not good:
                break

            def gain(c: list[int], bad: int = bad, good: int = good) -> float:
                return c[0] * (math.log2(c[0] / (c[0] + c[1])) - math.log2(bad / (bad + good))) if c[0] else 0.0

            best = max(sorted(counts), key=lambda c: gain(counts[c]))
            if gain(counts[best]) <= 1e-9:
                break
            rule.append(best)
        if not rule:
            break
        rows = prune.where(left)
        worth = rows.agg(
            *[F.coalesce(F.sum(F.when(holds(rule[: k + 1]) & (F.col("good") == g), 1)), F.lit(0)).alias(f"c{k}_{g}") for k in range(len(rule)) for g in (0, 1)]
        ).first()
        scores = [((worth[f"c{k}_0"] - worth[f"c{k}_1"]) / (worth[f"c{k}_0"] + worth[f"c{k}_1"] or 1), -k) for k in range(len(rule))]
        keep = 1 - max(scores)[1]
        bad, good = worth[f"c{keep - 1}_0"], worth[f"c{keep - 1}_1"]
        if bad < purity * (bad + good) or bad == 0:
            break
        rules.append(rule[:keep])
    return rules


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: its counts, base_failed and kept.

    docs (doc_id, text), labels (doc_id, quality). Null texts have no words and fail. Rows with the
    same id are judged each on its own text; labels without a document, or null, teach nothing.
    """
    stats = with_features(written(statistics(docs), "quality")).withColumn("base_failed", base_failed())
    known = labels.select("doc_id", F.col("quality").cast("int").alias("good")).where("good in (0, 1)")
    labelled = written(stats.where(~F.col("base_failed")).join(known, "doc_id").withColumn("fold", id_fold(F.col("doc_id"), 3)), "labelled")
    rules = learn(labelled)
    return stats.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def digest(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
