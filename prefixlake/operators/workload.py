"""Analysis of cache workloads: rates, exact percentiles, concentration, intervals, drift, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_values(df: DataFrame, value: str, groups: list[str], parts: int = 64) -> DataFrame:
    """(groups, value, n rows of that value, hi: rows up to it, total): order statistics without gathering a group.

    Distinct values are counted, then dealt into `parts` ranges between approximate percentiles;
    sums run within a range of a group, behind the sums of the ranges before it.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("n"))
    cuts = counts.agg(F.percentile_approx(value, [k / parts for k in range(1, parts)], 1000).alias("x")).first()["x"] or []
    counts = counts.withColumn("_r", F.size(F.filter(F.array(*[F.lit(x) for x in sorted(set(cuts))]), lambda x: x < F.col(value))) if cuts else F.lit(0))
    w = Window.partitionBy(*[f"_g{k}" for k in range(len(groups))])
    sums = counts.groupBy(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)], F.col("_r").alias("_p")).agg(F.sum("n").alias("_n"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("_n").over(w)).drop("_n")
    on = F.col("_r") == F.col("_p")
    for k, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    within = F.sum("n").over(Window.partitionBy(*groups, "_r").orderBy(value))
    return counts.withColumn("_in", within).join(sums, on).select(*groups, value, (F.col("_in") + F.col("_before")).alias("hi"), "n", "total")


def percentile(p: Column | float, n: Column, rule: str) -> Column:
    """The place from 0 of a percentile among n sorted values: floor of p * n, ceil of p * n less one, or p * (n - 1) rounded half up."""
    p = F.lit(p) if isinstance(p, float) else p
    place = {"floor": F.floor(p * n), "ceil": F.ceil(p * n) - 1, "round": F.floor(p * (n - 1) + 0.5)}[rule]
    return F.greatest(F.lit(0), F.least(place, n - 1))


def percentiles(df: DataFrame, value: str, groups: list[str], ps: dict[str, float], rule: str = "floor") -> DataFrame:
    """Exact percentiles of each group under one of three rules; ps: names and fractions."""
    r = ranked_values(df, value, groups)
    at = {name: percentile(p, F.col("total"), rule) for name, p in ps.items()}
    return r.groupBy(*groups).agg(*[F.max(F.when((c >= F.col("hi") - F.col("n")) & (c < F.col("hi")), F.col(value))).alias(k) for k, c in at.items()])


def summary(samples: DataFrame, groups: list[str]) -> DataFrame:
    """Operations, reads, hits, errors, and the hit rate (null without reads)."""
    read = F.col("op") == "read"
    return samples.groupBy(*groups).agg(
        F.count("*").alias("operations"),
        F.count_if(read).alias("reads"),
        F.count_if(F.col("op") == "write").alias("writes"),
        F.count_if(F.col("op") == "error").alias("errors"),
        F.try_divide(F.count_if(read & F.col("hit")).cast("double"), F.count_if(read).cast("double")).alias("hit_rate"),
    )


def concentration(accesses: DataFrame, keys: DataFrame, percent: int) -> DataFrame:
    """Share of accesses (key) that go to the hottest percent of all keys, rounded up, one at least; keys without any count too."""
    n = accesses.groupBy("key").agg(F.count("*").alias("n"))
    total = keys.select("key").distinct().join(n, "key", "left").agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("ops"), F.count("n").alias("touched"))
    byn = n.groupBy("n").agg(F.count("*").alias("m"))  # keys that are alike in count are one row
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"))
    run = byn.select("n", "m", (F.sum("m").over(w) - F.col("m")).alias("before"))
    x = run.crossJoin(total).withColumn("k", F.greatest(F.lit(1), F.ceil(F.col("keys") * percent / 100)))  # one row
    part = F.greatest(F.lit(0), F.least(F.col("m"), F.col("k") - F.col("before"))) * F.col("n")
    return x.groupBy("keys", "ops", "touched", "k").agg(F.try_divide(F.sum(part).cast("double"), F.max("ops").cast("double")).alias("share"))


def intervals(samples: DataFrame, seconds: int) -> DataFrame:
    """Tumbling intervals of samples (ts, op, latency): index from the first one, counts and mean latency; empty ones are left out."""
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1_000_000))
    x = samples.withColumn("slot", at)
    return x.groupBy("slot").agg(
        F.count("*").alias("operations"), F.count_if(F.col("op") == "read").alias("verified"), F.count_if(F.col("op") == "error").alias("errors"), F.avg("latency").alias("mean_latency")
    )


def deltas(counters: DataFrame, tick: str, value: str) -> DataFrame:
    """Cumulative counters as differences; the first from 0. counters hold one row a tick."""
    before = F.lag(value, 1, 0).over(Window.partitionBy(F.lit(0)).orderBy(tick))
    return counters.withColumn("delta", F.col(value) - before)


def dead(rows: DataFrame) -> DataFrame:
    """Intervals with operations of which none was verified."""
    return rows.where((F.col("operations") > 0) & (F.col("verified") == 0))


def longest_dead_run(rows: DataFrame, order: str) -> DataFrame:
    """The longest run of dead intervals; one without operations breaks it. Rows are intervals, few for any run."""
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    bad = (F.col("operations") > 0) & (F.col("verified") == 0)
    x = rows.withColumn("_bad", bad).withColumn("_i", F.row_number().over(w))
    x = x.where("_bad").withColumn("_g", F.col("_i") - F.row_number().over(w))
    return x.groupBy("_g").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("longest"))


def drift(rows: DataFrame, order: str, values: list[str]) -> DataFrame:
    """Means of the first and last quarter (n div 4 intervals) and the change in percent; null for fewer than four."""
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    x = rows.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(0))))
    q = F.expr("_n div 4")
    first, last = F.col("_i") <= q, F.col("_i") > F.col("_n") - q
    aggs = [f(v) for v in values for f in (lambda v: F.avg(F.when(first, F.col(v))).alias(f"{v}_first"), lambda v: F.avg(F.when(last, F.col(v))).alias(f"{v}_last"))]
    change = {f"{v}_percent": F.try_divide(100 * (F.col(f"{v}_last") - F.col(f"{v}_first")), F.col(f"{v}_first")) for v in values}
    return x.agg(*aggs).withColumns(change)


def verdict(totals: DataFrame, max_error_rate: float = 0.5) -> DataFrame:
    """totals (operations, verified, errors, mismatches, dead) with error_rate, problems and result."""
    rate = F.when(F.col("operations") > 0, F.col("errors") / F.col("operations")).otherwise(F.lit(0.0))
    problems = F.array_compact(
        F.array(
            F.when(F.col("mismatches") > 0, F.lit("mismatches")),
            F.when(F.col("dead") > 0, F.lit("dead_intervals")),
            F.when((F.col("verified") == 0) & (F.col("operations") > 0), F.lit("nothing_verified")),
            F.when(F.col("error_rate") > max_error_rate, F.lit("error_rate")),
        )
    )
    x = totals.withColumn("error_rate", rate).withColumn("problems", F.array_join(problems, ","))
    return x.withColumn("result", F.when(F.col("problems") == "", "healthy").otherwise("degraded"))


def reservoir(rows: DataFrame, k: int, key: str, seed: int = 7) -> DataFrame:
    """A uniform sample of k rows: those of the k least seeded hashes of a key, the same however rows are partitioned; only k rows a task are kept."""
    return rows.withColumn("_r", F.xxhash64(F.lit(seed), key)).orderBy("_r", key).limit(k).drop("_r")


def report(samples: DataFrame, groups: list[str], value: str, seconds: float, payload: int = 0) -> DataFrame:
    """Count, least, mean and greatest value of each group, and its operations and payload bytes a second."""
    n = F.count("*")
    return samples.groupBy(*groups).agg(
        n.alias("n"), F.min(value).alias("least"), F.avg(value).alias("mean"), F.max(value).alias("greatest"), (n / F.lit(float(seconds))).alias("per_second"), (n * payload / F.lit(float(seconds))).alias("bytes_per_second")
    )


def cycles(lines: DataFrame, groups: list[str], line: str = "line") -> DataFrame:
    """Of an injector's log: crashes, injectors started, distinct numbers of crash cycles."""
    text = F.col(line)
    number = F.regexp_extract(text, r"\[chaos-cycle (\d+)\]", 1)
    crash = text.contains("Crashing") & (number != "")
    return lines.groupBy(*groups).agg(F.count_if(crash).alias("crash_cycles"), F.count_if(text.contains("[injector] started")).alias("injectors_started"), F.countDistinct(F.when(crash, number.cast("long"))).alias("distinct_cycles"))


def representatives(keys: DataFrame, group: str, key: str, order: str) -> DataFrame:
    """The first key of each group; ties in order go to the smaller key."""
    return keys.groupBy(group).agg(F.min(F.struct(order, key)).alias("_x")).select(group, F.col(f"_x.{key}").alias(key))
