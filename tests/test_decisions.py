"""The structural tier, decision rows, canonical JSON and blobs on small fixtures."""

import json

from pyspark.sql import functions as F

from prefixlake.functions import structured, textnorm
from prefixlake.operators import blocks, prefix, registry
from prefixlake.plans import matching


def test_canonical_json_refuses(spark):
    deep = "[" * 100_000 + "]" * 100_000
    texts = ['{"b": 1, "a": "é"}', '{"a":1,"a":2}', "[NaN]", "[Infinity]", "", "{", None, deep, r'"\ud800"', "[1.0, 2]", ' {"x": {"z": 1, "y": [ ]}} ']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", structured.canonical_json("t").alias("c"), structured.tool_text("t").alias("o")).collect()
    got = {r.i: (r.c, r.o) for r in rows}
    assert got[0] == ('{"a":"é","b":1}', '{"b": 1, "a": "é"}') and got[9][0] == "[1.0,2]" and got[10][0] == '{"x":{"y":[],"z":1}}'
    assert all(got[i][0] is None for i in range(1, 9)) and got[1][1] == '{"a": 2}' and all(got[i][1] is None for i in (4, 5, 6, 7, 8))


def test_structural_tier_and_rows(spark):
    schema, own = '{"type":"object","name":"x"}', [1.0, 0.0]
    canonical = json.dumps(json.loads(schema), sort_keys=True, separators=(",", ":"))
    rows = [("t1", "c1", 1, "tool_schema", canonical, [0.0, 1.0], None), ("t1", "c2", 1, "org_policy", "Always keep logs.", own, None)]
    r = spark.createDataFrame(rows, "namespace string, context_id string, version int, block_type string, text string, embedding array<double>, deprecated_at string")
    r = r.withColumn("content_hash", textnorm.content_hash(F.col("text")))
    none = spark.createDataFrame([], "namespace string, context_id string, version int, alias string, ordinal int")
    ask = [
        (1, "t1", "tool_schema", '{ "name": "x",\n "type": "object" }', None), (2, "t2", "tool_schema", schema, None), (3, "t1", "tool_schema", '{"name":"x","name":"x","type":"object"}', None),
        (4, "t1", "org_policy", "Always keep all logs.", own), (5, "t1", "org_policy", "Never keep logs.", own), (6, "t1", "org_policy", "Always keep any logs.", [0.6, 0.8]), (7, "t1", "org_policy", None, None),
    ]
    b = spark.createDataFrame(ask, "block_id int, namespace string, block_type string, text string, embedding array<double>")
    d = matching.decision_rows(matching.decisions(b, r, r.select(*registry.KEY), none))
    got = {x.block_id: (x.label, x.reason, x.context_id, x.similarity, x.guard_outcome) for x in d.collect()}
    assert got[1] == ("structural", None, "c1", None, None)
    assert got[2] == got[3] == got[7] == ("no_candidate", "no_candidate", None, None, None)
    assert got[4] == ("semantic", None, "c2", 1.0, "passed") and got[5] == ("rejected", "negation_mismatch", "c2", 1.0, "rejected")
    assert got[6] == ("rejected", "low_similarity", "c2", 0.6, None)
    report = {x.label: (x.n, x.n_right) for x in matching.report(d, F.col("context_id") == "c2").collect()}
    assert report == {"structural": (1, 0), "no_candidate": (3, 0), "semantic": (1, 1), "rejected": (2, 2)}


def test_decisions_shuffle_no_tokens_and_count_none_twice(spark):
    from prefixlake import bindings

    plan = bindings.QUERIES["match_decisions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "raw#" not in plan
    q = spark.createDataFrame([(i, "t", "x", [1.0, 0.1 * i]) for i in range(40)], "query_id int, namespace string, block_type string, embedding array<double>")
    r = spark.createDataFrame([("t", "x", f"c{i % 7}", i, [0.01 * i, 0.5]) for i in range(60)], "namespace string, block_type string, context_id string, version int, embedding array<double>")
    few, many = ({tuple(x) for x in matching.vector.top_candidates(q, r, many_queries=m).select("query_id", "rank", "context_id", "version", "similarity").collect()} for m in (False, True))
    assert few == many and len(many) == 200


def test_report_reads_short_rows(spark):
    from prefixlake import bindings

    plan = bindings.QUERIES["match_report"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x and "ReadSchema" in x and "text:string" in x.split("ReadSchema")[1]]
    assert len(scans) == 1  # for the facts of current records; all else comes from the rows that one pass over the texts has left


def test_blobs_and_pooling(spark):
    v = spark.createDataFrame([(1, [3.0, 0.0], True), (1, [0.0, 4.0], True), (1, [9.0, 9.0], False), (2, [0.0, 0.0], True), (3, None, True)], "g int, v array<float>, m boolean")
    got = {r.g: r.pooled for r in structured.mean_pooled(v, "g", "v", F.col("m")).collect()}
    assert got == {1: [0.6, 0.8], 2: [0.0, 0.0]}
    b = v.select("v", structured.vector_blob("v").alias("b"))
    rows = b.select("v", structured.blob_vector(F.col("b"), 2).alias("same"), structured.blob_vector(F.col("b"), 3).alias("other")).collect()
    assert all(r.v == r.same and r.other is None for r in rows)


def test_tools_follow_messages(spark):
    m = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q"), (2, 0, "user", "")], "request_id int, position int, role string, text string")
    t = spark.createDataFrame([(1, 1, '{"b":1}'), (1, 0, '{"a":1}'), (1, 2, "no"), (2, 0, "{}")], "request_id int, position int, tool string")
    b = blocks.with_tools(blocks.decomposed(m), t)
    assert sorted((r.request_id, r["index"], r.block_type, r.text) for r in b.collect()) == [
        (1, 0, "system_prompt", "s"), (1, 1, "user_query", "q"), (1, 2, "tool_schema", '{"a": 1}'), (1, 3, "tool_schema", '{"b": 1}'), (2, 0, "tool_schema", "{}")
    ]


def test_multi_pool_equals_a_loop(spark):
    import random

    rng, rows, want = random.Random(3), [], {}
    for r in range(60):
        n = rng.randint(1, 9)
        have = {p: [rng.random() < 0.8 for _ in range(n)] for p in ("kv", "a", "b")}
        rows += [(r, i, have["kv"][i], have["a"][i], have["b"][i]) for i in range(n)]
        kv = next((i for i in range(n) if not have["kv"][i]), n)
        a = next((k for k in range(kv, 0, -1) if all(have["a"][max(0, k - 2) : k])), 0)
        b = next((i for i in range(kv) if not have["b"][i]), kv) if min(kv, a) else 0
        want[r] = (kv, a, b, min(kv, a, b))
    x = spark.createDataFrame(rows, "request int, index int, kv boolean, a boolean, b boolean")
    got = {r.request: (r.kv_pages, r.a_pages, r.b_pages, r.pages) for r in prefix.multi_pool(x, "request", {"a": 2, "b": 0}).collect()}
    assert got == want
