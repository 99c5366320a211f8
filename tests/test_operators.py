"""Fixed values and cases that the driver's tables do not hold."""

from pyspark.sql import functions as F

from prefixlake.functions import formats, hashing, textnorm
from prefixlake.operators import blocks, guard, kvlog, metrics, placement, registry, workload
from prefixlake.plans import matching
from prefixlake.sources import tables
from prefixlake.streaming import state


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_fnv_and_shards(spark):
    rows = spark.createDataFrame([("",), ("a",), ("foobar",), ("key-1",), (None,)], "k string")
    got = [tuple(r) for r in rows.select(hashing.fnv1a_hex(F.col("k")), hashing.shard_of(F.col("k"), 256)).collect()]
    assert got == [("cbf29ce484222325", 37), ("af63dc4c8601ec8c", 140), ("85944171f73967e8", 232), ("71135af295f27ea6", 166), (None, None)]
    assert one(spark, hashing.shard_of(F.lit("a"), 0)) == 0
    assert one(spark, hashing.token_bytes(F.lit(-1))) == b"\xff\xff\xff\xff" and one(spark, hashing.token_bytes(F.lit(128000))) == b"\x00\x01\xf4\x00"


def nodes(spark, n):
    return spark.createDataFrame([(f"node-{i}", f"h{i}:1") for i in range(n)], "node_id string, address string")


def test_placement_constants_and_moves(spark):
    owners = placement.ranked_owners(nodes(spark, 4), 256)
    assert {r.node_id: r.primaries for r in placement.shares(owners).collect()} == {"node-0": 76, "node-1": 54, "node-2": 50, "node-3": 76}
    for n, moved in ((4, 68), (8, 38), (16, 8)):
        r = placement.moves(placement.ranked_owners(nodes(spark, n), 256), placement.ranked_owners(nodes(spark, n + 1), 256), f"node-{n}").first()
        assert (r.moved, r.stable, r.violations) == (moved, 256 - moved, 0)
    ranked = placement.ranked_owners(nodes(spark, 2), 8, 5)
    assert ranked.count() == 16  # no more copies than nodes
    assert placement.ranked_owners(nodes(spark, 2).limit(0), 8).count() == 0
    assert placement.orphaned(ranked, nodes(spark, 1)).count() == 8


def test_normalised_text(spark):
    cases = {
        "a\r\nb\rc": "a\nb\nc", "a  \t\n\n\n\nb ": "a\n\nb ", "\n\n  x\n\n": "  x", "é": "é", "": "", "   ": "",
    }
    for text, want in cases.items():
        assert one(spark, textnorm.normalized(F.lit(text))) == want
        assert one(spark, textnorm.normalized(F.lit(want))) == want


def test_only_texts_that_may_change_go_to_python(spark):
    import re
    import unicodedata

    second = {ord(d.split()[1]) if len(d.split()[1]) == 1 else int(d.split()[1], 16) for c in range(0x110000) if len((d := unicodedata.decomposition(chr(c))).split()) == 2 and "<" not in d}
    second |= set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    ranges = [(int(a, 16), int(b, 16)) for a, b in re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", textnorm.INERT)]
    assert len(ranges) == textnorm.INERT.count("-")
    for a, b in ranges:
        assert all(not unicodedata.combining(chr(c)) and unicodedata.is_normalized("NFC", chr(c)) and c not in second for c in range(a, b + 1))
    texts = ["e\u0301a", "a\u0300\n\n\n\nx", "plain \u2019 \u20ac", "\u212b", "\u1100\u1161\u11a8", "\uac00\u11a8", "\U0001f600", "\u4e2d", "\u304b\u3099", "", None] * 60
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    got = {r.i: r.n for r in rows.select("i", textnorm.nfc(F.col("t")).alias("n")).collect()}
    assert [got[i] for i in range(len(texts))] == [x if x is None else unicodedata.normalize("NFC", x) for x in texts]


def test_long_runs_of_blanks_take_linear_time(spark):
    import time

    began = time.time()
    assert one(spark, textnorm.normalized(F.lit("a" + " \t" * 200_000 + "b" + " " * 9 + "\n"))) == "a" + " \t" * 200_000 + "b"
    assert time.time() - began < 30


def test_texts_are_not_shuffled_for_exact_matches(spark):
    from prefixlake import bindings

    plan = bindings.QUERIES["tier0_exact_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert all("text#" not in x for x in plan.splitlines() if "Exchange" in x or "Sort " in x or "Window " in x)
    batch = spark.createDataFrame([("x" * 5000 + "e\u0301",)] + [("x" * 5000,)] * 50, "t string").coalesce(1)
    sent = batch.select(textnorm.nfc(F.col("t")).alias("n"))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in sent and "CASE WHEN" in sent[sent.index("ArrowEvalPython") :]


def test_facts_equal_a_loop(spark):
    import random

    rng = random.Random(5)
    some = ["word", "été,", "fin.", "why?", "Not", "not", "never,", "don't", "(see", '"x"', "...", "—", "a.b", "Name", "iPhone", "v2", "--flag", "prod", "Production", "ever;", "everyone", "notes", "pre-production", "\u3000", "\u00a0b", "ÿz:", "[.", "K\u212a"]
    texts = [rng.choice(["", "\n", " "]).join([""] + ["".join(rng.choice(some) + rng.choice([" ", " ", "  ", "\n", "\t", "\r\n"]) for _ in range(rng.randint(0, 90)))]) for _ in range(300)] + ["word " * 20_000 + "Name", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: (r.polarity, r.entities) for r in guard.with_facts(rows, "t").collect()}
    families = {w: k for k, v in textnorm.POLARITY.items() for w in v.split()}
    for k, text in enumerate(texts):
        tokens, polarity = [], {}
        for line in textnorm.unicodedata.normalize("NFC", text or "").split("\n"):
            last = None
            for raw in line.split():
                token = raw.lstrip(textnorm.LEADING).rstrip(textnorm.TRAILING)
                if token:
                    tokens.append((token, last is None or last[-1] in textnorm.SENTENCE_ENDS))
                    last = raw
        for token, _ in tokens:
            family = "NEG" if token.lower().endswith(("n't", "n’t")) else families.get(token.lower())
            if family:
                polarity[family] = polarity.get(family, 0) + 1
        assert got[k][0] == polarity
        names = {t for t, start in tokens if t == "Name" and not start}
        values = {(t.lower() if start else t) for t, start in tokens if t.lower() in textnorm.VALUE_WORDS.split() and "-" not in t}
        assert {e[5:] for e in got[k][1] if e == "name:Name"} == names and {e[4:] for e in got[k][1] if e.startswith("val:") and "-" not in e} == values


def test_plain_words_go_before_tokens_are_cut(spark, monkeypatch):
    import random

    rng = random.Random(8)
    some = ["word", "été,", "fin.", "why?!", "Fin.", "Word", "Not", "not", "not#", "Never,", "nothing", "notx", "don't", "...", ".", "—", "a.b", "a!b", "NAME", "iPhone", "v2", "7", "Prod", "prod.", "Über:", "x::", "(so", "&%#", "字", "Ǆx", "ǅx", "K\u212a", "\u00a0x", "e\u0301"]
    texts = ["".join(rng.choice(some) + rng.choice([" ", " ", " ", "  ", "\n", "\t", "\r\n", "\u2003"]) for _ in range(rng.randint(0, 120))) for _ in range(600)]
    rows = spark.createDataFrame(list(enumerate([*texts, "word " * 100_000 + "Name", "Ein wort. " * 50_000, None])), "k int, t string")
    thin = {r.k: r.t for r in rows.select("k", textnorm.thinned(F.col("t")).alias("t")).collect()}
    assert thin[600] == "word Name" and len(thin[601]) <= 20 and thin[602] is None
    assert sum(map(len, (thin[k] for k in range(600)))) < sum(map(len, texts))
    got = guard.with_facts(rows, "t").collect()
    monkeypatch.setattr(guard, "thinned", lambda text: text)
    assert got == guard.with_facts(rows, "t").collect()


def test_guard_facts(spark):
    texts = [(1, "Never delete Production data. Don't touch GitHub before 5pm"), (2, "run --dry-run on prod\n- Alice said: Bob a_b"), (3, "")]
    got = {r.k: r for r in guard.facts(spark.createDataFrame(texts, "k int, t string"), "k", "t").collect()}
    assert got[1].polarity == {"NEG": 2, "BEFORE": 1} and got[1].entities == ["name:GitHub", "num:5pm", "val:Production"]
    assert got[2].polarity == {} and got[2].entities == ["flag:--dry-run", "id:a_b", "name:Alice", "val:prod"]
    assert got[3].entities == []


def test_guard_walk(spark):
    rows = [(1, 1, None, 0.95, "a"), (2, 1, "entity_mismatch", 0.99, "a"), (2, 2, None, 0.5, "b"), (3, 1, None, 0.8, "a"), (4, 1, "negation_mismatch", 0.9, "a"), (5, 1, "entity_mismatch", 0.99, "a"), (5, 2, None, 0.93, "b")]
    c = spark.createDataFrame([(k, r, w, s, x, 1) for k, r, w, s, x in rows], "k int, rank int, reason string, similarity double, context_id string, version int")
    got = {r.k: (r.outcome, r.reason, r.context_id) for r in guard.walk(c, "k").collect()}
    assert got == {1: ("matched", None, "a"), 2: ("rejected", "entity_mismatch", None), 3: ("rejected", "low_similarity", None), 4: ("rejected", "negation_mismatch", None), 5: ("matched", None, "b")}


def unit(i):
    return [1.0 if k == i else 0.0 for k in range(4)]


def test_matching_tiers_and_tenants(spark):
    records = [
        ("t1", "c1", 1, "org_policy", "Never share keys.", unit(0), None), ("t1", "c2", 1, "org_policy", "Always rotate keys monthly.", unit(1), None),
        ("t2", "c1", 1, "org_policy", "Never share keys.", unit(0), None), ("t1", "c3", 1, "org_policy", "old text", unit(2), "gone"),
    ]
    r = spark.createDataFrame(records, "namespace string, context_id string, version int, block_type string, text string, embedding array<double>, deprecated_at string")
    r = r.withColumn("content_hash", textnorm.content_hash(F.col("text")))
    aliases = spark.createDataFrame([("t1", "c2", 1, "rotation", 0)], "namespace string, context_id string, version int, alias string, ordinal int")
    rows = [
        (1, "t1", "org_policy", "Never share keys.  \r\n", None), (2, "t1", "org_policy", "rotation", None), (3, "t2", "org_policy", "rotation", None), (4, "t1", "org_policy", "Never share the keys.", unit(0)),
        (5, "t1", "org_policy", "Share the keys.", unit(0)), (6, "t1", "org_policy", "old text", unit(2)), (7, "t3", "org_policy", "Never share the keys.", unit(0)),
    ]
    b = spark.createDataFrame(rows, "block_id int, namespace string, block_type string, text string, embedding array<double>")
    got = {x.block_id: (x.outcome, x.method, x.reason, x.context_id) for x in matching.decisions(b, r, r.select(*registry.KEY), aliases).collect()}
    assert got[1] == ("matched", "exact", None, "c1") and got[2] == ("matched", "alias", None, "c2")
    assert got[3][:3] == ("rejected", None, "no_candidate") and got[4] == ("matched", "semantic", None, "c1")
    assert got[5][2] == "negation_mismatch" and got[6][0] == "rejected" and got[7][2] == "no_candidate"


def test_blocks_skip_empty_messages(spark):
    m = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", ""), (1, 2, "user", "q1"), (1, 3, "assistant", None), (1, 4, "user", "q2"), (2, 0, "tool", "x" * 9)], "request_id int, position int, role string, text string")
    got = [(r.request_id, r["index"], r.block_type, r.token_estimate) for r in blocks.decomposed(m).orderBy("request_id", "index").collect()]
    assert got == [(1, 0, "system_prompt", 1), (1, 1, "conversation_history", 1), (1, 2, "user_query", 1), (2, 0, "conversation_history", 3)]


def test_valid_prefix(spark):
    def run(seqs, bad=(), buckets=3):
        log = spark.createDataFrame([(s, s not in bad) for s in seqs], "sequence long, ok boolean")
        return sorted(r.sequence for r in kvlog.valid_prefix(log, "ok", buckets).collect())

    assert run(range(1, 11)) == list(range(1, 11))
    assert run([1, 2, 3, 4, 6, 7, 8]) == [1, 2, 3, 4]
    assert run(range(1, 11), bad={8}) == list(range(1, 8))
    assert run([2, 3, 4]) == [] and run([1, 2, 2, 3]) == [1] and run([1, 2, 3, 7, 8, 9]) == [1, 2, 3] and run([]) == []


def test_state_with_deletions(spark):
    log = spark.createDataFrame([(1, 2, "a", "1"), (2, 2, "b", ""), (3, 3, "a", None), (4, 2, "c", "x"), (5, 2, "c", "y")], "sequence long, opcode int, key string, value string")
    now = kvlog.latest(log)
    assert sorted((r.key, r.value) for r in now.collect()) == [("b", ""), ("c", "y")]
    asked = spark.createDataFrame([("a",), ("b",)], "key string")
    assert sorted((r.key, r.found) for r in kvlog.reads(asked, now).collect()) == [("a", False), ("b", True)]


def test_percentile_rules(spark):
    v = spark.createDataFrame([(float(x),) for x in (4, 2, 1, 3)], "v double")
    got = {rule: workload.percentiles(v, "v", [], {"p": 0.5}, rule).first()["p"] for rule in ("floor", "ceil", "round")}
    assert got == {"floor": 3.0, "ceil": 2.0, "round": 3.0}


def test_fnv_of_all_lengths(spark):
    keys = [None, "", "a", "é€😀", "x" * 3000, *[f"key-{i}" for i in range(50)]]
    want = {}
    for k in keys:
        h = 0xCBF29CE484222325
        for b in (k or "").encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        want[k] = None if k is None else f"{h:016x}"
    df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(3)
    assert {r.k: r.h for r in df.select("k", hashing.fnv1a_hex(F.col("k")).alias("h")).collect()} == want


def test_ranges_of_values_and_samples(spark, monkeypatch):
    import random

    r = random.Random(3)
    rows = [(r.choice(["a", "a", "b", None]), float(r.randint(0, 300))) for _ in range(900)] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {x.g: (x.p50, x.p99) for x in workload.percentiles(df, "v", ["g"], {"p50": 0.5, "p99": 0.99}, "floor").collect()}
    for g in ("a", "b", None):
        v = sorted(x for k, x in rows if k == g and x is not None)
        assert got[g] == tuple(v[min(int(p * len(v)), len(v) - 1)] for p in (0.5, 0.99))
    monkeypatch.setattr(metrics, "RANGE", 3)
    views = [(s, n, r.randint(0, s + 1)) for s in range(20) for n in range(3)]
    seen = {x.sample: x.highest for x in metrics.convergence(spark.createDataFrame(views, "sample long, node_id int, generation int")).collect()}
    assert seen == {s: max(g for t, _, g in views if t <= s) for s in range(20)}


def test_dead_runs_and_drift(spark):
    rows = spark.createDataFrame([(i, o, 0) for i, o in enumerate([5, 5, 0, 5, 5, 5])], "i int, operations int, verified int")
    assert workload.longest_dead_run(rows, "i").first()["longest"] == 3 and workload.dead(rows).count() == 5
    assert workload.drift(rows.limit(3), "i", ["operations"]).first()["operations_first"] is None
    moved = rows.withColumn("operations", F.col("i") + 1)
    assert workload.drift(moved, "i", ["operations"]).first()["operations_percent"] == 500.0
    assert workload.reservoir(rows, 4, "i").count() == 4
    assert {r.i for r in workload.reservoir(rows, 4, "i").collect()} == {r.i for r in workload.reservoir(rows.repartition(5), 4, "i").collect()}


def test_latched_and_changes(spark):
    rows = spark.createDataFrame([("g", 1, False, 1), ("g", 2, True, 1), ("g", 3, False, 2)], "g string, i int, ready boolean, v int")
    assert [r.latched for r in metrics.latched(rows, "g", "i", "ready").orderBy("i").collect()] == [False, True, True]
    assert tuple(metrics.changes(rows, "g", "i", "v").first()) == ("g", 1, 3)


def test_formats(spark):
    assert one(spark, formats.metric_line(F.lit("m"), F.create_map(F.lit("b"), F.lit('x"\n'), F.lit("a"), F.lit("\\")), F.lit("1"))) == 'm{a="\\\\",b="x\\"\\n"} 1'
    assert one(spark, formats.human_bytes(F.lit(1536))) == "1.5 KiB" and one(spark, formats.percent_change(F.lit(5.0), F.lit(0.0))) == 0.0
    parsed = one(spark, formats.parsed_layer_key(F.lit("kv:layer_3:abc")))
    assert (parsed.model, parsed.layer, parsed.hash, parsed.tag) == (None, 3, "abc", None)


def test_json_round_trip(spark, tmp_path):
    row = spark.sql("select 'r' request_id, '2026-01-01T00:00:00+02:00' timestamp, 0.5D similarity")
    tables.append_json(row, str(tmp_path / "d"))
    tables.append_json(row, str(tmp_path / "d"))
    back = tables.read_decisions(spark, str(tmp_path / "d")).collect()
    assert len(back) == 2 and back[0].timestamp == "2026-01-01T00:00:00+02:00" and back[0].similarity == 0.5


def test_streams_equal_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(i, 2 if i % 4 else 3, f"k{i % 3}", str(i), f"2026-01-01 00:00:{i % 60:02d}", "read" if i % 2 else "error") for i in range(1, 60)]
    df = spark.createDataFrame(rows, "sequence long, opcode int, key string, value string, ts string, op string").withColumn("ts", F.to_timestamp("ts"))
    df.repartition(4).write.parquet(src)
    again = spark.readStream.schema(df.schema).parquet(src)
    q = state.interval_counts(again, 30).writeStream.format("memory").queryName("iv").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r.operations for r in spark.table("iv").collect()) == 59 and spark.table("iv").count() == 2

