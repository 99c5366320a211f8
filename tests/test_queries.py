"""Each query against its SQL, over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from prefixlake import bindings

FOLDER = "/root/testdata/sf0.001"


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return float(f"{x:.10g}") if isinstance(x, float) else x


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(FOLDER + "/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as from read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(bindings.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = bindings.QUERIES[name](spark, FOLDER)
    cols = sorted(got.columns)
    want = duck.sql(bindings.ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_pages_cover_whole_texts(spark, tmp_path):
    import hashlib

    long = "".join(chr(97 + i % 26) if i % 50 else "é€😀"[i // 50 % 3] for i in range(1000))
    texts = [(1, 0, long), (2, 0, long[:500] + "!" + long[501:]), (2, 1, "x" * 400), (3, 0, "y" * 15), (3, 1, long[:417])]
    spark.createDataFrame([(c, t, "user", x) for c, t, x in texts], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    pages, cached = {}, set()
    for c, t, x in texts:
        last, own = "", []
        for i in range(len(x) // 16):
            last = hashlib.sha256(last.encode() + b"".join(ord(k).to_bytes(4, "big") for k in x[16 * i : 16 * i + 16])).hexdigest()
            own.append(last)
        pages[c, t] = own
        cached |= {k for i, k in enumerate(own) if c % 2 == 0 and i % 5 != 3}
    assert len(pages[1, 0]) == 62
    folder = str(tmp_path)
    got = {(r.conv_id, r.turn, r["index"], r.key) for r in bindings.chained_hashes(spark, folder).collect()}
    assert got == {(*k, i, h) for k, own in pages.items() for i, h in enumerate(own)}
    filled = {k: own for k, own in pages.items() if own}
    got = {(r.conv_id, r.turn): (r.prefix, r.n_keys) for r in bindings.cached_prefix(spark, folder).collect()}
    assert got == {k: (next((i for i, h in enumerate(own) if h not in cached), len(own)), len(own)) for k, own in filled.items()}
    got = {(r.conv_id, r.turn): r.prefix for r in bindings.trailing_prefix(spark, folder).collect()}
    ok = {k: [i for i in range(len(own)) if i % 4 != 3 and (i == 0 or (i - 1) % 4 != 3)] for k, own in filled.items()}
    assert got == {k: max(v) + 1 if v else 0 for k, v in ok.items()}
