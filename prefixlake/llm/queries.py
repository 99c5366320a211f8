"""The queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prefixlake.llm.common import table


def _of(module: str, *names: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query: digest() of a module, over the tables named, or over the session and folder."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        digest = importlib.import_module(f"prefixlake.llm.{module}").digest
        return digest(*[table(spark, sf_dir, n) for n in names]) if names else digest(spark, sf_dir)

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_topk": _of("topk", "embeddings"),
    "op2_suffix_dedup": _of("suffixes", "documents"),
    "op3_toxicity": _of("toxicity"),
    "op4_quality_rules": _of("quality"),
    "op5_sharding": _of("sharding", "documents"),
    "op6_jaccard_join": _of("jaccard", "documents"),
    "op7_grammar_tokens": _of("tokens", "documents"),
    "op8_packing": _of("packing", "documents"),
    "op9_mixing": _of("mixing", "documents"),
    "op10_lm_bloom": _of("lm", "documents"),
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op5_sharding": """
WITH RECURSIVE bits(i, b, c) AS (
  SELECT i, 0, i::UINTEGER FROM range(256) t(i)
  UNION ALL SELECT i, b + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END FROM bits WHERE b < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE b = 8
), d AS (
  SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size, coalesce(text, '') AS text,
         md5('shard-5:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents
), f AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS LAST) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS f FROM d
), r AS (SELECT *, row_number() OVER (ORDER BY f, source NULLS LAST, h, doc_id NULLS LAST) - 1 AS k, count(*) OVER () AS n FROM f
), s AS (SELECT *, (k * 8) // n AS shard FROM r)
SELECT doc_id, size::BIGINT AS size,
       xor(list_reduce(list_transform(string_split(regexp_replace(hex(encode(text)), '(..)', '\\1 ', 'g'), ' ')[:-2], lambda x: ('0x' || x)::UINTEGER),
           lambda a, b: xor(a >> 8, crc.t[1 + (xor(a, b) & 255)]), 4294967295::UINTEGER), 4294967295::UINTEGER)::BIGINT AS text_crc32,
       'rows' AS law, shard::INT AS shard, (k - (shard * n + 7) // 8)::BIGINT AS slot, NULL::INT AS grown_shard, source
FROM s, crc""",
    "op9_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix-9:' || coalesce(doc_id::VARCHAR, 'null')), 1, 4))::INT AS bin FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, source_size * 2.0::DOUBLE AS cap FROM s
), k AS (
  SELECT *, row_number() OVER o AS k, sum(source_size) OVER () * 1.5::DOUBLE AS total,
    coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
  FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)
), l AS (SELECT arg_min((total - capped) / rest, k) AS level FROM k WHERE (total - capped) / rest * w <= cap
), t AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * w) END AS target FROM k, l
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole, target - whole * source_size AS want,
    CASE WHEN source_size > 0 THEN floor((target / source_size - whole) * 65536 + 0.5::DOUBLE)::INT ELSE 0 END AS plain FROM t
), h AS (
  SELECT source, bin, n, sum(n) OVER (PARTITION BY source ORDER BY bin) AS below
  FROM (SELECT source, bin, sum(size) AS n FROM d GROUP BY source, bin)
), b AS (
  SELECT g.source, min({'e': abs(below - want), 'b': bin}) AS best, coalesce(sum(n) FILTER (bin < plain), 0) AS drawn FROM g JOIN h ON g.source IS NOT DISTINCT FROM h.source GROUP BY g.source
)
SELECT d.doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies, source FROM (
  SELECT d.*, g.source_size, g.target, (whole + (CASE WHEN abs(drawn - want) <= 0.005::DOUBLE * g.target THEN bin < plain WHEN want <= best.e THEN false ELSE bin <= best.b END)::INT)::INT AS copies
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source JOIN b ON d.source IS NOT DISTINCT FROM b.source) d""",
}
