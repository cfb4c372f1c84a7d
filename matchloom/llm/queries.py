"""Queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchloom.llm import conversations, descent, lexical, mixing, neighbours, packing, quality, secret_scan, sharding, simhash, suffixes, topk, toxicity
from matchloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query
def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan(table(spark, folder, "documents"))


@query
def op4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, folder, "embeddings"))


@query
def op5_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"))


ORACLE["op5_topk"] = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score, a.rid, b.rid AS other
  FROM v a JOIN v b ON a.rid <> b.rid WHERE a.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST, other) AS rank FROM s) WHERE rank <= 10"""


@query
def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.place(table(spark, folder, "documents"), "doc_id", sharding.names())


_SLOTS = sharding.prime_from(sharding.SLOTS_PER_SHARD * sharding.SHARDS)

ORACLE["op6_sharding"] = f"""
WITH RECURSIVE s AS (SELECT i, printf('shard-%04d', i) AS name FROM range({sharding.SHARDS}) r(i)),
h AS (SELECT i, name, CAST('0x' || substr(md5('offset:' || name), 1, 8) AS BIGINT) % {_SLOTS} AS o,
  CAST('0x' || substr(md5('skip:' || name), 1, 8) AS BIGINT) % {_SLOTS - 1} + 1 AS k FROM s),
claims AS (
  SELECT 0 AS turn, CAST(NULL AS BIGINT) AS slot, CAST(NULL AS BIGINT) AS i, list_transform(range({_SLOTS}), lambda x: false) AS used,
    (SELECT list(o ORDER BY i) FROM h) AS o, (SELECT list(k ORDER BY i) FROM h) AS k, list_transform(range({sharding.SHARDS}), lambda x: 0) AS nxt
  UNION ALL
  SELECT turn + 1, slot, i, list_transform(used, lambda u, p: u OR p = slot + 1), o, k, list_transform(nxt, lambda v, p: CASE WHEN p = i + 1 THEN j + 1 ELSE v END)
  FROM (SELECT *, (o[i + 1] + j * k[i + 1]) % {_SLOTS} AS slot FROM (
    SELECT turn, used, o, k, nxt, turn % {sharding.SHARDS} AS i,
      list_filter(range(nxt[turn % {sharding.SHARDS} + 1], {_SLOTS}), lambda j: NOT used[(o[turn % {sharding.SHARDS} + 1] + j * k[turn % {sharding.SHARDS} + 1]) % {_SLOTS} + 1])[1] AS j
    FROM claims WHERE turn < {_SLOTS})))
SELECT d.doc_id, CAST(c.slot AS INTEGER) AS slot, printf('shard-%04d', c.i) AS shard
FROM documents d JOIN claims c ON c.slot = CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % {_SLOTS}
"""


@query
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def mixing_sql(documents: str) -> str:
    """Rows doc_id, size, source, source_size, target, copies, taken of a table, and all its columns but text as they are."""
    return f"""
w AS (SELECT *, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size, coalesce(source, '') AS src, source IS NULL AS nul,
  md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM {documents}),
t AS (SELECT src, nul, CAST(sum(size) AS BIGINT) AS source_size FROM w GROUP BY ALL),
g AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY nul, src) - 1) % 3 + 1] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap,
  1.5::DOUBLE * sum(source_size) OVER () AS budget FROM t),
v AS (SELECT *, cap / weight AS ratio, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, nul, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, nul, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM g),
l AS (SELECT *, max(CASE WHEN ratio > level THEN level END) OVER () AS final FROM v),
q AS (SELECT src, nul, source_size, CASE WHEN final IS NULL THEN cap ELSE least(cap, weight * final) END AS target,
  CAST('0x' || substr(md5('{mixing.SEED}:' || src), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM l),
n AS (SELECT w.*, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  row_number() OVER (PARTITION BY w.src, w.nul ORDER BY size, h, doc_id) AS place FROM w JOIN q ON w.src = q.src AND w.nul = q.nul),
mixing AS (SELECT *, CAST(floor(rate * place + u) - floor(rate * (place - 1) + u) AS BIGINT) AS copies FROM n)"""


ORACLE["op9_mixing"] = f"""WITH {mixing_sql('documents')}
SELECT doc_id, size, source, source_size, target, copies, copies * size AS taken FROM mixing"""


@query
def op10_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.repeated(table(spark, folder, "documents"))


@query
def op11_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repaired(table(spark, folder, "conversations"))


@query
def op12_lexical(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def lexical_sql(documents: str, items: str) -> str:
    terms = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {terms} AS t FROM {documents}),
q AS (SELECT row_number() OVER () AS item, item_id, list_distinct({terms}) AS t FROM {items}),
g AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
s AS (SELECT rid, doc_id, 50 + (50 * len(t) * n_docs) // n_terms AS m FROM d, g WHERE len(t) > 0),
w AS (SELECT item, item_id, unnest(t) AS term FROM q),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM w) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM p GROUP BY term), g),
x AS (SELECT item, rid, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM w JOIN p USING (term) JOIN f USING (term) JOIN s USING (rid) GROUP BY item, rid)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0) WHERE rank <= 50"""


ORACLE["op12_lexical"] = lexical_sql("documents", "benchmark")


@query
def op13_descent(spark: SparkSession, folder: str) -> DataFrame:
    return descent.search(table(spark, folder, "embeddings"))
