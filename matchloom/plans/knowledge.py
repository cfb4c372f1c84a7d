"""Chunk, layer, index and vector retrieval queries."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import functions as F

from matchloom.functions import scoring, text as tx
from matchloom.operators import knowledge as kn
from matchloom.operators.blocks import durable, durable_folder
from matchloom.plans.context import on_context, round_context_of
from matchloom.plans.registry import View, on_rounds, query

VOCABULARY = ("the", "tion", "er", "en", "ou", "le", "ung", "ción")  # fixed values


def docs(v: View):
    return v.spread("documents").select(F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("content"))


@query("chunk_fixed", """
SELECT CAST(doc_id AS VARCHAR) AS document_id, i AS chunk_index, sha256(substring(text, CAST(i * 780 + 1 AS INTEGER), 900)) AS digest
FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(greatest(0, length(text) - 900) / 780.0) AS BIGINT) + 1)) AS i FROM documents)""")
def chunk_fixed(v: View):
    return kn.fixed_chunks(docs(v)).select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.sha2("content", 256).alias("digest"))


def structured(v: View):
    return kn.chunk_documents(docs(v), sep="\n")


@query("chunk_struct")
def chunk_struct(v: View):
    c = structured(v)
    return c.withColumn("chunk_id", tx.chunk_id(F.lit(None).cast("string"), F.col("document_id"), F.col("chunk_index"), F.col("content")))


LAYER = """ly AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 100 AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN '. Part' ELSE '.1 Part' END END AS heading,
  lower(text) || CASE doc_id % 7 WHEN 1 THEN ' retake' WHEN 2 THEN ' defuse' WHEN 3 THEN ' 价格' WHEN 4 THEN ' loss bonus clutch' ELSE '' END AS body FROM documents),
l1 AS (SELECT *, TRY_CAST(regexp_extract(coalesce(heading, ''), '^(\\d+)([.)]|\\.\\d+)', 1) AS INTEGER) AS sec, concat_ws(chr(10), lower(heading), body) AS w FROM ly),
l2 AS (SELECT doc_id, CASE WHEN sec BETWEEN 1 AND 5 THEN 'game_rules' WHEN sec BETWEEN 36 AND 40 OR sec = 48 THEN 'dynamic_game_data' WHEN sec BETWEEN 49 AND 85 OR sec = 96 THEN 'situation_decisions' WHEN sec IS NOT NULL THEN 'tactical_fundamentals'
  WHEN {d} THEN 'dynamic_game_data' WHEN {s} THEN 'situation_decisions' WHEN {r} THEN 'game_rules' ELSE 'tactical_fundamentals' END AS inferred FROM l1)"""


def any_sql(terms, col="w"):
    return "(" + " OR ".join(f"contains({col}, '{t}')" for t in terms) + ")"


LAYER = LAYER.replace("{d}", any_sql(kn.DYNAMIC_TERMS)).replace("{s}", any_sql(kn.SITUATION_TERMS)).replace("{r}", any_sql(kn.RULE_TERMS))


def layered(v: View):
    i = F.col("doc_id")
    heading = F.when(i % 3 == 0, F.concat((i % 100).cast("string"), F.when(i % 2 == 0, ". Part").otherwise(".1 Part")))
    n = i % 7
    tail = F.when(n == 1, " retake").when(n == 2, " defuse").when(n == 3, " 价格").when(n == 4, " loss bonus clutch").otherwise("")
    d = v.spread("documents").select("doc_id", kn.infer_layer(heading, F.concat(F.lower("text"), tail)).alias("inferred"))
    explicit = F.when(i % 11 == 0, "game_rules").when(i % 13 == 0, "not_a_layer")
    sensitive = F.when(i % 17 == 0, "Yes").when(i % 19 == 0, "false")
    strength = F.when(i % 5 == 0, "strategic_principle").when(i % 23 == 0, "bogus")
    return kn.annotate(d, F.col("inferred"), explicit, sensitive, strength)


LAYER2 = LAYER + """, l3 AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'game_rules' ELSE inferred END AS base FROM l2),
l4 AS (SELECT *, doc_id % 17 = 0 OR base = 'dynamic_game_data' AS flag FROM l3),
l5 AS (SELECT doc_id, inferred, CASE WHEN flag THEN 'dynamic_game_data' ELSE base END AS layer, CASE WHEN flag THEN 'hard_rule' WHEN doc_id % 5 = 0 THEN 'strategic_principle' WHEN base IN ('game_rules','dynamic_game_data') THEN 'hard_rule'
  WHEN base = 'situation_decisions' THEN 'contextual_recommendation' ELSE 'strategic_principle' END AS rule_strength, flag AS version_sensitive FROM l4)"""


@query("layer_infer", "WITH " + LAYER2 + " SELECT doc_id, inferred, layer, rule_strength, version_sensitive FROM l5")
def layer_infer(v: View):
    return layered(v)


@query("layer_counts", "WITH " + LAYER2 + " SELECT layer, count(*) AS n FROM l5 GROUP BY layer")
def layer_counts(v: View):
    return kn.counts_by_layer(layered(v))


@query("fact_documents", """SELECT p_partkey, sha256('# ' || p_name || chr(10) || chr(10) || p_brand || chr(10) || chr(10) || p_type || CASE WHEN p_size % 2 = 0 THEN chr(10) || chr(10) || 'Note: size ' || p_size ELSE '' END) AS digest FROM part""")
def fact_documents(v: View):
    notes = F.when(F.col("p_size") % 2 == 0, F.array(F.concat(F.lit("size "), F.col("p_size").cast("string")))).otherwise(F.array().cast("array<string>"))
    doc = kn.fact_document(F.col("p_name"), F.array("p_brand", "p_type"), notes)
    return v.table("part").select("p_partkey", F.sha2(doc, 256).alias("digest"))


FACTS = """fd AS (SELECT doc_id, lang, source, o_orderstatus AS st, o_orderpriority AS pr, o_custkey AS cu, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS seen, url,
  text || CASE WHEN o_orderstatus IN ('F', 'P') THEN chr(10) || 'last_verified: ' || strftime(o_orderdate, '%Y-%m-%d') ELSE '' END || CASE WHEN o_orderstatus = 'O' THEN chr(10) || ' Effective_From :' || strftime(o_orderdate, '%Y-%m-%d') || ' ' ELSE '' END
   || CASE WHEN o_custkey % 2 = 0 THEN chr(10) || 'exceptions: ' || lang || '; ; ' || source ELSE '' END AS content
  FROM documents LEFT JOIN orders ON o_orderkey = doc_id LEFT JOIN pages ON page_id = doc_id)"""


def facts(v: View):
    """Documents with a metadata map and ``name: value`` lines, both from the order and the page of the same number."""
    d = v.spread("documents").join(v.table("orders"), F.col("doc_id") == F.col("o_orderkey"), "left")
    d = d.join(v.table("pages").select("page_id", "url"), F.col("doc_id") == F.col("page_id"), "left")
    day, status, rank, cust = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1), F.col("o_custkey")
    line = lambda when, *parts: F.coalesce(F.when(when, F.concat(F.lit("\n"), *parts)), F.lit(""))
    content = F.concat(
        "text", line(status.isin("F", "P"), F.lit("last_verified: "), day), line(status == "O", F.lit(" Effective_From :"), day, F.lit(" ")),
        line(cust % 2 == 0, F.lit("exceptions: "), F.col("lang"), F.lit("; ; "), F.col("source")))
    given = {
        "last_verified": F.when(rank == "1", F.date_format(F.date_add("o_orderdate", 30), "yyyy-MM-dd")).when(rank == "2", ""),
        "expires_at": F.when(rank == "2", day), "source_urls": F.col("url"), "exceptions": F.when(cust % 5 == 0, F.concat(F.lit("order； "), F.col("o_orderpriority"))),
        "version_sensitive": F.when(rank == "3", "Yes").when(rank == "4", "no"),
        "knowledge_layer": F.when(cust % 7 == 0, kn.RULES).when(cust % 7 == 1, kn.SITUATIONS).when(cust % 7 == 2, "unknown")}
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), e.alias("v")) for k, e in given.items()]), lambda x: x["v"].isNotNull())
    return d.select("doc_id", F.col("doc_id").cast("string").alias("document_id"), content.alias("content"), F.map_from_entries(entries).alias("metadata"))


@query("metadata_fanout", "WITH " + FACTS + """SELECT doc_id, coalesce(CASE WHEN pr LIKE '1%' THEN seen END, CASE WHEN st IN ('F', 'P') THEN day END) AS last_verified, CASE WHEN st = 'O' THEN day END AS effective_from,
 CASE WHEN pr LIKE '2%' THEN day END AS expires_at, coalesce(url, '') AS urls, CASE WHEN cu % 5 = 0 THEN 'order|' || pr WHEN cu % 2 = 0 THEN lang || '|' || source ELSE '' END AS exceptions FROM fd""")
def metadata_fanout(v: View):
    """Dates, URLs and exceptions: metadata first, lines of the text second, empty values absent."""
    out = kn.fan_out(facts(v), F.col("metadata"), F.col("content"))
    return out.select("doc_id", "last_verified", "effective_from", "expires_at", F.array_join("source_urls", "|").alias("urls"), F.array_join("exceptions", "|").alias("exceptions"))


@query("normalised_vectors", """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN list_transform(embedding, lambda x: 0::DOUBLE) ELSE list_transform(embedding, lambda x: x::DOUBLE * 3) END AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM e) SELECT vec_id, round(CASE WHEN n > 0 THEN v[1] / n ELSE v[1] END, 4) AS first_value, round(CASE WHEN n > 0 THEN 1 ELSE 0 END, 4) AS norm FROM n""")
def normalised_vectors(v: View):
    raw = F.when(F.col("vec_id") % 10 == 0, F.transform("embedding", lambda x: F.lit(0.0))).otherwise(F.transform("embedding", lambda x: x.cast("double") * 3))
    n = kn.normalised(v.table("embeddings"), raw, "u")
    norm = F.sqrt(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x))
    return n.select("vec_id", F.round(F.col("u")[0], 4).alias("first_value"), F.round(norm, 4).alias("norm"))


@query("term_embedding", "WITH c AS (SELECT doc_id, [" + ", ".join(f"(length(lower(text)) - length(replace(lower(text), '{t}', ''))) / {len(t)}.0" for t in VOCABULARY) + "]::DOUBLE[] AS v FROM documents), n AS (SELECT doc_id, v, sqrt(list_inner_product(v, v)) AS n FROM c) SELECT doc_id, round(CASE WHEN n > 0 THEN v[1] / n ELSE 0 END, 4) AS x0, round(CASE WHEN n > 0 THEN v[3] / n ELSE 0 END, 4) AS x2 FROM n")
def term_embedding(v: View):
    d = kn.embed_terms(v.spread("documents").select("doc_id", "text"), "text", VOCABULARY, "u")
    return d.select("doc_id", F.round(F.col("u")[0], 4).alias("x0"), F.round(F.col("u")[2], 4).alias("x2"))


@query("index_upsert", """WITH ex AS (SELECT doc_id, 'old_' || source AS body FROM documents WHERE doc_id % 2 = 0), inc AS (SELECT doc_id, 'new_' || lang AS body FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id, coalesce(inc.body, ex.body) AS body FROM ex FULL OUTER JOIN inc USING (doc_id)""")
def index_upsert(v: View):
    d = v.table("documents")
    old = d.filter("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("old_"), "source").alias("body"))
    new = d.filter("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("new_"), "lang").alias("body"))
    return kn.upsert(old, new, "doc_id", F.col("doc_id"))


@query("index_build", "WITH " + FACTS + """, ch AS (SELECT doc_id, pr, cu, lower(substring(content, CAST(i * 780 + 1 AS INTEGER), 900)) AS w FROM (SELECT *, unnest(range(0, CAST(ceil(greatest(0, length(content) - 900) / 780.0) AS BIGINT) + 1)) AS i FROM fd)),
b AS (SELECT doc_id, pr, CASE WHEN cu % 7 = 0 THEN 'game_rules' WHEN cu % 7 = 1 THEN 'situation_decisions' WHEN {d} THEN 'dynamic_game_data' WHEN {s} THEN 'situation_decisions' WHEN {r} THEN 'game_rules' ELSE 'tactical_fundamentals' END AS base FROM ch),
l AS (SELECT doc_id, CASE WHEN pr LIKE '3%' THEN 'dynamic_game_data' ELSE base END AS layer FROM b)
SELECT layer, count(*) AS n, count(DISTINCT doc_id) AS documents FROM l GROUP BY layer""".replace("{d}", any_sql(kn.DYNAMIC_TERMS)).replace("{s}", any_sql(kn.SITUATION_TERMS)).replace("{r}", any_sql(kn.RULE_TERMS)))
def index_build(v: View):
    """Documents to chunks to annotated, embedded rows, written to an index in two batches and read back."""
    from matchloom.sources import sinks
    # not written on the way: the second batch makes its chunks again, which is less than a copy of all chunks
    rows = kn.index_rows(facts(v).select("document_id", "content", "metadata"), VOCABULARY, partial(kn.fixed_chunks, keep=["metadata"]))
    path = f"{durable_folder(v.spark)}/index-{uuid.uuid4().hex}"
    sinks.write_index(rows, path, writer="build", batch=0)
    sinks.write_index(rows.filter("chunk_index = 0"), path, writer="build", batch=1)
    return sinks.read_index(v.spark, path).groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("document_id").alias("documents"))


# -- vector retrieval: chunks are the embeddings, layer by label, queries every 50th vector

VEC = """qv AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 50 = 0),
cv AS (SELECT vec_id AS chunk_id, CASE label % 4 WHEN 0 THEN 'game_rules' WHEN 1 THEN 'tactical_fundamentals' WHEN 2 THEN 'situation_decisions' ELSE 'dynamic_game_data' END AS layer, embedding::DOUBLE[] AS v, label FROM embeddings),
sc AS (SELECT query_id, chunk_id, layer, list_cosine_similarity(qv.v, cv.v) AS score FROM qv, cv),
lr AS (SELECT *, row_number() OVER (PARTITION BY query_id, layer ORDER BY score DESC, chunk_id) AS rank FROM sc)"""


def layer_col():
    l = F.col("label") % 4
    return F.when(l == 0, kn.RULES).when(l == 1, kn.TACTICS).when(l == 2, kn.SITUATIONS).otherwise(kn.DYNAMIC)


def hits_of(v: View, k: int):
    e = v.table("embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    c = e.select(F.col("vec_id").alias("chunk_id"), layer_col().alias("layer"), F.col("embedding").alias("vector"))
    return kn.layer_topk(q, c, k)


@query("cosine_topk", "WITH " + VEC + """ SELECT query_id, chunk_id, round(score, 4) AS score, rank FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc) WHERE rank <= 5""")
def cosine_topk(v: View):
    e = v.table("embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    c = e.select(F.col("vec_id").alias("chunk_id"), F.lit("all").alias("layer"), F.col("embedding").alias("vector"))
    return kn.layer_topk(q, c, 5).select("query_id", "chunk_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("layered_topk", "WITH " + VEC + """ SELECT query_id, chunk_id, layer, rank FROM (SELECT query_id, chunk_id, layer, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM lr WHERE rank <= 5 AND layer <> 'dynamic_game_data') WHERE rank <= 5""")
def layered_topk(v: View):
    h = hits_of(v, 5).filter(F.col("layer") != kn.DYNAMIC)
    return kn.topk(h, 5).select("query_id", "chunk_id", "layer", F.col("rank").cast("long").alias("rank"))


@query("score_filter", "WITH " + VEC + """ SELECT query_id, chunk_id FROM (SELECT query_id, chunk_id, layer, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM lr WHERE rank <= 6) WHERE rank <= 6 AND greatest(-1, least(1, score)) >= .15 AND (layer <> 'dynamic_game_data' OR (chunk_id % 5 <> 0 AND chunk_id % 3 <> 0))""")
def score_filter(v: View):
    h = kn.topk(hits_of(v, 6), 6)
    c = F.col("chunk_id")
    verified = F.when(c % 3 == 0, "2020-01-01").otherwise("2025-06-01")
    fresh = tx.is_fresh(F.col("layer") == kn.DYNAMIC, verified, F.lit(None).cast("string"), c % 5 != 0, F.to_date(F.lit("2026-01-01")))
    return h.filter((scoring.clip_score(1 - F.col("score")) >= .15) & fresh).select("query_id", "chunk_id")


ROUTES = """rt0 AS (SELECT vec_id AS query_id, CASE vec_id % 300 WHEN 0 THEN 'clutch with low time' WHEN 50 THEN 'buy cost' WHEN 100 THEN 'bomb timer mechanic' WHEN 150 THEN 'retake price' ELSE 'aim' END AS text, vec_id % 200 = 0 AS ctx, vec_id % 350 = 0 AS money FROM embeddings WHERE vec_id % 50 = 0),
rt1 AS (SELECT *, ctx OR {s} AS sit, money OR {d} AS dyn, {r} AS rul FROM rt0),
rt AS (SELECT query_id, list_distinct_ordered FROM (SELECT query_id, list_filter([CASE WHEN sit THEN 'situation_decisions' END, CASE WHEN dyn THEN 'dynamic_game_data' END, 'tactical_fundamentals', CASE WHEN rul OR NOT sit THEN 'game_rules' END, CASE WHEN NOT sit THEN 'situation_decisions' END], lambda x: x IS NOT NULL) AS list_distinct_ordered FROM rt1))""".replace(
    "{s}", any_sql(kn.ROUTE_SITUATION, "text")).replace("{d}", any_sql(kn.ROUTE_DYNAMIC, "text")).replace("{r}", any_sql(kn.ROUTE_RULE, "text"))


def routes_of(v: View):
    i = F.col("vec_id")
    m = i % 300
    text = F.when(m == 0, "clutch with low time").when(m == 50, "buy cost").when(m == 100, "bomb timer mechanic").when(m == 150, "retake price").otherwise("aim")
    return v.table("embeddings").filter(i % 50 == 0).select(i.alias("query_id"), kn.route(text, i % 200 == 0, i % 350 == 0).alias("layers"))


@query("query_routing", "WITH " + ROUTES + " SELECT query_id, array_to_string(list_distinct_ordered, ',') AS layers FROM rt")
def query_routing(v: View):
    return routes_of(v).withColumn("layers", F.array_join("layers", ","))


@query("decision_topk", "WITH " + VEC + ", " + ROUTES + """, h AS (SELECT lr.*, list_position(list_distinct_ordered, layer) - 1 AS priority, score >= .15 AND (layer <> 'dynamic_game_data' OR chunk_id % 4 <> 0) AS ok FROM lr JOIN rt USING (query_id) WHERE rank <= 16 AND list_position(list_distinct_ordered, layer) IS NOT NULL),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, layer ORDER BY rank) AS fr FROM h WHERE rank <= 4 AND priority < 4 AND ok) WHERE fr = 1),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS pr FROM h) WHERE pr <= 16 AND ok),
u AS (SELECT query_id, chunk_id, score, priority FROM f UNION ALL SELECT query_id, chunk_id, score, priority FROM (SELECT p.*, row_number() OVER (PARTITION BY p.query_id ORDER BY score DESC, chunk_id) AS ur FROM p WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.query_id = p.query_id AND f.chunk_id = p.chunk_id)) q
  WHERE ur <= 4 - coalesce((SELECT count(*) FROM f WHERE f.query_id = q.query_id), 0))
SELECT query_id, chunk_id, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY priority, score DESC, chunk_id) AS position FROM u) WHERE position <= 4""")
def decision_topk(v: View):
    h = durable(hits_of(v, 16).withColumn("usable", (F.col("layer") != kn.DYNAMIC) | (F.col("chunk_id") % 4 != 0)))
    out = kn.retrieve_for_decision(h, routes_of(v))
    return out.select("query_id", "chunk_id", F.col("position").cast("long").alias("position"))


MERGE = """c1 AS (SELECT query_id, chunk_id, score FROM lr WHERE rank <= 3), c2 AS (SELECT query_id, chunk_id, score * .9 AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS g FROM sc) WHERE g <= 6),
mg AS (SELECT query_id, chunk_id, max(score) AS score FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c2) GROUP BY ALL)"""


def two_calls(v: View):
    h = durable(hits_of(v, 6))
    first = h.filter("rank <= 3").select("query_id", "chunk_id", "score")
    second = kn.topk(h, 6).select("query_id", "chunk_id", (F.col("score") * .9).alias("score"))
    return first.unionByName(second)


@query("hit_merge", "WITH " + VEC + ", " + MERGE + " SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM mg) WHERE rank <= 8")
def hit_merge(v: View):
    return kn.merge_hits(two_calls(v)).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query("unique_hits", "WITH " + VEC + ", " + MERGE + """, um AS (SELECT query_id % 100 AS match_id, chunk_id, max(score) AS score FROM mg WHERE query_id <> chunk_id GROUP BY ALL) SELECT match_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY score DESC, chunk_id) AS rank FROM um) WHERE rank <= 10""")
def unique_hits(v: View):
    h = two_calls(v).filter("query_id <> chunk_id").withColumn("match_id", F.col("query_id") % 100)
    return kn.unique_hits(h, "match_id").select("match_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query("retrieval_metrics", "WITH " + VEC + """, g AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc WHERE query_id <> chunk_id),
f AS (SELECT g.query_id, min(rank) AS r FROM g JOIN cv USING (chunk_id) JOIN qv ON qv.query_id = g.query_id WHERE rank <= 5 AND cv.label = qv.label GROUP BY 1)
SELECT count(*) AS cases, round(avg(CASE WHEN r IS NOT NULL THEN 1.0 ELSE 0 END), 4) AS recall_at_k, round(avg(coalesce(1.0 / r, 0)), 4) AS mrr FROM qv LEFT JOIN f USING (query_id)""")
def retrieval_metrics(v: View):
    e = v.table("embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("want"))
    c = e.select(F.col("vec_id").alias("chunk_id"), F.lit("all").alias("layer"), F.col("embedding").alias("vector"))
    near = kn.layer_topk(q, c, 6).filter("query_id <> chunk_id").drop("rank")
    near = kn.topk(near, 5).join(e.select(F.col("vec_id").alias("chunk_id"), "label"), "chunk_id").join(q.select("query_id", "want"), "query_id")
    m = kn.retrieval_metrics(near, q, F.col("label") == F.col("want"))
    return m.select("cases", F.round("recall_at_k", 4).alias("recall_at_k"), F.round("mrr", 4).alias("mrr"))


@query("decision_context", on_context("""SELECT cxt.*, bomb_state FROM cxt JOIN bomb USING (video_id, rid)""", """bomb AS (
SELECT video_id, rid, CASE WHEN count(*) FILTER (type = 'player_kill' AND k % 17 = 0) > 0 THEN 'defused' WHEN count(*) FILTER (type = 'player_kill' AND k % 5 = 0) > 0 THEN 'planted' END AS bomb_state FROM a GROUP BY 1, 2)"""))
def decision_context(v: View):
    kill = F.col("type") == "player_kill"
    g = v.attached().groupBy("video_id", "rid").agg(F.count_if(kill & (F.col("k") % 17 == 0)).alias("d"), F.count_if(kill & (F.col("k") % 5 == 0)).alias("p"))
    g = g.select("video_id", "rid", F.when(F.col("d") > 0, "defused").when(F.col("p") > 0, "planted").alias("bomb_state"))
    return round_context_of(v).join(g, ["video_id", "rid"])


@query("suggestion_query_text", on_rounds("""
SELECT video_id, rid, concat_ws(' | ', 'positioning', 'deaths ' || deaths, 'review', CASE WHEN video_id % 2 = 0 THEN 'side t' END, CASE WHEN rid % 3 = 0 THEN 'weapon rifle sniper' END, 'map mirage') AS text FROM stt0 WHERE deaths > 0""",
    __import__("matchloom.plans.reports", fromlist=["ST"]).ST))
def suggestion_query_text(v: View):
    from matchloom.operators.guard import query_text
    from matchloom.plans.reports import stats_of
    s = stats_of(v).filter("deaths > 0").select(
        "video_id", "rid", F.lit("positioning").alias("category"), F.concat(F.lit("deaths "), F.col("deaths").cast("string")).alias("reasoning"), F.lit("review").alias("action"),
        F.when(F.col("video_id") % 2 == 0, "t").alias("player_side"), F.when(F.col("rid") % 3 == 0, F.array(F.lit("rifle"), F.lit("sniper"))).alias("weapons"),
        F.lit("mirage").alias("map_name"), F.lit(None).cast("string").alias("map_position"), F.lit(None).cast("array<string>").alias("utility"))
    return s.select("video_id", "rid", query_text().alias("text"))
