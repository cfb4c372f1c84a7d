"""Token, identifier and text-evidence queries over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.functions import scoring, text as tx
from matchloom.plans.registry import View, on_events, on_rounds, query

TOK = """tk AS (SELECT doc_id, unnest(string_split_regex(text, '[ \\n\\t]+')) AS tok, generate_subscripts(string_split_regex(text, '[ \\n\\t]+'), 1) - 1 AS pos FROM documents),
td AS (SELECT *, regexp_replace(tok, '[^0-9]', '', 'g') AS d, (pos % 7) / 10.0 AS conf FROM tk WHERE regexp_matches(tok, '[0-9]'))"""


def tokens(v: View):
    """Digit-bearing tokens of every document with their position."""
    d = v.table("documents").filter(F.col("text").rlike("[0-9]"))
    t = d.select("doc_id", F.posexplode(F.split("text", "[ \n\t]+")).alias("pos", "tok"))
    return t.filter(F.col("tok").rlike("[0-9]")).withColumn("conf", F.col("pos") % 7 / 10)


@query("token_clean_score", "WITH " + TOK + """, s AS (SELECT doc_id, pos, CASE WHEN regexp_matches(d, '^0+$') THEN 0 WHEN regexp_matches(d, '^7[0-9]$') THEN CAST(d[2:2] AS INTEGER) WHEN TRY_CAST(d AS INTEGER) BETWEEN 0 AND 30 THEN TRY_CAST(d AS INTEGER) END AS v FROM td)
SELECT doc_id, arg_min(v, pos) AS score FROM s WHERE v IS NOT NULL GROUP BY doc_id""")
def token_clean_score(v: View):
    d = v.table("documents").filter(F.col("text").rlike("[0-9]"))
    parsed = d.select("doc_id", tx.first_score(F.split("text", "[ \n\t]+")).alias("score"))
    return parsed.filter("score IS NOT NULL")


def best_reading(rows):
    """Last token of the highest confidence per document."""
    return rows.filter("v IS NOT NULL").groupBy("doc_id").agg(F.max_by(F.struct("v", "conf"), F.struct("conf", "pos")).alias("b")).select(
        "doc_id", F.col("b.v").alias("value"), F.round("b.conf", 4).alias("confidence"))


def best_sql(value):
    return "WITH " + TOK + f", s AS (SELECT doc_id, pos, conf, {value} AS v FROM td) SELECT doc_id, arg_max(v, (conf, pos)) AS value, round(max(conf), 4) AS confidence FROM s WHERE v IS NOT NULL GROUP BY doc_id"


@query("token_clean_money", """WITH t AS (SELECT o_orderkey, '$' || (o_orderkey % 800) * 25 || CASE WHEN o_orderkey % 9 = 0 THEN '7' ELSE '' END AS tok FROM orders), d AS (SELECT *, regexp_replace(tok, '[^0-9]', '', 'g') AS d FROM t)
SELECT o_orderkey, CASE WHEN length(d) BETWEEN 1 AND 5 AND NOT regexp_matches(d, '^5[0-9]{2,3}$') AND CAST(d AS BIGINT) <= 16000 AND CAST(d AS BIGINT) % 50 = 0 THEN CAST(d AS INTEGER) END AS money FROM d""")
def token_clean_money(v: View):
    k = F.col("o_orderkey")
    raw = F.concat(F.lit("$"), (k % 800 * 25).cast("string"), F.when(k % 9 == 0, "7").otherwise(""))
    return v.table("orders").select("o_orderkey", tx.money_value(raw).alias("money"))


CLOCK = """CASE WHEN contains(regexp_replace(tok, '[^0-9:]', '', 'g'), ':') THEN CASE WHEN regexp_matches(regexp_replace(tok, '[^0-9:]', '', 'g'), '^[0-9]+:[0-9]+$') THEN
   CASE WHEN TRY_CAST(split_part(regexp_replace(tok, '[^0-9:]', '', 'g'), ':', 1) AS INTEGER) <= 5 AND TRY_CAST(split_part(regexp_replace(tok, '[^0-9:]', '', 'g'), ':', 2) AS INTEGER) < 60
     THEN TRY_CAST(split_part(regexp_replace(tok, '[^0-9:]', '', 'g'), ':', 1) AS INTEGER) * 60 + TRY_CAST(split_part(regexp_replace(tok, '[^0-9:]', '', 'g'), ':', 2) AS INTEGER) END END
 WHEN length(d) IN (3, 4) AND CAST(d[1:1] AS INTEGER) <= 5 AND CAST(right(d, 2) AS INTEGER) < 60 THEN CAST(d[1:1] AS INTEGER) * 60 + CAST(right(d, 2) AS INTEGER) END"""


@query("token_clean_clock", best_sql(CLOCK))
def token_clean_clock(v: View):
    return best_reading(tokens(v).withColumn("v", tx.clock_value(F.col("tok"))))


@query("token_clean_armour", best_sql("CASE WHEN contains(d, '100') THEN 100 WHEN length(d) IN (2, 3) AND CAST(right(d, 2) AS INTEGER) BETWEEN 10 AND 99 THEN CAST(right(d, 2) AS INTEGER) WHEN conf >= .4 AND TRY_CAST(d AS INTEGER) BETWEEN 0 AND 100 THEN TRY_CAST(d AS INTEGER) END"))
def token_clean_armour(v: View):
    return best_reading(tokens(v).withColumn("v", tx.armour_value(F.col("tok"), F.col("conf"))))


@query("name_match", """WITH n AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
w AS (SELECT conv_id, turn, regexp_replace(lower(regexp_extract(p, '^[^ ]+')), '[^\\p{L}\\p{N}]', '', 'g') AS a, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS b FROM n WHERE p IS NOT NULL)
SELECT conv_id, turn, contains(b, a) OR contains(a, b) AS named FROM w""")
def name_match(v: View):
    from matchloom.operators.scan import block_of, scan
    n = scan(v.table("conversations"), ["conv_id"], ["turn"], block_of("turn", 1000), prev={"p": F.col("text")})
    first = F.regexp_extract("p", "^[^ ]+", 0)
    return n.filter("p IS NOT NULL").select("conv_id", "turn", tx.names_match(first, F.col("text")).alias("named"))


@query("stable_ids", """SELECT doc_id, 'doc_' || substr(sha256(lang || chr(10) || text), 1, 20) AS document_id,
 'chunk_' || substr(sha256(CASE WHEN doc_id % 2 = 0 THEN 'k' || doc_id || ':3' ELSE 'd' || doc_id || ':3:' || text END), 1, 20) AS chunk_id FROM documents""")
def stable_ids(v: View):
    d, i = v.table("documents"), F.col("doc_id").cast("string")
    key = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("k"), i))
    return d.select("doc_id", tx.stable_id(F.col("lang"), F.col("text")).alias("document_id"),
                    tx.chunk_id(key, F.concat(F.lit("d"), i), F.lit(3), F.col("text")).alias("chunk_id"))


@query("titles", """SELECT doc_id, coalesce(substr(list_filter(list_transform(string_split_regex(text, '\\r\\n|\\n|\\r'), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '^#+', ''), '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1], 1, 160), source) AS title FROM documents""")
def titles(v: View):
    return v.table("documents").select("doc_id", tx.title_of(F.col("text"), F.col("source")).alias("title"))


@query("inline_meta", """WITH dd AS (SELECT doc_id, regexp_replace(text, '(?m)^([A-Za-z_]+) ', '\\1: ', 'g') AS text FROM documents), l AS (SELECT doc_id, unnest(string_split_regex(text, '\\r\\n|\\n|\\r')) AS line, generate_subscripts(string_split_regex(text, '\\r\\n|\\n|\\r'), 1) AS pos FROM dd),
m AS (SELECT doc_id, pos, lower(regexp_extract(line, '^\\s*([A-Za-z_]+)\\s*[:=]\\s*(\\S.*)$', 1)) AS key, regexp_replace(regexp_extract(line, '^\\s*([A-Za-z_]+)\\s*[:=]\\s*(\\S.*)$', 2), '\\s+$', '') AS value FROM l WHERE regexp_matches(line, '^\\s*[A-Za-z_]+\\s*[:=]\\s*\\S'))
SELECT doc_id, key, arg_max(value, pos) AS value FROM m GROUP BY doc_id, key""")
def inline_meta(v: View):
    """``key: value`` lines (here also ``key = value``); the last one of a key wins."""
    from matchloom.operators.knowledge import inline_metadata
    keyed = v.table("documents").withColumn("text", F.regexp_replace("text", r"(?m)^([A-Za-z_]+) ", "$1: "))
    return inline_metadata(keyed, "doc_id", "text", marks=":=")


@query("truthiness", "SELECT vec_id, lower(trim(CASE vec_id % 6 WHEN 0 THEN 'TRUE ' WHEN 1 THEN 'yes' WHEN 2 THEN '1' WHEN 3 THEN 'no' WHEN 4 THEN '' END)) IN ('true','yes','1') IS TRUE AS flag FROM embeddings")
def truthiness(v: View):
    k = F.col("vec_id") % 6
    raw = F.when(k == 0, "TRUE ").when(k == 1, "yes").when(k == 2, "1").when(k == 3, "no").when(k == 4, "")
    return v.table("embeddings").select("vec_id", tx.truthy(raw).alias("flag"))


@query("exceptions_split", """SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(replace(text, '. ', ' ; '), '[;；]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), '|') AS items FROM documents""")
def exceptions_split(v: View):
    raw = F.replace(F.col("text"), F.lit(". "), F.lit(" ; "))
    return v.table("documents").select("doc_id", F.array_join(tx.split_exceptions(raw), "|").alias("items"))


@query("fenced_json", """SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(regexp_extract(props, '[0-9]+') AS INTEGER) END AS k FROM events""")
def fenced_json(v: View):
    p, n = F.col("props"), F.col("event_id") % 4
    raw = F.when(n == 0, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(n == 1, p).when(n == 2, F.concat(F.lit("```\n"), p, F.lit("\n```\n"))).otherwise(
        F.concat(F.lit("["), p, F.lit("]")))
    return v.table("events").select("event_id", F.try_variant_get(tx.fenced_json(raw), "$.k", "int").alias("k"))


@query("lang_evidence", """SELECT conv_id, turn, length(regexp_replace(text, '[^\\x{4E00}-\\x{9FFF}]', '', 'g')) AS han, length(regexp_replace(lower(text), '[^a-z]', '', 'g')) AS latin,
 length(regexp_replace(lower(text), '[^a-z]', '', 'g')) >= 12 AS english FROM conversations""")
def lang_evidence(v: View):
    t = F.col("text")
    return v.table("conversations").select("conv_id", "turn", tx.han_count(t).alias("han"), tx.latin_count(t).alias("latin"), (tx.latin_count(t) >= 12).alias("english"))


@query("term_gate", """SELECT doc_id, contains(lower(text), 'onen') OR contains(lower(text), 'token') OR contains(lower(text), 'immer') AS hit FROM documents""")
def term_gate(v: View):
    return v.table("documents").select("doc_id", tx.has_any(F.col("text"), ("onen", "token", "immer")).alias("hit"))


@query("manual_ids", on_rounds("""SELECT video_id, seq, 'manual_' || type || '_' || rid || '_' || lpad(CAST(CAST(round_even(k / 7.0 * 1000, 0) AS BIGINT) AS VARCHAR), 9, '0') AS event_id FROM a"""))
def manual_ids(v: View):
    return v.attached().select("video_id", "seq", tx.manual_id(F.col("type"), F.col("rid"), F.col("k") / 7).alias("event_id"))


@query("fourcc", """WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN -1 ELSE (65 + p_size % 26) + (65 + p_partkey % 26) * 256 + (48 + p_size % 10) * 65536 + 32 * 16777216 END AS code, p_size FROM part)
SELECT p_partkey, CASE WHEN code > 0 THEN rtrim(chr(CAST(65 + p_size % 26 AS INTEGER)) || chr(CAST(65 + p_partkey % 26 AS INTEGER)) || chr(CAST(48 + p_size % 10 AS INTEGER)) || ' ') END AS codec FROM c""")
def fourcc(v: View):
    k, s = F.col("p_partkey"), F.col("p_size")
    code = F.when(k % 10 == 0, F.lit(-1).cast("long")).otherwise((65 + s % 26) + (65 + k % 26) * 256 + (48 + s % 10) * 65536 + F.lit(32 * 16777216).cast("long"))
    return v.table("part").select("p_partkey", scoring.fourcc(code).alias("codec"))


@query("query_terms", on_events("""
, c AS (SELECT video_id, seq, CASE k % 3 WHEN 0 THEN 't' WHEN 1 THEN 'ct' END AS side, CASE WHEN k % 4 > 0 THEN k % 4 END AS mates, CASE WHEN k % 5 > 0 THEN k % 5 END AS enemies, CASE WHEN k % 6 = 0 THEN 'planted' END AS bomb, CASE WHEN k % 2 = 0 THEN 'rifle' END AS weapon, CASE WHEN k % 7 > 2 THEN k END AS tm, CASE WHEN k % 8 = 0 THEN k * 50 END AS money FROM m)
SELECT video_id, seq, concat_ws(' | ', 'side=' || side, CASE WHEN mates IS NOT NULL AND enemies IS NOT NULL THEN 'situation=' || mates || 'v' || enemies END, 'bomb_state=' || bomb, 'weapon=' || weapon, 'time_remaining=' || tm || '.0s', 'money=' || money) AS terms FROM c""".replace("\n, c", ", c", 1)))
def query_terms(v: View):
    k = F.col("k")
    none = F.lit(None).cast("string")
    c = {"side": F.when(k % 3 == 0, "t").when(k % 3 == 1, "ct"), "mates": F.when(k % 4 > 0, k % 4), "enemies": F.when(k % 5 > 0, k % 5), "bomb": F.when(k % 6 == 0, "planted"),
         "weapon": F.when(k % 2 == 0, "rifle"), "time": F.when(k % 7 > 2, k), "money": F.when(k % 8 == 0, k * 50), "utility": none, "map": none, "position": none}
    return v.m.select("video_id", "seq", tx.query_terms(c).alias("terms"))


FRESH = """fr AS (SELECT o_orderkey, o_orderkey % 3 = 0 AS vs, CASE o_orderkey % 11 WHEN 0 THEN 'unknown' WHEN 1 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS verified, CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate + INTERVAL 200 DAY, '%Y-%m-%d') WHEN o_orderkey % 13 = 0 THEN 'soon' END AS expires, o_orderkey % 7 <> 0 AS urls FROM orders)"""


@query("freshness", "WITH " + FRESH + """ SELECT o_orderkey, NOT vs OR coalesce(urls AND TRY_CAST(verified AS DATE) IS NOT NULL AND NOT (expires IS NOT NULL AND TRY_CAST(expires AS DATE) IS NULL) AND DATE '2001-01-01' - TRY_CAST(verified AS DATE) <= 365
 AND (TRY_CAST(expires AS DATE) IS NULL OR DATE '2001-01-01' <= TRY_CAST(expires AS DATE)), false) AS usable FROM fr""")
def freshness(v: View):
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    verified = F.when(k % 11 == 0, "unknown").when(k % 11 != 1, F.date_format(day, "yyyy-MM-dd"))
    expires = F.when(k % 4 == 0, F.date_format(F.date_add(day, 200), "yyyy-MM-dd")).when(k % 13 == 0, "soon")
    return v.table("orders").select("o_orderkey", tx.is_fresh(k % 3 == 0, verified, expires, k % 7 != 0, F.to_date(F.lit("2001-01-01"))).alias("usable"))
