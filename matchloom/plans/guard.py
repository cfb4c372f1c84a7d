"""Draft gates, call-log audit and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.operators import evaluation as ev
from matchloom.operators import guard as gd
from matchloom.operators.scan import block_of, scan
from matchloom.plans.knowledge import any_sql
from matchloom.plans.registry import View, query

PAIR = """pr AS (SELECT doc_id, text, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS src FROM documents)"""
NUM = "list_distinct(regexp_extract_all({0}, '(^|[^\\p{{L}}\\p{{N}}_.])(\\d+(?:\\.\\d+)?)', 2))"


def pairs(v: View):
    """Each document with the previous one of its source."""
    d = v.table("documents").select("doc_id", "text", "source")
    return scan(d, ["source"], ["doc_id"], block_of("doc_id", 100_000), prev={"src": F.col("text")}).filter("src IS NOT NULL")


@query("unsupported_numbers", "WITH " + PAIR + f" SELECT doc_id, len(list_filter({NUM.format('text')}, lambda n: NOT list_contains({NUM.format('src')}, n))) > 0 AS unsupported FROM pr WHERE src IS NOT NULL")
def unsupported_numbers(v: View):
    return pairs(v).select("doc_id", gd.unsupported_numbers(F.col("text"), F.col("src")).alias("unsupported"))


GT = "lower(text || CASE conv_id % 9 WHEN 0 THEN ' You were too late.' WHEN 1 THEN ' You must hold' WHEN 2 THEN ' because you won the fight it was a good decision' WHEN 3 THEN ' 一定' WHEN 4 THEN ' The result proves you right' ELSE '' END)"


def gated(v: View):
    n = F.col("conv_id") % 9
    extra = F.when(n == 0, " You were too late.").when(n == 1, " You must hold").when(n == 2, " because you won the fight it was a good decision").when(
        n == 3, " 一定").when(n == 4, " The result proves you right").otherwise("")
    return v.table("conversations").withColumn("g", F.concat("text", extra))


@query("context_gate", f"SELECT conv_id, turn, NOT (conv_id % 3 <> 0 AND turn % 4 <> 1 AND conv_id % 5 <> 0 AND turn % 3 <> 1) AND {any_sql(gd.PACE_TERMS, GT)} AS broken FROM conversations")
def context_gate(v: View):
    c, t = F.col("conv_id"), F.col("turn")
    known = gd.context_known(F.when(c % 3 != 0, "mirage"), F.when(t % 4 != 1, "t"), F.when(c % 5 != 0, "shop"), F.when(t % 3 != 1, 90))
    return gated(v).select("conv_id", "turn", gd.breaks_context_gate(F.col("g"), known).alias("broken"))


@query("absolute_terms", f"SELECT conv_id, turn, turn % 3 <> 0 AND NOT (turn % 2 = 0) AND {any_sql(gd.ABSOLUTE_TERMS, GT)} AS broken FROM conversations")
def absolute_terms(v: View):
    return gated(v).select("conv_id", "turn", gd.breaks_rule_strength(F.col("g"), F.col("turn") % 3 != 0, F.col("turn") % 2 == 0).alias("broken"))


@query("outcome_bias", "SELECT conv_id, turn, " + " OR ".join(f"regexp_matches({GT}, '{p}')" for p in gd.OUTCOME_PATTERNS) + " AS biased FROM conversations")
def outcome_bias(v: View):
    return gated(v).select("conv_id", "turn", gd.outcome_bias(F.col("g")).alias("biased"))


@query("dynamic_sources_current", """
WITH c AS (SELECT o_custkey, o_orderkey % 3 = 0 AS vs, o_orderkey % 5 <> 0 AND DATE '2001-01-01' - CAST(o_orderdate AS DATE) <= 900 AS fresh FROM orders) SELECT o_custkey, bool_and(NOT vs OR fresh) AS current FROM c GROUP BY 1""")
def dynamic_sources_current(v: View):
    from matchloom.functions.text import is_fresh
    k = F.col("o_orderkey")
    ok = is_fresh(k % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(None).cast("string"), k % 5 != 0, F.to_date(F.lit("2001-01-01")), 900)
    return v.table("orders").groupBy("o_custkey").agg(F.bool_and(ok).alias("current"))


BIAS = "(" + " OR ".join("regexp_matches({0}, '" + p.replace("{", "{{").replace("}", "}}") + "')" for p in gd.OUTCOME_PATTERNS) + ")"

# -- drafts: assistant turns; citations and hits are documents ----------------

DRAFT = """nd AS (SELECT count(*) AS n FROM documents),
dr AS (SELECT conv_id AS match_id, turn AS draft_no, turn // 3 AS sid, text || CASE WHEN turn % 4 = 1 THEN ' ' || turn ELSE '' END || CASE WHEN conv_id % 6 = 1 THEN ' never' ELSE '' END || CASE WHEN conv_id % 8 = 1 THEN ' rushed' ELSE '' END || CASE WHEN turn % 5 = 1 THEN ' the result proves it was right' ELSE '' END AS text,
  'base 3' AS source_text, CASE WHEN conv_id % 10 = 3 THEN []::BIGINT[] ELSE list_distinct([conv_id * 3 + turn % 5, conv_id * 5]) END AS cites, conv_id % 2 = 0 AS context_known FROM conversations WHERE role = 'assistant'),
kn AS (SELECT DISTINCT match_id, sid FROM dr WHERE match_id % 7 <> 0),
hi AS (SELECT match_id, sid, unnest([match_id * 3 + 1, match_id * 3 + 3, match_id * 3, match_id * 5]) AS chunk_id FROM kn),
ck AS (SELECT doc_id AS chunk_id, """ + NUM.format("text") + """ AS nums, doc_id % 3 = 0 AS hard, doc_id % 11 <> 0 AS current FROM documents),
fs AS (SELECT match_id, sid, min(draft_no) AS draft_no FROM dr JOIN kn USING (match_id, sid) GROUP BY 1, 2),
ct AS (SELECT match_id, draft_no, sid, unnest(cites) AS chunk_id FROM dr),
pc AS (SELECT ct.match_id, ct.draft_no, count(*) AS n, bool_and(hi.chunk_id IS NOT NULL) AS own, bool_or(coalesce(hard, false)) AS hard, bool_and(coalesce(current, false)) AS cur, flatten(list(coalesce(nums, []))) AS nums
  FROM ct LEFT JOIN (SELECT DISTINCT * FROM hi) hi ON hi.match_id = ct.match_id AND hi.sid = ct.sid AND hi.chunk_id = ct.chunk_id LEFT JOIN ck ON ck.chunk_id = ct.chunk_id GROUP BY 1, 2),
jd AS (SELECT dr.match_id, dr.draft_no, dr.sid, CASE WHEN fs.draft_no IS NULL THEN 'unknown_or_repeated' WHEN coalesce(pc.n, 0) = 0 THEN 'no_citation' WHEN NOT own THEN 'foreign_citation'
  WHEN len(list_filter(""" + NUM.format("text") + """, lambda x: NOT list_contains(list_concat(pc.nums, ['3']), x))) > 0 THEN 'unsupported_number'
  WHEN NOT context_known AND """ + any_sql(gd.PACE_TERMS, "lower(text)") + " THEN 'context_gate' WHEN NOT hard AND " + any_sql(gd.ABSOLUTE_TERMS, "lower(text)") + """ THEN 'rule_strength' WHEN """ + BIAS.format("lower(text)") + """ THEN 'outcome_bias' WHEN NOT cur THEN 'stale_source' END AS reason
  FROM dr LEFT JOIN fs ON fs.match_id = dr.match_id AND fs.draft_no = dr.draft_no LEFT JOIN pc ON pc.match_id = dr.match_id AND pc.draft_no = dr.draft_no)"""


def judged(v: View):
    c, t = F.col("conv_id"), F.col("turn")
    text = F.concat("text", F.when(t % 4 == 1, F.concat(F.lit(" "), t.cast("string"))).otherwise(""), F.when(c % 6 == 1, " never").otherwise(""), F.when(c % 8 == 1, " rushed").otherwise(""),
                    F.when(t % 5 == 1, " the result proves it was right").otherwise(""))
    drafts = v.table("conversations").filter("role = 'assistant'").select(
        c.alias("match_id"), t.alias("draft_no"), F.floor(t / 3).cast("long").alias("sid"), text.alias("text"), F.lit("base 3").alias("source_text"),
        F.when(c % 10 == 3, F.array().cast("array<bigint>")).otherwise(F.array(c * 3 + t % 5, c * 5)).alias("citations"), (c % 2 == 0).alias("context_known"))
    known = drafts.filter("match_id % 7 <> 0").select("match_id", "sid").distinct()
    m = F.col("match_id")
    hits = known.select("match_id", "sid", F.explode(F.array(m * 3 + 1, m * 3 + 3, m * 3, m * 5)).alias("chunk_id"))
    i = F.col("doc_id")
    chunks = v.table("documents").select(i.alias("chunk_id"), F.col("text").alias("content"), (i % 3 == 0).alias("hard"), (i % 11 != 0).alias("current"))
    return gd.judge_drafts(drafts, hits, chunks, known)


@query("draft_gate", "WITH " + DRAFT + " SELECT match_id, draft_no, sid, reason IS NULL AS accepted, reason FROM jd")
def draft_gate(v: View):
    return judged(v)


@query("draft_totals", "WITH " + DRAFT + """, g AS (SELECT match_id, count(*) FILTER (reason IS NULL) AS accepted, count(*) FILTER (reason IS NOT NULL) + CASE WHEN match_id % 5 = 0 THEN 0 ELSE 1 END AS rejected FROM jd GROUP BY match_id)
SELECT match_id, accepted, rejected, CASE WHEN accepted = 0 AND match_id % 5 <> 0 THEN 'rules' ELSE 'rag_llm' END AS mode, CASE WHEN accepted = 0 AND match_id % 5 <> 0 THEN 'all_llm_claims_rejected' END AS fallback_reason FROM g""")
def draft_totals(v: View):
    j = judged(v)
    summary = j.select("match_id").distinct().withColumn("summary_ok", F.col("match_id") % 5 == 0)
    return gd.draft_totals(j, summary)


SUMM = """sv AS (SELECT conv_id * 1000 + turn AS match_id, conv_id, text || CASE WHEN conv_id % 3 = 0 THEN ' ' || conv_id % 7 ELSE '' END || CASE WHEN conv_id % 4 = 0 THEN ' always' ELSE '' END || CASE WHEN turn % 7 = 3 THEN ' Because you won it was correct' ELSE '' END AS text,
  CASE WHEN conv_id % 9 = 0 THEN []::BIGINT[] ELSE [conv_id, conv_id + 1 + 4 * (CASE WHEN conv_id % 8 = 7 THEN 1 ELSE 0 END)] END AS cites FROM conversations),
sh AS (SELECT match_id, unnest([conv_id, conv_id + 1, conv_id + 2]) AS chunk_id FROM sv),
sk AS (SELECT doc_id AS chunk_id, """ + NUM.format("text") + """ AS nums, doc_id % 3 = 0 AS hard, doc_id % 11 <> 0 AS current FROM documents),
so AS (SELECT match_id, sh.chunk_id, nums, hard, current FROM sh JOIN sk USING (chunk_id)),
sa AS (SELECT match_id, flatten(list(nums)) AS nums FROM so GROUP BY 1),
sc AS (SELECT c.match_id, bool_and(so.chunk_id IS NOT NULL) AS own, bool_or(coalesce(hard, false)) AS hard, bool_and(coalesce(current, false)) AS cur FROM (SELECT match_id, unnest(cites) AS chunk_id FROM sv) c LEFT JOIN so ON so.match_id = c.match_id AND so.chunk_id = c.chunk_id GROUP BY 1)"""


@query("summary_gate", "WITH " + SUMM + " SELECT sv.match_id, coalesce(own, false) AND len(list_filter(" + NUM.format("text") + ", lambda x: x <> '3' AND NOT list_contains(coalesce(sa.nums, []), x))) = 0 AND NOT (NOT coalesce(hard, false) AND " + any_sql(gd.ABSOLUTE_TERMS, "lower(text)") + ") AND NOT " + BIAS.format("lower(text)") + " AND coalesce(cur, false) AS summary_ok FROM sv LEFT JOIN sa USING (match_id) LEFT JOIN sc USING (match_id)")
def summary_gate(v: View):
    c = F.col("conv_id")
    text = F.concat("text", F.when(c % 3 == 0, F.concat(F.lit(" "), (c % 7).cast("string"))).otherwise(""), F.when(c % 4 == 0, " always").otherwise(""),
                    F.when(F.col("turn") % 7 == 3, " Because you won it was correct").otherwise(""))
    cites = F.when(c % 9 == 0, F.array().cast("array<bigint>")).otherwise(F.array(c, c + F.when(c % 8 == 7, 5).otherwise(1)))
    s = v.table("conversations").select((c * 1000 + F.col("turn")).alias("match_id"), c.alias("conv_id"), text.alias("text"), F.lit("base 3").alias("source_text"), cites.alias("citations"))
    hits = s.select("match_id", F.explode(F.array(F.col("conv_id"), F.col("conv_id") + 1, F.col("conv_id") + 2)).alias("chunk_id"))
    i = F.col("doc_id")
    chunks = v.table("documents").select(i.alias("chunk_id"), F.col("text").alias("content"), (i % 3 == 0).alias("hard"), (i % 11 != 0).alias("current"))
    return gd.judge_summaries(s, hits, chunks)


@query("preflight", """SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') AND count(*) % 3 = 0 THEN 'analysis_incomplete' WHEN count(*) % 4 = 0 THEN 'llm_unavailable' WHEN count(*) FILTER (o_orderstatus = 'O') = 0 THEN 'no_evidence_suggestions' WHEN count(*) FILTER (o_orderstatus = 'F') = 0 THEN 'knowledge_index_empty' WHEN count(*) FILTER (o_orderpriority = '5-LOW') = 0 THEN 'retrieval_below_threshold' END AS fallback_reason FROM orders GROUP BY 1""")
def preflight(v: View):
    n = F.count(F.lit(1))
    g = v.table("orders").groupBy("o_custkey").agg(
        (~(F.bool_or(F.col("o_orderstatus") == "P") & (n % 3 == 0))).alias("complete"), (n % 4 != 0).alias("available"), F.count_if(F.col("o_orderstatus") == "O").alias("s"),
        F.count_if(F.col("o_orderstatus") == "F").alias("c"), F.count_if(F.col("o_orderpriority") == "5-LOW").alias("r"))
    return g.select("o_custkey", gd.preflight(F.col("complete"), F.col("available"), F.col("s"), F.col("c"), F.col("r")).alias("fallback_reason"))


CALLS = """cl AS (SELECT conv_id AS run, turn AS seq, turn // (2 + conv_id % 3) + 1 AS iteration, turn % (3 + conv_id % 4) AS call_id, role = 'user' AND conv_id % 5 <> 0 AS search_ok, turn = 5 + conv_id % 3 AS fin, length(text) AS chars,
  CASE WHEN role = 'system' THEN 'invalid_tool_arguments' WHEN (conv_id + turn) % 7 = 0 THEN 'unknown_reference' END AS err,
  CASE WHEN turn = 5 + conv_id % 3 AND conv_id % 6 = 1 THEN 'invalid_final_turn' WHEN turn = 5 + conv_id % 3 AND conv_id % 6 = 2 THEN 'invalid_final_payload'
    WHEN turn = 2 AND conv_id % 13 = 4 THEN 'invalid_agent_turn' WHEN turn = 3 AND conv_id % 13 = 7 THEN 'empty_tool_turn' END AS fault FROM conversations),
c0 AS (SELECT *, NOT fin AND coalesce(fault NOT IN ('invalid_agent_turn','empty_tool_turn'), true) AS mk FROM cl),
c1 AS (SELECT *, CASE WHEN mk THEN CASE WHEN row_number() OVER (PARTITION BY run, call_id, mk ORDER BY seq) > 1 THEN 'duplicate_call_id' ELSE err END END AS e FROM c0),
c2 AS (SELECT *, sum(mk::INT) OVER w AS calls, sum((e IS NOT NULL)::INT) OVER w AS fails, sum(CASE WHEN mk THEN chars ELSE 0 END) OVER w AS total, sum((mk AND e IS NULL AND search_ok)::INT) OVER w AS hits,
  sum((coalesce(e, '') = 'duplicate_call_id')::INT) OVER w AS dup, sum((coalesce(e, '') = 'invalid_tool_arguments')::INT) OVER w AS inv, sum((coalesce(e, '') = 'unknown_reference')::INT) OVER w AS unk
  FROM c1 WINDOW w AS (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING)),
c3 AS (SELECT *, CASE WHEN iteration > 3 THEN 'iteration_budget_exhausted' WHEN fault = 'invalid_agent_turn' THEN fault WHEN fin AND fault = 'invalid_final_turn' THEN fault WHEN fin AND hits = 0 THEN 'final_without_knowledge_tool'
  WHEN fin AND fault = 'invalid_final_payload' THEN fault WHEN fin THEN 'completed' WHEN fault = 'empty_tool_turn' THEN fault WHEN calls > 5 THEN 'tool_budget_exhausted' WHEN total > 3000 THEN 'observation_budget_exhausted' END AS stop FROM c2),
c4 AS (SELECT *, CASE WHEN stop IN ('iteration_budget_exhausted','tool_budget_exhausted') THEN 1 ELSE 0 END AS no FROM c3),
c5 AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY stop IS NULL, CASE WHEN stop IS NULL THEN -seq ELSE seq END) AS rn FROM c4)"""


@query("call_log_audit", "WITH " + CALLS + """ SELECT run, coalesce(stop, 'iteration_budget_exhausted') AS stop_reason, CAST(calls - no * mk::INT AS BIGINT) AS tool_calls, CAST(fails - no * (e IS NOT NULL)::INT AS BIGINT) AS tool_failures,
  CAST(dup - no * (coalesce(e, '') = 'duplicate_call_id')::INT AS BIGINT) AS duplicate_ids, CAST(inv - no * (coalesce(e, '') = 'invalid_tool_arguments')::INT AS BIGINT) AS invalid_arguments,
  CAST(unk - no * (coalesce(e, '') = 'unknown_reference')::INT AS BIGINT) AS unknown_references FROM c5 WHERE rn = 1""")
def call_log_audit(v: View):
    c, t = F.col("conv_id"), F.col("turn")
    final = t == c % 3 + 5
    fault = (F.when(final & (c % 6 == 1), "invalid_final_turn").when(final & (c % 6 == 2), "invalid_final_payload")
             .when((t == 2) & (c % 13 == 4), "invalid_agent_turn").when((t == 3) & (c % 13 == 7), "empty_tool_turn"))
    error = F.when(F.col("role") == "system", "invalid_tool_arguments").when((c + t) % 7 == 0, "unknown_reference")
    calls = v.table("conversations").select(
        c.alias("run"), t.alias("seq"), (F.floor(t / (c % 3 + 2)) + 1).alias("iteration"), (t % (c % 4 + 3)).alias("call_id"), error.alias("tool_error"),
        ((F.col("role") == "user") & (c % 5 != 0)).alias("search_ok"), final.alias("is_final"), fault.alias("fault"), F.length("text").alias("observation_chars"))
    return gd.audit_calls(calls, ["run"], block_of("seq", 4096), budget=5, chars=3000)


# -- evaluation: customers are cases, orders are trials -----------------------

def cases(v: View):
    k = F.col("c_custkey")
    tools = lambda *names: F.array(*[F.lit(n) for n in names])
    empty = F.array().cast("array<string>")
    return v.table("customer").select(
        k.alias("case_id"), F.when(k % 3 == 0, F.array(F.lit("guardrail"))).otherwise(empty).alias("tags"),
        F.when(k % 2 == 0, "agent_llm").otherwise("rules").alias("expected_mode"), F.when(k % 5 == 0, "stale").alias("expected_fallback_reason"),
        F.when(k % 2 == 0, "completed").alias("expected_stop_reason"), F.when(k % 4 == 0, tools("search", "overview")).otherwise(empty).alias("required_tools"),
        F.when(k % 6 == 0, tools("search", "overview", "events")).otherwise(empty).alias("allowed_tools"), F.lit(0).alias("min_tool_calls"), F.lit(3).alias("max_tool_calls"),
        F.when(k % 7 == 0, 1).alias("expected_tool_failures"), F.when(k % 9 == 0, 0).alias("expected_invalid_arguments"), F.lit(0).alias("min_accepted"), (k % 2).cast("int").alias("min_rejected"),
        (k % 8 == 0).alias("require_citations"), (k % 10 != 0).alias("expect_llm_called"), F.when(k % 2 == 0, "en").when(k % 5 == 0, "zh-CN").alias("expected_language"),
        F.when(k % 3 == 1, tools("LOW")).otherwise(empty).alias("forbidden_patterns"))


def trials(v: View):
    k = F.col("o_orderkey")
    return v.spread("orders").select(
        F.col("o_custkey").alias("case_id"), k.alias("trial"), F.when(k % 2 == 0, "agent_llm").otherwise("rules").alias("mode"), F.when(k % 5 == 0, "stale").alias("fallback_reason"),
        F.when(k % 2 == 0, "completed").alias("stop_reason"), F.when(k % 4 == 0, F.array(F.lit("search"), F.lit("overview"))).when(k % 4 == 1, F.array(F.lit("events"))).otherwise(
            F.array().cast("array<string>")).alias("tools"), (k % 4).cast("int").alias("tool_calls"), (k % 3 % 2).cast("int").alias("tool_failures"), (k % 7 % 2).cast("int").alias("invalid_arguments"),
        (k % 2).cast("int").alias("accepted"), (k % 3).cast("int").alias("rejected"), (k % 5).cast("int").alias("cited"), (k % 5 + k % 2).cast("int").alias("generated"), (k % 10).cast("int").alias("llm_calls"),
        F.col("o_orderpriority").alias("output"), F.floor(F.col("o_totalprice") / 100).cast("long").alias("latency_ms"), (k % 500).alias("prompt_tokens"), (k % 200).alias("completion_tokens"), (k % 500 + k % 200).alias("total_tokens"))


EVAL = """cs AS (SELECT c_custkey AS case_id, c_custkey AS k FROM customer),
tr AS (SELECT o_custkey AS case_id, o_orderkey AS trial, o_orderkey AS q, o_orderpriority AS output, CAST(floor(o_totalprice / 100) AS BIGINT) AS latency_ms FROM orders),
tl AS (SELECT tr.*, k, CASE q % 4 WHEN 0 THEN ['search','overview'] WHEN 1 THEN ['events'] ELSE []::VARCHAR[] END AS tools, CASE WHEN k % 4 = 0 THEN ['search','overview'] ELSE []::VARCHAR[] END AS req, CASE WHEN k % 6 = 0 THEN ['search','overview','events'] ELSE []::VARCHAR[] END AS al FROM tr JOIN cs USING (case_id)),
pr AS (SELECT *, CASE WHEN len(tools) > 0 THEN len(list_intersect(tools, CASE WHEN len(al) > 0 THEN al ELSE req END)) / len(tools) ELSE 1 END AS tp, CASE WHEN len(req) > 0 THEN len(list_intersect(tools, req)) / len(req) ELSE 1 END AS trc,
  CASE WHEN q % 5 + q % 2 > 0 THEN (q % 5) / (q % 5 + q % 2) WHEN k % 8 = 0 THEN 0 ELSE 1 END AS cov FROM tl),
ck AS (SELECT *, list_filter([CASE WHEN q % 2 <> k % 2 THEN 'mode' END, CASE WHEN (q % 5 = 0) <> (k % 5 = 0) THEN 'fallback_reason' END, CASE WHEN q % 2 <> k % 2 THEN 'stop_reason' END, CASE WHEN trc <> 1 THEN 'required_tools' END, CASE WHEN tp <> 1 THEN 'allowed_tools' END,
  CASE WHEN k % 7 = 0 AND q % 3 % 2 <> 1 THEN 'tool_failures' END, CASE WHEN k % 9 = 0 AND q % 7 % 2 <> 0 THEN 'invalid_arguments' END, CASE WHEN q % 3 < k % 2 THEN 'rejected_enrichments' END, CASE WHEN k % 8 = 0 AND cov <> 1 THEN 'citations' END,
  CASE WHEN (q % 10 > 0) <> (k % 10 <> 0) THEN 'llm_call_state' END, CASE WHEN k % 3 = 1 AND contains(lower(output), 'low') THEN 'forbidden_output' END,
  CASE WHEN k % 2 = 0 AND length(regexp_replace(lower(output), '[^a-z]', '', 'g')) < 12 THEN 'output_language' WHEN k % 2 = 1 AND k % 5 = 0 THEN 'output_language' END], lambda x: x IS NOT NULL) AS fails FROM pr)"""


@query("case_scores", "WITH " + EVAL + " SELECT case_id, trial, len(fails) = 0 AS passed, array_to_string(fails, ',') AS failures, round(tp, 4) AS tool_precision, round(trc, 4) AS tool_recall, round(cov, 4) AS citation_coverage FROM ck")
def case_scores(v: View):
    s = ev.score_cases(trials(v), cases(v))
    return s.select("case_id", "trial", "passed", F.array_join("failures", ",").alias("failures"), F.round("tool_precision", 4).alias("tool_precision"),
                    F.round("tool_recall", 4).alias("tool_recall"), F.round("citation_coverage", 4).alias("citation_coverage"))


SUITE = """sm AS (SELECT k % 10 AS suite, count(*) AS case_count, count(*) FILTER (len(fails) = 0) AS passed_cases, avg(CASE WHEN len(fails) = 0 THEN 1.0 ELSE 0 END) AS pass_rate, coalesce(avg(CASE WHEN k % 2 = 0 THEN CASE WHEN q % 2 = 0 THEN 1.0 ELSE 0 END END), 1) AS task_completion_rate,
 coalesce(avg(CASE WHEN list_contains(fails, 'fallback_reason') THEN 0.0 ELSE 1 END), 1) AS fallback_accuracy, avg(tp) AS tool_selection_precision, avg(trc) AS tool_selection_recall,
 coalesce((sum(q % 4) - sum(q % 7 % 2)) / nullif(sum(q % 4), 0), 1) AS tool_argument_validity, coalesce((sum(q % 4) - sum(q % 3 % 2)) / nullif(sum(q % 4), 0), 1) AS tool_execution_success, coalesce(avg(CASE WHEN k % 8 = 0 THEN cov END), 1) AS citation_coverage,
 coalesce(avg(CASE WHEN k % 3 = 0 THEN CASE WHEN len(fails) = 0 THEN 1.0 ELSE 0 END END), 1) AS guardrail_pass_rate, avg(latency_ms) AS average_latency_ms, avg(q % 500 + q % 200) AS average_total_tokens FROM ck GROUP BY k % 10)"""
RATES = ["pass_rate", "task_completion_rate", "fallback_accuracy", "tool_selection_precision", "tool_selection_recall", "tool_argument_validity", "tool_execution_success", "citation_coverage", "guardrail_pass_rate", "average_latency_ms", "average_total_tokens"]


@query("suite_metrics", "WITH " + EVAL + ", " + SUITE + " SELECT suite, case_count, passed_cases, " + ", ".join(f"round({r}, 3) AS {r}" for r in RATES) + ", pass_rate >= .02 AS gate FROM sm")
def suite_metrics(v: View):
    s = ev.score_cases(trials(v), cases(v)).withColumn("suite", F.col("case_id") % 10)
    m = ev.passes_gate(ev.suite_metrics(s, ["suite"]), .02)
    return m.select("suite", "case_count", "passed_cases", *[F.round(r, 3).alias(r) for r in RATES], "gate")


@query("pass_consistency", "WITH " + EVAL + " SELECT round(avg(CASE WHEN d = 1 THEN 1.0 ELSE 0 END), 4) AS consistency FROM (SELECT case_id, count(DISTINCT len(fails) = 0) AS d FROM ck GROUP BY 1)")
def pass_consistency(v: View):
    return ev.pass_consistency(ev.score_cases(trials(v), cases(v)), "case_id", "passed").withColumn("consistency", F.round("consistency", 4))


@query("stability", "WITH " + EVAL + """, t1 AS (SELECT case_id, max(n) / sum(n) AS s FROM (SELECT case_id, tools, count(*) AS n FROM ck GROUP BY 1, 2) GROUP BY 1),
t2 AS (SELECT case_id, max(n) / sum(n) AS s FROM (SELECT case_id, len(fails) = 0, q % 2, q % 5 = 0, tools, count(*) AS n FROM ck GROUP BY 1, 2, 3, 4, 5) GROUP BY 1) SELECT 'tool_path' AS kind, round(avg(s), 4) AS stability FROM t1 UNION ALL SELECT 'outcome', round(avg(s), 4) FROM t2""")
def stability(v: View):
    s = ev.score_cases(trials(v), cases(v))
    path = ev.stability(s, "case_id", [F.col("tools")]).select(F.lit("tool_path").alias("kind"), F.round("stability", 4).alias("stability"))
    outcome = ev.stability(s, "case_id", [F.col("passed"), F.col("mode"), F.col("fallback_reason"), F.col("stop_reason"), F.col("tools")])
    return path.unionByName(outcome.select(F.lit("outcome").alias("kind"), F.round("stability", 4).alias("stability")))


@query("latency_pct", """WITH t AS (SELECT CAST(floor(o_totalprice / 100) AS BIGINT) AS ms FROM orders WHERE o_orderkey % 10 > 0) SELECT CAST(quantile_disc(ms, .5) AS DOUBLE) AS p50, CAST(quantile_disc(ms, .95) AS DOUBLE) AS p95 FROM t""")
def latency_pct(v: View):
    return ev.nearest_rank(trials(v).filter("llm_calls > 0"), "latency_ms", {"p50": .5, "p95": .95})


@query("token_cost", """SELECT o_custkey AS case_id, CAST(sum(o_orderkey % 500) AS BIGINT) AS prompt_tokens, CAST(sum(o_orderkey % 200) AS BIGINT) AS completion_tokens, round(CASE WHEN o_custkey % 4 <> 0 THEN (sum(o_orderkey % 500) * 1.0 + sum(o_orderkey % 200) * 2.0) / 1000000 END, 6) AS cost FROM orders GROUP BY o_custkey""")
def token_cost(v: View):
    g = ev.token_cost(trials(v), F.lit(1.0), F.when(F.col("case_id") % 4 != 0, 2.0), ["case_id"])
    return g.withColumn("cost", F.round("cost", 6))


@query("success_rate", """SELECT count(*) FILTER (o_orderkey % 10 > 0) AS call_trials, round(avg(CASE WHEN o_orderkey % 10 > 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE 0 END END), 4) AS success_rate FROM orders""")
def success_rate(v: View):
    ok = (F.col("mode") == "agent_llm") & F.equal_null(F.col("stop_reason"), F.lit("completed"))
    return ev.success_rate(trials(v), F.col("llm_calls") > 0, ok).withColumn("success_rate", F.round("success_rate", 4))


@query("regression_diff", """WITH e AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 97 <> 0 GROUP BY 1), a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT o_custkey, e.n, a.n AS actual_n FROM e FULL OUTER JOIN a USING (o_custkey) WHERE e.n IS DISTINCT FROM a.n""")
def regression_diff(v: View):
    o = v.table("orders")
    count = lambda d: d.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return ev.regression_diff(count(o.filter("o_orderkey % 97 <> 0")), count(o), ["o_custkey"], ["n"])


@query("metric_report", "WITH " + EVAL + ", " + SUITE + " SELECT suite, '| ' || suite || ' | ' || case_count || ' | ' || passed_cases || ' |' AS line FROM sm")
def metric_report(v: View):
    from matchloom.sources.sinks import markdown_rows
    s = ev.score_cases(trials(v), cases(v)).withColumn("suite", F.col("case_id") % 10)
    return markdown_rows(ev.suite_metrics(s, ["suite"]), ["suite", "case_count", "passed_cases"]).select("suite", "line")
