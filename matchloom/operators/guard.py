"""Evidence gates over drafts, citations and tool-call logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from matchloom.functions import text as tx
from matchloom.operators.scan import scan

# Wording lists and patterns of the gates.
PACE_TERMS = (
    "passive", "slow map control", "rushed", "too late",
    "打法被动", "推进过慢", "地图控制较慢", "行动太慢", "过早强攻",
)
ABSOLUTE_TERMS = (
    "必须", "禁止", "绝不", "永远", "一定", "唯一正确", "毫无例外",
    "must", "never", "always", "forbidden", "guaranteed", "only correct",
)
OUTCOME_PATTERNS = (
    r"因为.{0,30}(?:击杀|获胜|赢得|成功).{0,20}所以.{0,20}(?:正确|合理|好决策)",
    r"(?:结果证明|成功了所以).{0,20}(?:正确|合理)",
    r"because (?:it worked|you got the kill|you won).{0,40}(?:correct|good decision)",
    r"the result proves.{0,30}(?:correct|right)",
)
CALL_BUDGET, ITERATIONS, OBSERVATION_CHARS = 12, 3, 48_000


def query_text() -> Column:
    """Retrieval text of a suggestion and its known context."""
    part = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(name + " "), c))
    words = lambda c: F.when(F.size(c) > 0, F.array_join(c, " "))
    return F.concat_ws(" | ", "category", "reasoning", "action", part("side", F.col("player_side")), part("weapon", words(F.col("weapons"))),
                       part("map", F.col("map_name")), part("position", F.col("map_position")), part("utility", words(F.col("utility"))))


def unsupported_numbers(draft: Column, source: Column) -> Column:
    return F.size(F.array_except(tx.number_tokens(draft), tx.number_tokens(source))) > 0


def context_known(map_name: Column, side: Column, position: Column, clock: Column) -> Column:
    """Whether the four fields that talk about pace needs are all there."""
    return map_name.isNotNull() & side.isNotNull() & position.isNotNull() & clock.isNotNull()


def breaks_context_gate(text: Column, context_known: Column) -> Column:
    return ~context_known & tx.has_any(text, PACE_TERMS)


def breaks_rule_strength(text: Column, cited: Column, any_hard: Column) -> Column:
    return cited & ~any_hard & tx.has_any(text, ABSOLUTE_TERMS)


def outcome_bias(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for p in OUTCOME_PATTERNS:
        out = out | low.rlike(p)
    return out


def judge_drafts(drafts: DataFrame, hits: DataFrame, chunks: DataFrame, known: DataFrame) -> DataFrame:
    """Accept or reject drafts: known id, first occurrence, own citations only, all gates.

    ``drafts``: match_id, draft_no, sid, text, source_text, citations, context_known;
    ``hits``: match_id, sid, chunk_id; ``chunks``: chunk_id, content, hard, current;
    ``known``: match_id, sid.
    """
    key = ["match_id", "draft_no"]
    first = drafts.join(known.select("match_id", "sid"), ["match_id", "sid"], "left_semi").groupBy("match_id", "sid").agg(
        F.min("draft_no").alias("draft_no"))
    cited = drafts.select(*key, "sid", F.explode(F.array_distinct("citations")).alias("chunk_id"))
    own = hits.select("match_id", "sid", "chunk_id").distinct().withColumn("_own", F.lit(True))
    facts = chunks.select("chunk_id", "hard", "current", tx.number_tokens(F.col("content")).alias("_numbers"))
    cited = cited.join(own, ["match_id", "sid", "chunk_id"], "left").join(facts, "chunk_id", "left")
    per = cited.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_cited"), F.bool_and(F.coalesce("_own", F.lit(False))).alias("all_own"),
        F.bool_or(F.coalesce("hard", F.lit(False))).alias("any_hard"), F.bool_and(F.coalesce("current", F.lit(False))).alias("all_current"),
        F.array_distinct(F.flatten(F.collect_list("_numbers"))).alias("_numbers"))
    j = drafts.join(per, key, "left").join(first.select(*key, F.lit(True).alias("_first")), key, "left")
    allowed = F.concat(F.coalesce("_numbers", F.array().cast("array<string>")), tx.number_tokens(F.col("source_text")))
    text = F.col("text")
    reason = (F.when(F.col("_first").isNull(), "unknown_or_repeated")
              .when(F.coalesce("n_cited", F.lit(0)) == 0, "no_citation")
              .when(~F.col("all_own"), "foreign_citation")
              .when(F.size(F.array_except(tx.number_tokens(text), allowed)) > 0, "unsupported_number")
              .when(breaks_context_gate(text, F.col("context_known")), "context_gate")
              .when(breaks_rule_strength(text, F.lit(True), F.col("any_hard")), "rule_strength")
              .when(outcome_bias(text), "outcome_bias")
              .when(~F.col("all_current"), "stale_source"))
    return j.select(*key, "sid", reason.isNull().alias("accepted"), reason.alias("reason"))


def judge_summaries(summaries: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Match-level gate: cited hits of the match only, supported numbers, wording, bias and freshness.

    ``summaries``: match_id, text, source_text, citations; ``hits``: match_id, chunk_id, the
    match's unique hits, all of which support numbers.
    """
    own = hits.select("match_id", "chunk_id").distinct().join(
        chunks.select("chunk_id", "hard", "current", tx.number_tokens(F.col("content")).alias("_numbers")), "chunk_id")
    allowed = own.select("match_id", F.explode("_numbers").alias("number")).distinct()
    used = summaries.select("match_id", F.explode(F.array_except(
        tx.number_tokens(F.col("text")), tx.number_tokens(F.col("source_text")))).alias("number"))
    loose = used.join(allowed, ["match_id", "number"], "left_anti").groupBy("match_id").agg(F.count(F.lit(1)).alias("loose"))
    cited = summaries.select("match_id", F.explode(F.array_distinct("citations")).alias("chunk_id"))
    cited = cited.join(own.withColumn("_own", F.lit(True)), ["match_id", "chunk_id"], "left").groupBy("match_id").agg(
        F.bool_and(F.col("_own").isNotNull()).alias("all_own"), F.bool_or(F.coalesce("hard", F.lit(False))).alias("any_hard"),
        F.bool_and(F.coalesce("current", F.lit(False))).alias("all_current"))
    j = summaries.join(cited, "match_id", "left").join(loose, "match_id", "left")
    ok = (F.coalesce("all_own", F.lit(False)) & (F.coalesce("loose", F.lit(0)) == 0)
          & ~breaks_rule_strength(F.col("text"), F.lit(True), F.coalesce("any_hard", F.lit(False)))
          & ~outcome_bias(F.col("text")) & F.coalesce("all_current", F.lit(False)))
    return j.select("match_id", ok.alias("summary_ok"))


def draft_totals(judged: DataFrame, summary_accepted: DataFrame | None = None) -> DataFrame:
    """Accepted and rejected counts per match; all rejected means falling back to the rules.

    ``summary_accepted``: match_id, summary_ok.  A rejected summary counts as a rejection.
    """
    g = judged.groupBy("match_id").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))
    kept = F.lit(False)
    if summary_accepted is not None:
        g = g.join(summary_accepted, "match_id", "left")
        kept = F.coalesce("summary_ok", F.lit(False))
        g = g.withColumn("rejected", F.col("rejected") + F.when(kept, 0).otherwise(1))
    fallback = (F.col("accepted") == 0) & ~kept
    return g.select("match_id", "accepted", "rejected", F.when(fallback, "rules").otherwise("rag_llm").alias("mode"),
                    F.when(fallback, "all_llm_claims_rejected").alias("fallback_reason"))


def preflight(complete: Column, available: Column, suggestions: Column, chunks: Column, retrieved: Column) -> Column:
    """First reason to stay with the rules, in order; NULL when generation may run."""
    return (F.when(~complete, "analysis_incomplete").when(~available, "llm_unavailable")
            .when(suggestions == 0, "no_evidence_suggestions").when(chunks == 0, "knowledge_index_empty")
            .when(retrieved == 0, "retrieval_below_threshold"))


#: Why a call may fail, in the order of the counts of an audit.
TOOL_ERRORS = {"duplicate_call_id": "duplicate_ids", "invalid_tool_arguments": "invalid_arguments", "unknown_reference": "unknown_references"}


def audit_calls(calls: DataFrame, run: list[str], block: Column, budget: int = CALL_BUDGET, iterations: int = ITERATIONS,
                chars: int = OBSERVATION_CHARS) -> DataFrame:
    """Replay each run's log in order and stop at its first violation: stop reason, calls, failures in total and by kind.

    ``calls``: run columns, seq, iteration, call_id, tool_error, search_ok, is_final, fault,
    observation_chars. A row is a tool call, a final turn, or a turn that ``fault`` names: one that can't be
    read (invalid_agent_turn), one without calls (empty_tool_turn), or a final one with calls or without a
    payload (invalid_final_turn) or with a payload of the wrong form (invalid_final_payload).
    A repeated call id fails before its tool runs; failures and calls count up to the stop.
    """
    fault = lambda name: F.coalesce(F.col("fault") == name, F.lit(False))
    call = ~F.col("is_final") & ~fault("invalid_agent_turn") & ~fault("empty_tool_turn")
    rows = calls.withColumn("_call", call.cast("long"))
    rows = scan(rows, [*run, "call_id", "_call"], ["seq"], block, prev={"_seen": F.col("seq")})
    made = F.col("_call") == 1
    error = F.when(made, F.when(F.col("_seen").isNotNull(), "duplicate_call_id").otherwise(F.col("tool_error")))
    rows = rows.withColumn("_error", error).withColumn("_chars", F.when(made, F.col("observation_chars")).otherwise(0).cast("long"))
    sums = {"_calls": F.col("_call"), "_total": F.col("_chars"), "_hits": (made & F.col("_error").isNull() & F.col("search_ok")).cast("long"),
            "_fails": F.col("_error").isNotNull().cast("long")}
    sums |= {f"_{n}": F.coalesce(F.col("_error") == e, F.lit(False)).cast("long") for e, n in TOOL_ERRORS.items()}
    rows = scan(rows, run, ["seq"], block, total=sums)
    stop = (F.when(F.col("iteration") > iterations, "iteration_budget_exhausted")
            .when(fault("invalid_agent_turn"), "invalid_agent_turn")
            .when(F.col("is_final") & fault("invalid_final_turn"), "invalid_final_turn")
            .when(F.col("is_final") & (F.col("_hits") == 0), "final_without_knowledge_tool")
            .when(F.col("is_final") & fault("invalid_final_payload"), "invalid_final_payload")
            .when(F.col("is_final"), "completed")
            .when(fault("empty_tool_turn"), "empty_tool_turn")
            .when(F.col("_calls") > budget, "tool_budget_exhausted")
            .when(F.col("_total") > chars, "observation_budget_exhausted"))
    # a call refused for its budget or iteration was never made
    refused = F.coalesce(stop.isin("iteration_budget_exhausted", "tool_budget_exhausted"), F.lit(False))
    own = {"_calls": F.col("_call"), "_fails": F.col("_error").isNotNull().cast("long")}
    own |= {f"_{n}": F.coalesce(F.col("_error") == e, F.lit(False)).cast("long") for e, n in TOOL_ERRORS.items()}
    names = {"_calls": "tool_calls", "_fails": "tool_failures"} | {f"_{n}": n for n in TOOL_ERRORS.values()}
    counts = [(F.col(c) - F.when(refused, x).otherwise(0)).alias(names[c]) for c, x in own.items()]
    rows = rows.withColumn("_stop", stop).withColumn("_counts", F.struct(*counts))
    first = F.min_by(F.struct(F.col("_stop").alias("stop_reason"), F.col("_counts").alias("c")), F.when(F.col("_stop").isNotNull(), F.col("seq")))
    total = F.max_by(F.struct(F.lit("iteration_budget_exhausted").alias("stop_reason"), F.col("_counts").alias("c")), "seq")
    return rows.groupBy(*run).agg(F.coalesce(first, total).alias("r")).select(*run, "r.stop_reason", "r.c.*")
