"""Case scoring, suite aggregation, stability, latency and cost metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from matchloom.functions import text as tx


def overlap_ratio(part: Column, whole: Column) -> Column:
    """Share of ``whole`` that is in ``part``; 1 when ``whole`` is empty."""
    size = F.size(F.array_distinct(whole))
    return F.when(size > 0, F.size(F.array_intersect(whole, part)) / size).otherwise(1.0)


def tool_scores(actual: Column, allowed: Column, required: Column) -> tuple[Column, Column]:
    """Precision against the allowed tools (required when none are listed) and recall of the required ones."""
    limit = F.when(F.size(allowed) > 0, allowed).otherwise(required)
    return overlap_ratio(limit, actual), overlap_ratio(actual, required)


def citation_coverage(cited: Column, total: Column, required: Column) -> Column:
    return F.when(total > 0, cited / total).when(required, 0.0).otherwise(1.0)


def score_cases(results: DataFrame, cases: DataFrame, key: str = "case_id") -> DataFrame:
    """Named checks per result, ``passed`` and the failed names in order.

    Eleven checks always apply; expected failure counts and the output language
    add theirs when the case asks for them.
    """
    precision, recall = tool_scores(F.col("tools"), F.col("allowed_tools"), F.col("required_tools"))
    # scores are columns of their own, so the checks below read them instead of recomputing them
    j = results.join(cases, key).select(
        "*", precision.alias("tool_precision"), recall.alias("tool_recall"),
        citation_coverage(F.col("cited"), F.col("generated"), F.col("require_citations")).alias("citation_coverage"),
        F.lower("output").alias("_text"))
    same = lambda a, b: F.equal_null(F.col(a), F.col(b))
    forbidden = F.exists("forbidden_patterns", lambda p: F.contains(F.col("_text"), F.lower(p)))
    language = (F.when(F.col("expected_language") == "zh-CN", tx.han_count(F.col("_text")) >= 4)
                .when(F.col("expected_language") == "en", tx.latin_count(F.col("_text")) >= 12))
    checks = [
        ("mode", same("mode", "expected_mode")),
        ("fallback_reason", same("fallback_reason", "expected_fallback_reason")),
        ("stop_reason", same("stop_reason", "expected_stop_reason")),
        ("required_tools", F.col("tool_recall") == 1.0),
        ("allowed_tools", F.col("tool_precision") == 1.0),
        ("tool_call_budget", F.col("tool_calls").between(F.col("min_tool_calls"), F.col("max_tool_calls"))),
        ("tool_failures", F.when(F.col("expected_tool_failures").isNotNull(), F.col("tool_failures") == F.col("expected_tool_failures"))),
        ("invalid_arguments", F.when(F.col("expected_invalid_arguments").isNotNull(), F.col("invalid_arguments") == F.col("expected_invalid_arguments"))),
        ("accepted_enrichments", F.col("accepted") >= F.col("min_accepted")),
        ("rejected_enrichments", F.col("rejected") >= F.col("min_rejected")),
        ("citations", ~F.col("require_citations") | (F.col("citation_coverage") == 1.0)),
        ("llm_call_state", (F.col("llm_calls") > 0) == F.col("expect_llm_called")),
        ("forbidden_output", ~forbidden),
        ("output_language", language),
    ]
    entries = F.array(*[F.struct(F.lit(n).alias("name"), c.alias("ok")) for n, c in checks])
    entries = F.filter(entries, lambda e: e["ok"].isNotNull())
    out = j.withColumn("_checks", entries).select(
        *results.columns, "tags", "require_citations", "expected_stop_reason",
        "tool_precision", "tool_recall", "citation_coverage",
        F.map_from_entries("_checks").alias("checks"), F.forall("_checks", lambda e: e["ok"]).alias("passed"),
        F.transform(F.filter("_checks", lambda e: ~e["ok"]), lambda e: e["name"]).alias("failures"))
    return out


def suite_metrics(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Macro means (1 on an empty subset) and micro call rates in one aggregation."""
    mean = lambda cond, value: F.coalesce(F.avg(F.when(cond, value)), F.lit(1.0))
    every = F.lit(True)
    calls = F.sum("tool_calls")
    rate = lambda bad: F.coalesce((calls - F.sum(bad)) / F.when(calls > 0, calls), F.lit(1.0))
    as_num = lambda c: c.cast("double")
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("case_count"), F.count_if("passed").alias("passed_cases"), F.avg(as_num(F.col("passed"))).alias("pass_rate"),
        mean(F.col("expected_stop_reason") == "completed", as_num(F.equal_null(F.col("stop_reason"), F.lit("completed")))).alias("task_completion_rate"),
        mean(every, as_num(F.col("checks")["fallback_reason"])).alias("fallback_accuracy"),
        mean(every, F.col("tool_precision")).alias("tool_selection_precision"), mean(every, F.col("tool_recall")).alias("tool_selection_recall"),
        rate("invalid_arguments").alias("tool_argument_validity"), rate("tool_failures").alias("tool_execution_success"),
        mean(F.col("require_citations"), F.col("citation_coverage")).alias("citation_coverage"),
        mean(F.array_contains("tags", "guardrail"), as_num(F.col("passed"))).alias("guardrail_pass_rate"),
        F.avg("latency_ms").alias("average_latency_ms"), F.avg("total_tokens").alias("average_total_tokens"))


def passes_gate(metrics: DataFrame, minimum: float = 1.0) -> DataFrame:
    return metrics.withColumn("gate", F.col("pass_rate") >= minimum)


def pass_consistency(trials: DataFrame, case: str, passed: str) -> DataFrame:
    """Share of cases whose trials all agree."""
    per = trials.groupBy(case).agg(F.count_distinct(passed).alias("d"))
    return per.agg(F.avg((F.col("d") == 1).cast("double")).alias("consistency"))


def stability(trials: DataFrame, case: str, outcome: Sequence[Column]) -> DataFrame:
    """Macro average over cases of the share of the most common outcome."""
    named = [c.alias(f"o{i}") for i, c in enumerate(outcome)]
    counts = trials.select(case, *named).groupBy(case, *[f"o{i}" for i in range(len(named))]).agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy(case).agg((F.max("n") / F.sum("n")).alias("share"))
    return per.agg(F.coalesce(F.avg("share"), F.lit(1.0)).alias("stability"))


def nearest_rank(df: DataFrame, value: str, quantiles: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles over the whole table without sorting it in one task.

    Equal values are counted first; the ordered counts are range-partitioned and
    prefix-summed block by block, so no task holds all values.
    """
    from matchloom.operators.scan import scan
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    block = F.floor(F.col(value) / 1024).cast("long")
    counts = counts.withColumn("_g", F.lit(0))
    cum = scan(counts, ["_g"], [value], block, total={"cum": F.col("n")})
    total = counts.groupBy("_g").agg(F.sum("n").alias("total"))
    j = cum.join(total, "_g")
    picks = [F.min(F.when(F.col("cum") >= F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("total"))), F.col(value))).cast("double") for q in quantiles.values()]
    return j.agg(*[F.coalesce(p, F.lit(0.0)).alias(n) for n, p in zip(quantiles, picks)])


def token_cost(trials: DataFrame, price_in: Column, price_out: Column, by: Sequence[str] = ()) -> DataFrame:
    """Token totals and cost per million; NULL when a price is unknown."""
    g = trials.groupBy(*by).agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    return g.withColumn("cost", (F.col("prompt_tokens") * price_in + F.col("completion_tokens") * price_out) / 1_000_000)


def success_rate(trials: DataFrame, called: Column, success: Column) -> DataFrame:
    """Share of successful trials among those that called the provider; 1 when none did."""
    return trials.agg(F.count_if(called).alias("call_trials"), F.coalesce(F.avg(F.when(called, success.cast("double"))), F.lit(1.0)).alias("success_rate"))


def regression_diff(expected: DataFrame, actual: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Rows whose expected and actual values differ; empty means the harness passes."""
    a = actual.select(*key, *[F.col(f).alias("actual_" + f) for f in fields])
    j = expected.join(a, list(key), "full_outer")
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.equal_null(F.col(f), F.col("actual_" + f))
    return j.filter(differs)
