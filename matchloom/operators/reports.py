"""Round statistics, match overview, findings, clip and frame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from matchloom.operators.blocks import durable
from matchloom.operators.rules import Rule, fire
from matchloom.operators.scan import scan
from matchloom.operators.sessions import top_per_group

ROUND = ["video_id", "rid"]


def _kind(name: str) -> Column:
    return F.col("type") == name


def round_stats(events: DataFrame, visible: Column, likely: Column, shots: Column, damages: Column, kill_feed: Column,
                deaths_known: Column | None = None) -> DataFrame:
    """Per-round counts, first visibility, duration and survival in one aggregation.

    Survival runs to the first death, or through the round. It is null where the round
    is open, or where ``deaths_known`` (of the key) says that deaths can't be told.
    """
    known = F.lit(True) if deaths_known is None else deaths_known
    engaged = _kind("engagement_candidate")
    start = F.min(F.when(_kind("round_start"), F.col("t")))
    end = F.max(F.when(_kind("round_end"), F.col("t")))
    death = F.min(F.when(_kind("player_death"), F.col("t")))
    seen = F.min(F.when(visible, F.col("t")))
    s = events.groupBy(*ROUND).agg(
        start.alias("s"), end.alias("e"), F.count(F.lit(1)).alias("n"),
        F.count_if(_kind("player_kill")).alias("kills"), F.count_if(_kind("player_death")).alias("deaths"),
        F.count_if(kill_feed).alias("killfeed"),
        F.count_if(engaged).alias("engagements"), F.count_if(engaged & likely).alias("likely_firefights"),
        F.count_if(engaged & (shots > 0)).alias("shot_windows"), F.count_if(engaged & (damages > 0)).alias("damage_windows"),
        death.alias("first_death"), F.min(F.when(_kind("player_kill"), F.col("t"))).alias("first_kill"), seen.alias("_seen"))
    return s.select(
        "*", F.greatest(F.lit(0).cast("long"), F.col("_seen") - F.col("s")).alias("first_visible"),
        (F.col("e") - F.col("s")).alias("duration"),
        F.when(F.col("e").isNotNull() & known, F.coalesce("first_death", "e") - F.col("s")).alias("survival")).drop("_seen")


def match_overview(stats: DataFrame) -> DataFrame:
    """Sums per recording; deaths count rounds died in, not death events."""
    return stats.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("rounds"), F.sum("kills").alias("kills"),
        F.count_if(F.col("deaths") > 0).alias("deaths"), F.avg("survival").alias("avg_survival"),
        F.sum("engagements").alias("engagements"), F.sum("likely_firefights").alias("likely_firefights"))


def post_death_filter(events: DataFrame) -> DataFrame:
    """Keep events up to the first death, and boundaries."""
    deaths = events.filter(_kind("player_death")).groupBy(*ROUND).agg(F.min("t").alias("_d"))
    joined = events.join(deaths, ROUND, "left")
    return joined.filter(F.col("_d").isNull() | (F.col("t") <= F.col("_d")) | F.col("type").isin("round_start", "round_end")).drop("_d")


def post_death_rounds(stats: DataFrame) -> DataFrame:
    """Round ends shortened to the first death."""
    return stats.withColumn("e", F.when(F.col("first_death") < F.col("e"), F.col("first_death")).otherwise(F.col("e")))


# Findings in emission order with their fixed confidences.
ROUND_FINDINGS = [
    Rule("round_flow_start", "s IS NOT NULL", ".95", "round_flow", "info", "finding.round_start", "s"),
    Rule("round_flow_end", "e IS NOT NULL", ".90", "round_flow", "info", "finding.round_end", "e"),
    Rule("round_flow_truncated", "e IS NULL", ".80", "round_flow", "warning", "finding.round_truncated"),
    Rule("combat_kills", "personal_kills AND kills > 0", ".55", "combat", "info", "finding.kills"),
    Rule("combat_deaths", "personal_deaths AND deaths > 0", ".85", "combat", "warning", "finding.deaths"),
    Rule("combat_none", "personal_kills AND personal_deaths AND kills = 0 AND deaths = 0", ".70", "combat", "info", "finding.no_combat"),
    Rule("movement_enemy_first_visible", "first_visible IS NOT NULL", ".80", "movement", "info", "finding.enemy_first_visible"),
    Rule("movement_enemy_tracks", "enemy_tracks > 0", ".75", "movement"),
    Rule("combat_likely_firefight", "likely_firefights > 0", ".76", "combat", "info", "finding.likely_firefight"),
    Rule("movement_flash", "has_view AND flash_time > 0", ".88", "utility", "warning"),
    Rule("movement_scope", "has_view AND scope_time > 0", ".86", "movement"),
    Rule("movement_view_dynamics", "has_view", ".80", "movement"),
]
MATCH_FINDINGS = [
    Rule("match_rounds", "true", "1.0", "round_flow"),
    Rule("match_total_kills", "personal_kills AND kills > 0", ".55", "combat"),
    Rule("match_total_deaths", "personal_deaths AND deaths > 0", ".85", "combat", "warning"),
    Rule("match_no_combat", "personal_kills AND personal_deaths AND kills = 0 AND deaths = 0", ".70", "combat"),
]
#: Every warning of a recording is a finding; they stand before this rule.
WARNINGS_BEFORE = "match_no_combat"


def warning_findings(overview: DataFrame) -> DataFrame:
    """One row per entry of ``warnings``, in order."""
    place = [r.name for r in MATCH_FINDINGS].index(WARNINGS_BEFORE)
    each = overview.select("video_id", F.posexplode("warnings").alias("i", "template"))
    return each.select(
        "video_id", F.lit(place - 1).alias("rule_no"), (F.col("i") + 1).alias("nth"), F.concat(F.lit("match_warning_"), F.col("i").cast("string")).alias("name"),
        F.lit("round_flow").alias("category"), F.lit("warning").alias("severity"), F.lit(.90).alias("confidence"))


def findings(stats: DataFrame, overview: DataFrame, per_block: int = 4096) -> DataFrame:
    """Round findings in round order, then match findings, numbered per recording.

    ``overview`` has an array ``warnings``; each of them is a finding.
    """
    cols = ["video_id", "rid", "rule_no", "nth", "name", "category", "severity", "confidence"]
    first = F.lit(0).alias("nth")
    rounds = fire(stats, ROUND_FINDINGS, ROUND).select("*", first).select(*cols)
    match = fire(overview, MATCH_FINDINGS, ["video_id"]).select("*", first).drop("template", "at").unionByName(warning_findings(overview))
    match = match.withColumn("rid", F.lit(1 << 40).cast("long")).select(*cols)
    both = durable(rounds.unionByName(match))  # numbering reads it twice
    ranked = scan(both, ["video_id"], ["rid", "rule_no", "nth"], F.floor(F.col("rid") / per_block).cast("long"), rank="_n")
    return ranked.select("video_id", F.when(F.col("rid") < (1 << 40), F.col("rid")).alias("rid"),
                         F.concat("name", F.format_string("_%03d", "_n")).alias("finding_id"), "category", "severity", "confidence")


def clip_plan(events: DataFrame, trigger: Column, duration: Column, before, after, cap: int = 12) -> DataFrame:
    """First ``cap`` distinct events per recording and the clip bounds around their trigger."""
    once = events.withColumn("_trigger", trigger).withColumn("_duration", duration).groupBy("video_id", "event_id").agg(
        F.min(F.struct("rid", "t", "seq", "_trigger", "_duration")).alias("b")).select("video_id", "event_id", "b.*")
    first = top_per_group(once, ["video_id"], ["rid", "t", "seq"], cap, "_rn")
    return first.select("video_id", "event_id", F.col("_trigger").alias("trigger"),
                        F.greatest(F.lit(0).cast("long"), F.col("_trigger") - before).alias("start"),
                        F.least(F.col("_duration"), F.col("_trigger") + after).alias("end")).filter(F.col("end") > F.col("start"))


def frame_choice(events: DataFrame, evidence_frames: Column, fallback: Column, cap: int = 50) -> DataFrame:
    """First non-null evidence frame of each event, else the fallback; the first ``cap`` by frame."""
    picked = F.coalesce(F.try_element_at(F.filter(evidence_frames, lambda f: f.isNotNull()), F.lit(1)), fallback)
    rows = events.withColumn("frame", picked)
    return top_per_group(rows, ["video_id"], ["frame", "t", "seq"], cap, "_rn").drop("_rn")


def priority_fill(evidence: DataFrame, phases: DataFrame, backlog: DataFrame, cap: int = 72, floor: int = 40) -> DataFrame:
    """Evidence moments first, phase frames up to ``cap``, then combat events up to ``floor`` in total."""
    cols = ["video_id", "rid", "t", "seq"]
    first = evidence.select(*cols, F.lit(0).alias("tier")).unionByName(phases.select(*cols, F.lit(1).alias("tier")))
    first = top_per_group(first, ["video_id"], ["tier", "rid", "t", "seq"], cap, "_rn").drop("_rn")
    held = first.groupBy("video_id").agg(F.count(F.lit(1)).alias("_held"))
    rest = top_per_group(backlog.select(*cols, F.lit(2).alias("tier")), ["video_id"], ["rid", "t", "seq"], floor, "_rn")
    rest = rest.join(held, "video_id", "left").filter(F.col("_rn") <= floor - F.coalesce("_held", F.lit(0)))
    return first.unionByName(rest.select(*cols, "tier"))
