"""Suggestion rules per round and per match, ranking and summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from matchloom.operators.blocks import durable
from matchloom.operators.rules import Rule, fire
from matchloom.operators.scan import islands, scan
from matchloom.operators.sessions import top_per_group

ROUND = ["video_id", "rid"]
PER_BLOCK = 4096


def rid_block() -> Column:
    return F.floor(F.col("rid") / PER_BLOCK).cast("long")


def round_rules(unit: float) -> list[Rule]:
    """Round-level suggestions with their fixed confidences."""
    return [
        Rule("death_heavy", "deaths > 0 AND deaths > kills", ".75", "positioning", at="coalesce(first_death, s)"),
        Rule("aggressive", "kills >= 2 AND deaths = 0", ".80", "aim", at="coalesce(first_kill, s)"),
        Rule("no_combat", f"kills = 0 AND deaths = 0 AND engagements = 0 AND duration >= 30 * {unit}", ".60", "teamplay", at="s"),
        Rule("combat_density", f"kills + deaths >= 2 AND duration > 0 AND (kills + deaths) / (duration / {unit}) * 60 >= 3.0",
             ".70", "positioning", at="coalesce(first_kill, s)"),
    ]


def engagement_rule(unit: float) -> Column:
    """Action by engagement level and the offset of the first shot."""
    offset = F.col("first_shot_offset") / F.lit(unit)
    return (F.when(F.col("engagement_level") != "likely_firefight", "engagement_review")
            .when(offset.isNull() & (F.col("damages") > 0), "incoming_damage_review")
            .when(offset < -0.05, "precontact_fire_review")
            .when(offset <= 0.75, "immediate_fire_review")
            .otherwise("delayed_fire_review"))


def match_size(stats: DataFrame) -> DataFrame:
    return stats.groupBy("video_id").agg(F.max("rid").alias("size"))


def kd_trend(stats: DataFrame) -> DataFrame:
    """Kills per death of the two halves; recordings with three or more rounds.

    The size of a recording reaches its rounds through the block table, so a
    recording with very many rounds is joined block by block.
    """
    blocks = stats.select("video_id", rid_block().alias("_b")).distinct().join(match_size(stats), "video_id")
    r = stats.withColumn("_b", rid_block()).join(blocks, ["video_id", "_b"]).filter("size >= 3").withColumn("mid", F.floor(F.col("size") / 2))
    early = F.col("rid") <= F.col("mid")
    part = lambda cond, col: F.sum(F.when(cond, F.col(col)).otherwise(0))
    g = r.groupBy("video_id").agg(
        part(early, "kills").alias("ek"), part(early, "deaths").alias("ed"),
        part(~early, "kills").alias("lk"), part(~early, "deaths").alias("ld"),
        F.max(F.when(F.col("rid") == F.col("mid") + 1, F.col("s"))).alias("at"))
    rate = lambda k, d: F.col(k) / F.greatest(F.col(d), F.lit(1))
    g = g.select("video_id", "at", rate("ek", "ed").alias("early"), rate("lk", "ld").alias("late"))
    diff = F.col("late") - F.col("early")
    return g.withColumn("trend", F.when(diff > .5, "kd_improving").when(diff < -.5, "kd_declining"))


def early_deaths(stats: DataFrame, deaths: DataFrame, limit) -> DataFrame:
    """Deaths soon after the start of closed rounds; needs two of them and three closed rounds.

    ``deaths`` holds video_id, rid, since_start.
    """
    closed = stats.filter("e IS NOT NULL")
    total = closed.groupBy("video_id").agg(F.count(F.lit(1)).alias("total"))
    soon = deaths.filter(F.col("since_start") < limit).join(closed.select(*ROUND), ROUND, "left_semi")
    soon = soon.groupBy("video_id").agg(F.count(F.lit(1)).alias("early"))
    first = stats.filter("rid = 1").select("video_id", F.col("s").alias("at"))
    return total.join(soon, "video_id").filter("total >= 3 AND early >= 2").join(first, "video_id")


def loss_streak(stats: DataFrame, alert: int = 3) -> DataFrame:
    """Longest run of rounds without more kills than deaths; its time is counted from the last round."""
    r = stats.withColumn("lost", F.col("kills") <= F.col("deaths"))
    runs = islands(r, ["video_id"], ["rid"], rid_block(), {"l": F.col("lost")}, lambda p, c: p["l"] != c["l"], "run")
    longest = runs.filter("lost").groupBy("video_id", "run").agg(F.count(F.lit(1)).alias("len")).groupBy("video_id").agg(
        F.max("len").alias("streak")).filter(F.col("streak") >= alert)
    longest = longest.join(match_size(stats), "video_id").withColumn("rid", F.col("size") - F.col("streak") + 1)
    return longest.join(stats.select(*ROUND, F.col("s").alias("at")), ROUND).select("video_id", "streak", "at")


def consistency(stats: DataFrame) -> DataFrame:
    """Recordings whose kills per round stray two or more from their mean."""
    g = stats.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("kills").alias("avg"), F.min("kills").alias("low"), F.max("kills").alias("high"),
        F.min_by("s", "rid").alias("at"))
    dev = F.greatest(F.col("high") - F.col("avg"), F.col("avg") - F.col("low"))
    return g.filter((F.col("n") >= 3) & (dev >= 2) & (F.col("avg") > 0))


def suggestions(
    stats: DataFrame, engagements: DataFrame, moments: DataFrame, native_deaths: DataFrame,
    death_offsets: DataFrame, unit: float,
) -> DataFrame:
    """All suggestions of a match in emission order with numbered ids.

    ``engagements``: rid, episode, first_t, engagement_level, first_shot_offset, damages, confidence;
    ``moments``: rid, moment_index, moment_kind, first_t, duration; ``native_deaths``: rid, t, confidence.
    """
    cols = [*ROUND, "stage", "pos", "name", "category", "at", "confidence", "action"]

    def shaped(df, stage, pos, name, category, at, confidence, action):
        return df.select(*ROUND, F.lit(stage).alias("stage"), pos.cast("long").alias("pos"), name.alias("name"),
                         F.lit(category).alias("category"), at.cast("long").alias("at"),
                         confidence.cast("double").alias("confidence"), action.alias("action"))

    rid = F.col("rid").cast("string")
    top = engagements.filter(F.col("episode") <= 3)
    parts = [shaped(top, 0, F.col("episode"), F.concat(F.lit("engagement_"), rid, F.lit("_"), F.format_string("%02d", "episode")),
                    "game_sense", F.col("first_t"), F.col("confidence"), engagement_rule(unit))]
    quiet = stats.join(engagements.select(*ROUND).distinct(), ROUND, "left_anti").filter("first_visible IS NOT NULL")
    parts.append(shaped(quiet, 1, F.lit(0), F.concat(F.lit("contact_context_"), rid), "game_sense",
                        F.col("s") + F.col("first_visible"), F.lit(.80), F.lit("contact_context")))
    flash = moments.filter((F.col("moment_kind") == "flash") & (F.col("duration") >= 2.0 * unit))
    parts.append(shaped(flash, 2, F.col("moment_index"), F.concat(F.lit("flash_"), rid), "utility", F.col("first_t"), F.lit(.84), F.lit("flash_exposure")))
    scope = moments.filter((F.col("moment_kind") == "scope") & (F.col("duration") >= 8.0 * unit))
    parts.append(shaped(scope, 2, F.col("moment_index"), F.concat(F.lit("scope_hold_"), rid), "positioning", F.col("first_t"), F.lit(.82), F.lit("scope_hold")))
    parts.append(shaped(native_deaths, 3, F.lit(0), F.concat(F.lit("native_death_"), rid), "positioning", F.col("t"), F.col("confidence"), F.lit("native_death_review")))
    fired = fire(stats, round_rules(unit), ROUND)
    parts.append(fired.select(*ROUND, F.lit(4).alias("stage"), F.col("rule_no").cast("long").alias("pos"),
                              F.concat("name", F.lit("_"), rid).alias("name"), "category", "at", "confidence", F.col("name").alias("action")))
    last = F.lit(1 << 40).cast("long").alias("rid")

    def match_level(df, pos, name, category, confidence):
        return df.select("video_id", last, F.lit(5).alias("stage"), F.lit(pos).cast("long").alias("pos"), name.alias("name"),
                         category.alias("category"), F.col("at").cast("long").alias("at"), confidence.cast("double").alias("confidence"),
                         name.alias("action"))

    trend = kd_trend(stats).filter("trend IS NOT NULL")
    better = F.col("trend") == "kd_improving"
    parts.append(match_level(trend, 0, F.col("trend"), F.when(better, "aim").otherwise("game_sense"), F.when(better, .75).otherwise(.70)))
    parts.append(match_level(early_deaths(stats, death_offsets, 30 * unit), 1, F.lit("early_deaths"), F.lit("positioning"), F.lit(.80)))
    parts.append(match_level(loss_streak(stats), 2, F.lit("loss_streak"), F.lit("game_sense"), F.lit(.75)))
    parts.append(match_level(consistency(stats), 3, F.lit("inconsistent"), F.lit("aim"), F.lit(.70)))
    union = parts[0].select(*cols)
    for p in parts[1:]:
        union = union.unionByName(p.select(*cols))
    union = durable(union)  # numbering reads it twice
    ranked = scan(union, ["video_id"], ["rid", "stage", "pos", "name"], rid_block(), rank="_n")
    return ranked.select(
        "video_id", F.when(F.col("rid") < (1 << 40), F.col("rid")).alias("rid"),
        F.concat("category", F.lit("_"), "name", F.format_string("_%02d", "_n")).alias("suggestion_id"),
        "category", "action", "at", "confidence")


def top_suggestions(rows: DataFrame, n: int = 12) -> DataFrame:
    return top_per_group(rows, ["video_id"], [F.col("confidence").desc(), "at", "suggestion_id"], n, "rank")


def coach_summary(rows: DataFrame, overview: DataFrame) -> DataFrame:
    """Strength, weakness and focus keys from category counts and the kill/death ratio."""
    has = lambda text: F.col("suggestion_id").contains(text)
    neutral = has("contact_context_") | has("no_combat_") | has("engagement_")
    cat = lambda name: F.count_if(~neutral & (F.col("category") == name))
    g = rows.groupBy("video_id").agg(
        cat("aim").alias("aim"), cat("positioning").alias("positioning"), cat("game_sense").alias("game_sense"),
        cat("teamplay").alias("teamplay"), F.coalesce(F.bool_or(has("early_deaths")), F.lit(False)).alias("early"),
        F.bool_or(has("inconsistent")).alias("uneven"), F.bool_or(has("streak")).alias("streak"))
    j = overview.join(g, "video_id", "left").fillna(0, ["aim", "positioning", "game_sense", "teamplay"]).fillna(
        False, ["early", "uneven", "streak"])
    ratio = F.col("kills") / F.greatest(F.col("deaths"), F.lit(1))
    pick = lambda *pairs: F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]))
    pos, sense, team = F.col("positioning") >= 2, F.col("game_sense") >= 2, F.col("teamplay") >= 1
    strengths = pick((ratio >= 1.5, "kd_strong"), ((ratio >= .8) & (ratio < 1.5), "kd_balanced"), (F.col("aim") >= 2, "aim"))
    weaknesses = pick((ratio < .8, "kd_low"), (pos, "positioning"), (sense, "game_sense"), (team, "teamplay"),
                      (F.col("early"), "early_death"), (F.col("uneven"), "consistency"), (F.col("streak"), "streak"))
    drills = pick((pos, "positioning"), (sense, "game_sense"), (F.col("early"), "early_death"), (F.col("uneven"), "consistency"))
    focus = pick((pos, "positioning"), (sense, "game_sense"), (team, "teamplay"), (F.col("streak"), "streak"))
    text = lambda arr: F.when(F.size(arr) > 0, F.array_join(arr, ",")).otherwise("default")
    return j.select("video_id", text(strengths).alias("strengths"), text(weaknesses).alias("weaknesses"),
                    text(drills).alias("drills"), text(focus).alias("focus"),
                    F.when(F.size(strengths) >= F.size(weaknesses), "solid").otherwise("growth").alias("assessment"))


def field_lists(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Comma-joined names of known and of missing fields (an empty list is missing)."""
    known = F.array_compact(F.array(*[F.when(c.isNotNull(), F.lit(n)) for n, c in fields.items()]))
    missing = F.array_compact(F.array(*[F.when(c.isNull(), F.lit(n)) for n, c in fields.items()]))
    return df.withColumn("known", F.when(F.size(known) > 0, F.array_join(known, ", ")).otherwise("unavailable")).withColumn(
        "missing", F.array_join(missing, ", "))
