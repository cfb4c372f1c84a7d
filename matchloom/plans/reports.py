"""Round statistics, findings, suggestions and evidence plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.operators import coaching as co
from matchloom.operators import reports as rp
from matchloom.operators import sessions as ss
from matchloom.operators.blocks import durable
from matchloom.operators.intervals import overlap_counts
from matchloom.plans.combat import DEATHS, DET, engagements, status_samples
from matchloom.plans.joins import EP, EV, engine_events, episodes
from matchloom.plans.registry import HOUR, KEY, S, View, on_rounds, query, running
from matchloom.plans.timeline import MOMENTS, RS, moments, refinement_windows_of, round_samples
from matchloom.plans.timeline import TRIG

UNIT = HOUR // 2

ST = """st0 AS (SELECT video_id, rid, min(CASE WHEN type='round_start' THEN t END) AS s, max(CASE WHEN type='round_end' THEN t END) AS e, count(*) AS n,
  count(*) FILTER (type='player_kill') AS kills, count(*) FILTER (type='player_death') AS deaths, count(*) FILTER (k % 2 = 0) AS killfeed,
  count(*) FILTER (type='engagement_candidate') AS engagements, count(*) FILTER (type='engagement_candidate' AND k % 2 = 0) AS likely_firefights,
  count(*) FILTER (type='engagement_candidate' AND k % 3 > 0) AS shot_windows, count(*) FILTER (type='engagement_candidate' AND k % 4 > 0) AS damage_windows,
  min(CASE WHEN type='player_death' THEN t END) AS first_death, min(CASE WHEN type='player_kill' THEN t END) AS first_kill,
  min(CASE WHEN type='engagement_candidate' AND k < 50 THEN t END) AS seen FROM a GROUP BY video_id, rid),
stt0 AS (SELECT * EXCLUDE (seen), greatest(0, seen - s) AS first_visible, e - s AS duration, CASE WHEN e IS NOT NULL AND video_id % 4 <> 0 THEN coalesce(first_death, e) - s END AS survival FROM st0)"""


def stats_of(v: View):
    k = F.col("k")
    return rp.round_stats(v.attached(), (F.col("type") == "engagement_candidate") & (k < 50), k % 2 == 0, k % 3, k % 4, k % 2 == 0, F.col("video_id") % 4 != 0)


@query("round_stats", on_rounds("SELECT * FROM stt0", ST))
def round_stats(v: View):
    return stats_of(v)


@query("round_track_counts", on_rounds("""
, tk AS (SELECT *, CASE WHEN episode % 3 = 0 THEN 'enemy' WHEN episode % 3 = 1 THEN 'teammate' ELSE 'unknown' END AS label FROM ep),
p AS (SELECT tk.video_id, label, rid FROM tk JOIN r ON r.video_id = tk.video_id AND r.e IS NOT NULL AND first_t < e AND last_t >= s
  UNION ALL SELECT tk.video_id, label, rid FROM tk JOIN r ON r.video_id = tk.video_id AND r.e IS NULL AND first_t >= s)
SELECT r.video_id, r.rid, count(*) FILTER (label = 'enemy') AS enemy_tracks, count(*) FILTER (label = 'teammate') AS teammate_tracks
FROM r LEFT JOIN p ON p.video_id = r.video_id AND p.rid = r.rid GROUP BY r.video_id, r.rid""".replace("\n, tk", ", tk", 1), EP))
def round_track_counts(v: View):
    label = F.when(F.col("episode") % 3 == 0, "enemy").when(F.col("episode") % 3 == 1, "teammate").otherwise("unknown")
    rounds = v.rounds().select("video_id", "rid", "s", "e")
    counts = {"enemy_tracks": F.col("label") == "enemy", "teammate_tracks": F.col("label") == "teammate"}
    tracks = episodes(v).withColumn("label", label)
    return overlap_counts(tracks, rounds, KEY, "first_t", "last_t", "s", "e", 12 * HOUR, counts).select("video_id", "rid", *counts)


@query("match_overview", on_rounds("""
SELECT video_id, count(*) AS rounds, CAST(sum(kills) AS BIGINT) AS kills, count(*) FILTER (deaths > 0) AS deaths, round(avg(survival) / 1800000000, 3) AS avg_survival,
  CAST(sum(engagements) AS BIGINT) AS engagements, CAST(sum(likely_firefights) AS BIGINT) AS likely_firefights FROM stt0 GROUP BY video_id""", ST))
def match_overview(v: View):
    return rp.match_overview(stats_of(v)).withColumn("avg_survival", F.round(F.col("avg_survival") / UNIT, 3))


@query("capability_gates", on_rounds("""
, c AS (SELECT video_id, CASE WHEN sum(kills) % 3 = 0 THEN NULL ELSE sum(kills) > 5 END AS pk, CASE WHEN sum(kills) % 2 = 0 THEN NULL ELSE sum(deaths) > 5 END AS pc, sum(kills) AS kills FROM stt0 GROUP BY 1)
SELECT video_id, coalesce(pc, true) AS personal_combat, coalesce(pk, pc, true) AS personal_kills, CASE WHEN coalesce(pk, pc, true) THEN CAST(kills AS BIGINT) END AS kills FROM c""".replace("\n, c", ", c", 1), ST))
def capability_gates(v: View):
    g = stats_of(v).groupBy("video_id").agg(F.sum("kills").alias("k"), F.sum("deaths").alias("d"))
    pk = F.when(F.col("k") % 3 != 0, F.col("k") > 5)
    pc = F.when(F.col("k") % 2 != 0, F.col("d") > 5)
    kills = F.coalesce(pk, pc, F.lit(True))
    return g.select("video_id", F.coalesce(pc, F.lit(True)).alias("personal_combat"), kills.alias("personal_kills"),
                    F.when(kills, F.col("k")).alias("kills"))


@query("post_death_filter", on_rounds("""
, d AS (SELECT video_id, rid, min(t) AS d FROM a WHERE type = 'player_death' GROUP BY 1, 2)
SELECT a.video_id, a.rid, count(*) AS kept, count(*) FILTER (a.type = 'player_kill') AS kills FROM a LEFT JOIN d USING (video_id, rid)
WHERE d IS NULL OR a.t <= d OR type IN ('round_start','round_end') GROUP BY 1, 2""".replace("\n, d", ", d", 1)))
def post_death_filter(v: View):
    kept = rp.post_death_filter(v.attached())
    return kept.groupBy("video_id", "rid").agg(F.count(F.lit(1)).alias("kept"), F.count_if(F.col("type") == "player_kill").alias("kills"))


@query("post_death_rounds", on_rounds("SELECT video_id, rid, s, CASE WHEN first_death < e THEN first_death ELSE e END AS e FROM stt0", ST))
def post_death_rounds(v: View):
    return rp.post_death_rounds(stats_of(v)).select("video_id", "rid", "s", "e")


@query("density", on_rounds("""
SELECT video_id, rid, round((kills + deaths) / (duration / 1800000000.0) * 60, 3) AS density FROM stt0
WHERE kills + deaths >= 2 AND duration > 0 AND (kills + deaths) / (duration / 1800000000.0) * 60 >= 3""", ST))
def density(v: View):
    s = stats_of(v).filter("kills + deaths >= 2 AND duration > 0")
    return s.withColumn("density", (F.col("kills") + F.col("deaths")) / (F.col("duration") / UNIT) * 60).filter("density >= 3").select(
        "video_id", "rid", F.round("density", 3).alias("density"))


KD = """sz AS (SELECT video_id, max(rid) AS sz FROM stt0 GROUP BY 1),
kd0 AS (SELECT stt0.video_id, max(CASE WHEN rid = sz // 2 + 1 THEN s END) AS "at",
  sum(CASE WHEN rid <= sz // 2 THEN kills ELSE 0 END) / greatest(sum(CASE WHEN rid <= sz // 2 THEN deaths ELSE 0 END), 1) AS early,
  sum(CASE WHEN rid > sz // 2 THEN kills ELSE 0 END) / greatest(sum(CASE WHEN rid > sz // 2 THEN deaths ELSE 0 END), 1) AS late
  FROM stt0 JOIN sz USING (video_id) WHERE sz >= 3 GROUP BY stt0.video_id),
kd AS (SELECT *, CASE WHEN late - early > .5 THEN 'kd_improving' WHEN late - early < -.5 THEN 'kd_declining' END AS trend FROM kd0),
ed0 AS (SELECT a.video_id, count(*) AS early FROM a JOIN r USING (video_id, rid) WHERE r.e IS NOT NULL AND a.type = 'player_death' AND a.t - r.s < 54000000000 GROUP BY 1),
ed AS (SELECT video_id, total, early, s AS "at" FROM (SELECT video_id, count(*) AS total FROM r WHERE e IS NOT NULL GROUP BY 1) JOIN ed0 USING (video_id)
  JOIN (SELECT video_id, s FROM r WHERE rid = 1) USING (video_id) WHERE total >= 3 AND early >= 2),
ls0 AS (SELECT video_id, rid, s, kills <= deaths AS lost, rid - row_number() OVER (PARTITION BY video_id, kills <= deaths ORDER BY rid) AS g FROM stt0),
ls1 AS (SELECT video_id, max(c) AS streak FROM (SELECT video_id, g, count(*) AS c FROM ls0 WHERE lost GROUP BY 1, 2) GROUP BY 1 HAVING max(c) >= 3),
ls AS (SELECT ls1.video_id, streak, stt0.s AS "at" FROM ls1 JOIN sz USING (video_id) JOIN stt0 ON stt0.video_id = ls1.video_id AND stt0.rid = sz - streak + 1),
cn AS (SELECT video_id, count(*) AS n, avg(kills) AS avg, min(kills) AS low, max(kills) AS high, arg_min(s, rid) AS "at" FROM stt0 GROUP BY 1
  HAVING count(*) >= 3 AND greatest(max(kills) - avg(kills), avg(kills) - min(kills)) >= 2 AND avg(kills) > 0)"""


@query("kd_trend", on_rounds('SELECT video_id, "at", round(early, 4) AS early, round(late, 4) AS late, trend FROM kd', ST, KD))
def kd_trend(v: View):
    return co.kd_trend(durable(stats_of(v))).withColumn("early", F.round("early", 4)).withColumn("late", F.round("late", 4))


def death_offsets(v: View):
    a = v.attached(last=running()["last"])
    return a.filter("type = 'player_death'").select("video_id", "rid", (F.col("t") - F.col("_s")).alias("since_start"))


@query("early_deaths", on_rounds('SELECT video_id, total, early, "at" FROM ed', ST, KD))
def early_deaths(v: View):
    return co.early_deaths(durable(stats_of(v)), death_offsets(v), 30 * UNIT)


@query("loss_streak", on_rounds('SELECT video_id, streak, "at" FROM ls', ST, KD))
def loss_streak(v: View):
    return co.loss_streak(durable(stats_of(v)))


@query("consistency", on_rounds('SELECT video_id, n, round(avg, 4) AS avg, low, high, "at" FROM cn', ST, KD))
def consistency(v: View):
    return co.consistency(stats_of(v)).withColumn("avg", F.round("avg", 4))


def gated_stats(v: View):
    """Round statistics with capability flags and the view summary."""
    stats = stats_of(v)
    view = ss.weighted_round_summary(round_samples(v), ["video_id", "rid"], F.col("w"), F.col("flashed"), F.col("scoped"), F.col("motion"))
    return durable(stats.join(view.select("video_id", "rid", "flash_time", "scope_time", F.lit(True).alias("has_view")), ["video_id", "rid"], "left").select(
        "*", F.coalesce("has_view", F.lit(False)).alias("hv"), (F.col("video_id") % 3 != 0).alias("personal_kills"),
        (F.col("video_id") % 4 != 0).alias("personal_deaths"), (F.col("n") % 3).alias("enemy_tracks")).drop("has_view").withColumnRenamed("hv", "has_view"))


def gated_overview(v: View, stats):
    return rp.match_overview(stats).select(
        "*", (F.col("video_id") % 3 != 0).alias("personal_kills"), (F.col("video_id") % 4 != 0).alias("personal_deaths"),
        F.array_compact(F.array(*[F.when(F.col("video_id") % n == 0, w) for n, w in ((5, "partial"), (2, "timed out"), (7, "no native combat"))])).alias("warnings"))


FIND = """vw AS (SELECT video_id, rid, sum(CASE WHEN flashed THEN w ELSE 0 END) AS flash_time, sum(CASE WHEN scoped THEN w ELSE 0 END) AS scope_time FROM rs GROUP BY 1, 2),
gs AS (SELECT stt0.*, flash_time, scope_time, vw.video_id IS NOT NULL AS has_view, video_id % 3 <> 0 AS pk, video_id % 4 <> 0 AS pd FROM stt0 LEFT JOIN vw USING (video_id, rid)),
ov AS (SELECT video_id, CAST(sum(kills) AS BIGINT) AS kills, count(*) FILTER (deaths > 0) AS deaths, video_id % 3 <> 0 AS pk, video_id % 4 <> 0 AS pd FROM stt0 GROUP BY video_id),
fi AS (
 SELECT video_id, rid, 0 AS no, 'round_flow_start' AS name, 'round_flow' AS category, 'info' AS severity, .95 AS confidence FROM gs
 UNION ALL SELECT video_id, rid, 1, 'round_flow_end', 'round_flow', 'info', .90 FROM gs WHERE e IS NOT NULL
 UNION ALL SELECT video_id, rid, 2, 'round_flow_truncated', 'round_flow', 'warning', .80 FROM gs WHERE e IS NULL
 UNION ALL SELECT video_id, rid, 3, 'combat_kills', 'combat', 'info', .55 FROM gs WHERE pk AND kills > 0
 UNION ALL SELECT video_id, rid, 4, 'combat_deaths', 'combat', 'warning', .85 FROM gs WHERE pd AND deaths > 0
 UNION ALL SELECT video_id, rid, 5, 'combat_none', 'combat', 'info', .70 FROM gs WHERE pk AND pd AND kills = 0 AND deaths = 0
 UNION ALL SELECT video_id, rid, 6, 'movement_enemy_first_visible', 'movement', 'info', .80 FROM gs WHERE first_visible IS NOT NULL
 UNION ALL SELECT video_id, rid, 7, 'movement_enemy_tracks', 'movement', 'info', .75 FROM gs WHERE n % 3 > 0
 UNION ALL SELECT video_id, rid, 8, 'combat_likely_firefight', 'combat', 'info', .76 FROM gs WHERE likely_firefights > 0
 UNION ALL SELECT video_id, rid, 9, 'movement_flash', 'utility', 'warning', .88 FROM gs WHERE has_view AND flash_time > 0
 UNION ALL SELECT video_id, rid, 10, 'movement_scope', 'movement', 'info', .86 FROM gs WHERE has_view AND scope_time > 0
 UNION ALL SELECT video_id, rid, 11, 'movement_view_dynamics', 'movement', 'info', .80 FROM gs WHERE has_view
 UNION ALL SELECT video_id, NULL, 100, 'match_rounds', 'round_flow', 'info', 1.0 FROM ov
 UNION ALL SELECT video_id, NULL, 101, 'match_total_kills', 'combat', 'info', .55 FROM ov WHERE pk AND kills > 0
 UNION ALL SELECT video_id, NULL, 102, 'match_total_deaths', 'combat', 'warning', .85 FROM ov WHERE pd AND deaths > 0
 UNION ALL SELECT video_id, NULL, 103 + i, 'match_warning_' || i, 'round_flow', 'warning', .90 FROM (SELECT video_id, unnest(range((video_id % 5 = 0)::INT + (video_id % 2 = 0)::INT + (video_id % 7 = 0)::INT)) AS i FROM ov)
 UNION ALL SELECT video_id, NULL, 110, 'match_no_combat', 'combat', 'info', .70 FROM ov WHERE pk AND pd AND kills = 0 AND deaths = 0)"""


@query("findings", on_rounds("""
SELECT video_id, rid, name || '_' || lpad(CAST(row_number() OVER (PARTITION BY video_id ORDER BY rid NULLS LAST, no) AS VARCHAR), 3, '0') AS finding_id, category, severity, CAST(confidence AS DOUBLE) AS confidence FROM fi""", S.format("a"), RS, ST, FIND))
def findings(v: View):
    stats = gated_stats(v)
    return rp.findings(stats, gated_overview(v, stats))


SUG = """mo AS (SELECT * FROM moments),
su AS (
 SELECT video_id, rid, 0 AS stage, episode AS pos, 'engagement_' || rid || '_' || lpad(CAST(episode AS VARCHAR), 2, '0') AS name, 'game_sense' AS category, first_t AS "at", confidence,
  CASE WHEN engagement_level <> 'likely_firefight' THEN 'engagement_review' WHEN first_shot_offset IS NULL AND damages > 0 THEN 'incoming_damage_review' WHEN first_shot_offset / 1800000000.0 < -.05 THEN 'precontact_fire_review'
   WHEN first_shot_offset / 1800000000.0 <= .75 THEN 'immediate_fire_review' ELSE 'delayed_fire_review' END AS action FROM eng WHERE episode <= 3
 UNION ALL SELECT video_id, rid, 1, 0, 'contact_context_' || rid, 'game_sense', s + first_visible, .80, 'contact_context' FROM stt0 WHERE first_visible IS NOT NULL AND NOT EXISTS (SELECT 1 FROM eng WHERE eng.video_id = stt0.video_id AND eng.rid = stt0.rid)
 UNION ALL SELECT video_id, rid, 2, moment_index, 'flash_' || rid, 'utility', first_t, .84, 'flash_exposure' FROM mo WHERE moment_kind = 'flash' AND duration >= 3600000000
 UNION ALL SELECT video_id, rid, 2, moment_index, 'scope_hold_' || rid, 'positioning', first_t, .82, 'scope_hold' FROM mo WHERE moment_kind = 'scope' AND duration >= 14400000000
 UNION ALL SELECT video_id, rid, 3, 0, 'native_death_' || rid, 'positioning', t, CASE WHEN method = 'card' OR damage_near THEN .9 ELSE .84 END, 'native_death_review' FROM pick WHERE video_id IN (SELECT video_id FROM gate)
 UNION ALL SELECT video_id, rid, 4, 0, 'death_heavy_' || rid, 'positioning', coalesce(first_death, s), .75, 'death_heavy' FROM stt0 WHERE deaths > 0 AND deaths > kills
 UNION ALL SELECT video_id, rid, 4, 1, 'aggressive_' || rid, 'aim', coalesce(first_kill, s), .80, 'aggressive' FROM stt0 WHERE kills >= 2 AND deaths = 0
 UNION ALL SELECT video_id, rid, 4, 2, 'no_combat_' || rid, 'teamplay', s, .60, 'no_combat' FROM stt0 WHERE kills = 0 AND deaths = 0 AND engagements = 0 AND duration >= 54000000000
 UNION ALL SELECT video_id, rid, 4, 3, 'combat_density_' || rid, 'positioning', coalesce(first_kill, s), .70, 'combat_density' FROM stt0 WHERE kills + deaths >= 2 AND duration > 0 AND (kills + deaths) / (duration / 1800000000.0) * 60 >= 3
 UNION ALL SELECT video_id, NULL, 5, 0, trend, CASE trend WHEN 'kd_improving' THEN 'aim' ELSE 'game_sense' END, "at", CASE trend WHEN 'kd_improving' THEN .75 ELSE .70 END, trend FROM kd WHERE trend IS NOT NULL
 UNION ALL SELECT video_id, NULL, 5, 1, 'early_deaths', 'positioning', "at", .80, 'early_deaths' FROM ed
 UNION ALL SELECT video_id, NULL, 5, 2, 'loss_streak', 'game_sense', "at", .75, 'loss_streak' FROM ls
 UNION ALL SELECT video_id, NULL, 5, 3, 'inconsistent', 'aim', "at", .70, 'inconsistent' FROM cn),
sug AS (SELECT video_id, rid, category || '_' || name || '_' || lpad(CAST(rn AS VARCHAR), CAST(greatest(2, length(CAST(rn AS VARCHAR))) AS INTEGER), '0') AS suggestion_id, category, action, "at", round(confidence, 3) AS confidence
 FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY rid NULLS LAST, stage, pos, name) AS rn FROM su))"""
SUG_PARTS = (S.format("m"), DET, S.format("a").replace("smp AS", "smp_a AS"), RS.replace("smp.", "smp_a.").replace("FROM smp JOIN", "FROM smp_a JOIN"),
             MOMENTS.replace("ELSE 8*3600000000", "ELSE 7200000000").replace("THEN 2*3600000000", "THEN 1800000000"),
             DEATHS.format(u="(9*3600000000)", share=.1), ST, KD, SUG)


def suggestions_of(v: View):
    from matchloom.operators.combat import native_deaths
    v = v if v.kept is not None else v.settled()
    deaths = native_deaths(v.rounds(), status_samples(v), v.width, 9.0 * HOUR, min_eligible=.1)
    out = co.suggestions(durable(stats_of(v)), durable(engagements(v)), durable(moments(v, 1 * UNIT, 4 * UNIT)), deaths, death_offsets(v), float(UNIT))
    return out.withColumn("confidence", F.round("confidence", 3))


@query("suggestions", on_rounds("SELECT * FROM sug", *SUG_PARTS))
def suggestions(v: View):
    return suggestions_of(v)


@query("suggestion_topn", on_rounds("""
SELECT video_id, suggestion_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY confidence DESC, "at", suggestion_id) AS rank FROM sug) WHERE rank <= 12""", *SUG_PARTS))
def suggestion_topn(v: View):
    return co.top_suggestions(suggestions_of(v)).select("video_id", "suggestion_id", F.col("rank").cast("long").alias("rank"))


@query("coach_summary", on_rounds("""
, g AS (SELECT video_id, count(*) FILTER (d AND category = 'aim') AS aim, count(*) FILTER (d AND category = 'positioning') AS pos, count(*) FILTER (d AND category = 'game_sense') AS sense, count(*) FILTER (d AND category = 'teamplay') AS team,
  bool_or(contains(suggestion_id, 'early_deaths')) AS early, bool_or(contains(suggestion_id, 'inconsistent')) AS uneven, bool_or(contains(suggestion_id, 'streak')) AS streak
  FROM (SELECT *, NOT (contains(suggestion_id, 'contact_context_') OR contains(suggestion_id, 'no_combat_') OR contains(suggestion_id, 'engagement_')) AS d FROM sug) GROUP BY 1),
o AS (SELECT video_id, sum(kills) / greatest(count(*) FILTER (deaths > 0), 1) AS kd FROM stt0 GROUP BY 1),
l AS (SELECT video_id, list_filter([CASE WHEN kd >= 1.5 THEN 'kd_strong' END, CASE WHEN kd >= .8 AND kd < 1.5 THEN 'kd_balanced' END, CASE WHEN aim >= 2 THEN 'aim' END], lambda x: x IS NOT NULL) AS st,
  list_filter([CASE WHEN kd < .8 THEN 'kd_low' END, CASE WHEN pos >= 2 THEN 'positioning' END, CASE WHEN sense >= 2 THEN 'game_sense' END, CASE WHEN team >= 1 THEN 'teamplay' END, CASE WHEN early THEN 'early_death' END, CASE WHEN uneven THEN 'consistency' END, CASE WHEN streak THEN 'streak' END], lambda x: x IS NOT NULL) AS wk,
  list_filter([CASE WHEN pos >= 2 THEN 'positioning' END, CASE WHEN sense >= 2 THEN 'game_sense' END, CASE WHEN early THEN 'early_death' END, CASE WHEN uneven THEN 'consistency' END], lambda x: x IS NOT NULL) AS dr,
  list_filter([CASE WHEN pos >= 2 THEN 'positioning' END, CASE WHEN sense >= 2 THEN 'game_sense' END, CASE WHEN team >= 1 THEN 'teamplay' END, CASE WHEN streak THEN 'streak' END], lambda x: x IS NOT NULL) AS fo FROM o LEFT JOIN g USING (video_id))
SELECT video_id, CASE WHEN len(st) > 0 THEN array_to_string(st, ',') ELSE 'default' END AS strengths, CASE WHEN len(wk) > 0 THEN array_to_string(wk, ',') ELSE 'default' END AS weaknesses,
 CASE WHEN len(dr) > 0 THEN array_to_string(dr, ',') ELSE 'default' END AS drills, CASE WHEN len(fo) > 0 THEN array_to_string(fo, ',') ELSE 'default' END AS focus, CASE WHEN len(st) >= len(wk) THEN 'solid' ELSE 'growth' END AS assessment FROM l""".replace("\n, g", ", g", 1), *SUG_PARTS))
def coach_summary(v: View):
    v = v.settled()
    return co.coach_summary(suggestions_of(v), rp.match_overview(stats_of(v)))


@query("evidence_links", on_rounds("""
, f AS (SELECT *, name || '_' || lpad(CAST(row_number() OVER (PARTITION BY video_id ORDER BY rid NULLS LAST, no) AS VARCHAR), 3, '0') AS finding_id FROM fi)
SELECT f.video_id, f.rid, finding_id, ev.event_id, ev.source FROM f LEFT JOIN ev ON ev.video_id = f.video_id AND ev.rid = f.rid
 AND ((name = 'combat_kills' AND ev.type = 'player_kill') OR (name = 'combat_deaths' AND ev.type = 'player_death') OR (name = 'round_flow_start' AND ev.type = 'round_start') OR (name = 'round_flow_end' AND ev.type = 'round_end'))
WHERE f.rid IS NOT NULL""".replace("\n, f", ", f", 1), S.format("a"), RS, ST, FIND, EV))
def evidence_links(v: View):
    """One row per round, finding and evidence link; findings without evidence keep one empty link."""
    stats = gated_stats(v)
    f = rp.findings(stats, gated_overview(v, stats)).filter("rid IS NOT NULL")
    name = F.regexp_replace("finding_id", "_[0-9]+$", "")
    f = f.withColumn("type", F.when(name == "combat_kills", "player_kill").when(name == "combat_deaths", "player_death").when(
        name == "round_flow_start", "round_start").when(name == "round_flow_end", "round_end"))
    links = engine_events(v).select("video_id", "rid", "type", "event_id", "source")
    return f.join(links, ["video_id", "rid", "type"], "left").select("video_id", "rid", "finding_id", "event_id", "source")


@query("capabilities", on_rounds("""
, c AS (SELECT video_id, count(*) AS rounds, sum(kills) AS kills, sum(deaths) AS deaths, sum(engagements) AS eng FROM stt0 GROUP BY 1),
o AS (SELECT video_id, count(*) FILTER (k >= 45) AS overlay FROM m GROUP BY 1), w AS (SELECT video_id, count(*) AS windows, CAST(sum("end" - "start") AS BIGINT) AS refined FROM win GROUP BY 1)
SELECT o.video_id, coalesce(rounds, 0) > 0 AS round_detection, coalesce(kills, 0) > 0 AS personal_kills, coalesce(deaths, 0) > 0 AS personal_deaths,
 coalesce(kills, 0) > 0 AND coalesce(deaths, 0) > 0 AS personal_combat, coalesce(eng, 0) > 0 AS engagement_review, overlay AS overlay_frames, coalesce(windows, 0) AS refinement_windows, coalesce(refined, 0) AS refinement_time
FROM o LEFT JOIN c USING (video_id) LEFT JOIN w USING (video_id)""".replace("\n, c", ", c", 1), ST, S.format("m"), TRIG))
def capabilities(v: View):
    c = stats_of(v).groupBy("video_id").agg(F.count(F.lit(1)).alias("rounds"), F.sum("kills").alias("kills"), F.sum("deaths").alias("deaths"), F.sum("engagements").alias("eng"))
    o = v.m.groupBy("video_id").agg(F.count_if(F.col("k") >= 45).alias("overlay_frames"))
    w = refinement_windows_of(v).groupBy("video_id").agg(F.count(F.lit(1)).alias("refinement_windows"), F.sum(F.col("end") - F.col("start")).alias("refinement_time"))
    j = o.join(c, "video_id", "left").join(w, "video_id", "left").fillna(0)
    pos = lambda c: F.col(c) > 0
    return j.select("video_id", pos("rounds").alias("round_detection"), pos("kills").alias("personal_kills"), pos("deaths").alias("personal_deaths"),
                    (pos("kills") & pos("deaths")).alias("personal_combat"), pos("eng").alias("engagement_review"), "overlay_frames", "refinement_windows", "refinement_time")


@query("warning_choice", on_rounds("""
, c AS (SELECT video_id, video_id % 7 <> 0 AS complete, video_id % 14 <> 0 AS decoded, sum(kills) > 3 AS pk, sum(deaths) > 3 AS pd, max(coalesce(e, s)) AS processed FROM stt0 GROUP BY video_id)
SELECT video_id, CASE WHEN NOT complete AND NOT decoded THEN 'decode_partial' WHEN NOT complete THEN 'timed_out' WHEN pk AND pd THEN 'combat_native' WHEN pk THEN 'kills_native' WHEN pd THEN 'kills_unavailable' ELSE 'combat_unavailable' END AS warning,
 CASE WHEN NOT complete THEN processed END AS processed FROM c""".replace("\n, c", ", c", 1), ST))
def warning_choice(v: View):
    g = stats_of(v).groupBy("video_id").agg((F.sum("kills") > 3).alias("pk"), (F.sum("deaths") > 3).alias("pd"), F.max(F.coalesce("e", "s")).alias("p"))
    complete, decoded = F.col("video_id") % 7 != 0, F.col("video_id") % 14 != 0
    warn = (F.when(~complete & ~decoded, "decode_partial").when(~complete, "timed_out").when(F.col("pk") & F.col("pd"), "combat_native")
            .when(F.col("pk"), "kills_native").when(F.col("pd"), "kills_unavailable").otherwise("combat_unavailable"))
    return g.select("video_id", warn.alias("warning"), F.when(~complete, F.col("p")).alias("processed"))


@query("timeline_flat", on_rounds("""
SELECT video_id, rid, 'round_' || lpad(CAST(rid AS VARCHAR), 3, '0') AS round_id, type, round((t - min(t) OVER (PARTITION BY video_id, rid)) / 3600000000.0, 2) AS offset_hours,
 CAST(floor(t / 33333.0) AS BIGINT) AS frame_index, source FROM ev""", EV))
def timeline_flat(v: View):
    a = v.attached(last={"_s": F.when(F.col("type") == "round_start", F.col("t"))})
    s = F.coalesce(F.when(F.col("type") == "round_start", F.col("t")), F.col("_s"))
    ev = F.array(F.struct(F.floor(F.col("t") / 33333).alias("frame_index"), F.col("t").alias("timestamp"), F.when(
        F.col("k") % 2 == 0, "feed_rows").otherwise("highlight_scan").alias("source"), F.lit(None).cast("string").alias("asset_path")))
    rows = a.withColumn("evidence", F.transform(ev, lambda x: F.struct(x["frame_index"].alias("frame_index"), x["timestamp"].alias("timestamp"), x["source"].alias("source"))))
    return rows.select("video_id", "rid", F.format_string("round_%03d", "rid").alias("round_id"), "type",
                       F.round((F.col("t") - s) / HOUR, 2).alias("offset_hours"), F.col("evidence")[0]["frame_index"].alias("frame_index"), F.col("evidence")[0]["source"].alias("source"))


CLIP = """cl AS (SELECT video_id, rid, type || '_' || k AS event_id, t, seq, CASE WHEN k % 3 = 0 THEN t + 1800000000 ELSE t END AS trig FROM a WHERE type IN ('player_kill','player_death','engagement_candidate')),
du AS (SELECT video_id, max(t) AS dur FROM m GROUP BY 1),
c1 AS (SELECT *, row_number() OVER (PARTITION BY video_id, event_id ORDER BY rid, t, seq) AS d FROM cl)"""


def clip_events(v: View):
    a = v.attached().filter(F.col("type").isin("player_kill", "player_death", "engagement_candidate"))
    return a.select("video_id", "rid", F.concat_ws("_", "type", F.col("k").cast("string")).alias("event_id"), "t", "seq", "k", "type")


@query("clip_plan", on_rounds("""
SELECT video_id, event_id, trig AS trigger, greatest(0, trig - 7200000000) AS "start", least(dur, trig + 10800000000) AS "end" FROM (
 SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY rid, t, seq) AS p FROM c1 WHERE d = 1) JOIN du USING (video_id) WHERE p <= 12 AND least(dur, trig + 10800000000) > greatest(0, trig - 7200000000)""", CLIP))
def clip_plan(v: View):
    dur = v.m.groupBy("video_id").agg(F.max("t").alias("dur"))
    ev = clip_events(v).join(dur, "video_id")
    trig = F.when(F.col("k") % 3 == 0, F.col("t") + UNIT).otherwise(F.col("t"))
    return rp.clip_plan(ev, trig, F.col("dur"), 2 * HOUR, 3 * HOUR)


@query("frame_choice", on_rounds("""
SELECT video_id, seq, frame FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame, t, seq) AS p FROM (
 SELECT video_id, seq, t, coalesce(CASE WHEN k % 3 = 0 THEN k END, CASE WHEN k % 2 = 0 THEN k * 2 END, CAST(floor(t / 1000000000.0 * 30) AS BIGINT)) AS frame FROM a WHERE type LIKE 'player%')) WHERE p <= 50"""))
def frame_choice(v: View):
    a = v.attached().filter("type LIKE 'player%'")
    k = F.col("k").cast("long")
    out = rp.frame_choice(a, F.array(F.when(k % 3 == 0, k), F.when(k % 2 == 0, k * 2)), F.floor(F.col("t") / 1_000_000_000 * 30).cast("long"))
    return out.select("video_id", "seq", "frame")


@query("priority_fill", on_rounds("""
, e1 AS (SELECT video_id, rid, t, seq, 0 AS tier FROM a WHERE type IN ('engagement_candidate', 'player_death') UNION ALL SELECT video_id, rid, t, seq, 1 FROM a WHERE type = 'round_start'),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY tier, rid, t, seq) AS p FROM e1) WHERE p <= 72),
b AS (SELECT a.video_id, a.rid, a.t, a.seq, row_number() OVER (PARTITION BY a.video_id ORDER BY a.rid, a.t, a.seq) AS p FROM a JOIN r USING (video_id, rid) WHERE a.type IN ('player_kill','player_death') AND a.t - r.s > 12*3600000000),
h AS (SELECT video_id, count(*) AS held FROM f GROUP BY 1)
SELECT video_id, rid, seq, tier FROM f UNION ALL SELECT b.video_id, rid, seq, 2 FROM b LEFT JOIN h USING (video_id) WHERE p <= 40 - coalesce(held, 0)""".replace("\n, e1", ", e1", 1)))
def priority_fill(v: View):
    a = v.attached(last={"_s": F.when(F.col("type") == "round_start", F.col("t"))})
    backlog = a.filter(F.col("type").isin("player_kill", "player_death") & (F.col("t") - F.col("_s") > 12 * HOUR))
    return rp.priority_fill(a.filter(F.col("type").isin("engagement_candidate", "player_death")), a.filter("type = 'round_start'"), backlog).drop("t")


@query("first_n_per_round", on_rounds("""
SELECT video_id, rid, seq, n FROM (SELECT *, row_number() OVER (PARTITION BY video_id, rid ORDER BY t, seq) AS n FROM a WHERE type = 'engagement_candidate') WHERE n <= 3"""))
def first_n_per_round(v: View):
    e = v.attached().filter("type = 'engagement_candidate'")
    return ss.top_per_group(e, ["video_id", "rid"], ["t", "seq"], 3, "n").select("video_id", "rid", "seq", F.col("n").cast("long").alias("n"))
