"""Interval, nearest, overlap, merge and correction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.functions import templates as tpl
from matchloom.operators import joins as jj
from matchloom.operators import sessions as ss
from matchloom.operators.combat import first_round
from matchloom.operators.intervals import interval_join, overlap_join
from matchloom.plans.registry import HOUR, KEY, ORDER, S, View, on_events, on_rounds, query
from matchloom.plans.timeline import TRIG, refinement_windows_of


@query("point_in_round", on_rounds("""
SELECT m.video_id, m.seq, r.rid FROM m JOIN r ON r.video_id = m.video_id AND r.e IS NOT NULL AND m.t >= r.s AND m.t < r.e"""))
def point_in_round(v: View):
    closed = v.rounds().filter("e IS NOT NULL").select("video_id", "rid", "s", "e")
    return interval_join(v.m, closed, KEY, "t", "s", "e", 12 * HOUR).select("video_id", "seq", "rid")


@query("point_in_round_closed", on_rounds("""
SELECT m.video_id, m.seq, r.rid FROM m JOIN r ON r.video_id = m.video_id AND m.t >= r.s AND (r.e IS NULL OR m.t <= r.e)"""))
def point_in_round_closed(v: View):
    rounds = v.rounds().select("video_id", "rid", "s", "e")
    return interval_join(v.m, rounds, KEY, "t", "s", "e", 12 * HOUR, "both", open_ended=True).select(
        "video_id", "seq", "rid")


@query("first_round", on_rounds("""
SELECT m.video_id, m.seq, min(r.rid) AS rid FROM m JOIN r ON r.video_id = m.video_id AND m.t >= r.s AND (r.e IS NULL OR m.t < r.e) GROUP BY m.video_id, m.seq"""))
def first_round_query(v: View):
    rounds = v.rounds().select("video_id", "rid", "s", "e")
    return first_round(v.m.select("video_id", "seq", "t"), rounds, "t", 12 * HOUR).select("video_id", "seq", "rid")


EP = """ep AS (SELECT video_id, episode, min(t) AS first_t, max(t) AS last_t FROM (
  SELECT *, CAST(sum(o) OVER (PARTITION BY video_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode FROM (
    SELECT *, CASE WHEN t - lag(t) OVER w > 6*3600000000 OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS o FROM m WINDOW w AS (PARTITION BY video_id ORDER BY t, seq)))
  GROUP BY video_id, episode)"""


def episodes(v: View):
    return ss.gap_islands(v.m, KEY, ORDER, v.block, "t", 6 * HOUR).groupBy("video_id", "episode").agg(
        F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query("overlap_join", on_rounds("""
SELECT ep.video_id, episode, rid FROM ep JOIN r ON r.video_id = ep.video_id AND r.e IS NOT NULL AND first_t < e AND last_t >= s
UNION ALL SELECT ep.video_id, episode, rid FROM ep JOIN r ON r.video_id = ep.video_id AND r.e IS NULL AND first_t >= s""", EP))
def overlap(v: View):
    return overlap_join(episodes(v), v.rounds().select("video_id", "rid", "s", "e"), KEY, "first_t", "last_t", "s", "e",
                        12 * HOUR).select("video_id", "episode", "rid")


@query("band_join", on_events("""
SELECT ep.video_id, episode, count(*) FILTER (shot) AS shots, count(*) FILTER (damage) AS damages, min(t) FILTER (shot) AS first_shot
FROM ep JOIN smp ON smp.video_id = ep.video_id AND t >= first_t - 3*3600000000 AND t <= last_t + 3*3600000000 AND (shot OR damage)
GROUP BY ep.video_id, episode""", EP, S.format("m")))
def band_join(v: View):
    bands = episodes(v).select("video_id", "episode", (F.col("first_t") - 3 * HOUR).alias("lo"), (F.col("last_t") + 3 * HOUR).alias("hi"))
    hit = interval_join(v.samples().filter("shot OR damage"), bands, KEY, "t", "lo", "hi", 12 * HOUR, "both")
    return hit.groupBy("video_id", "episode").agg(
        F.count_if("shot").alias("shots"), F.count_if("damage").alias("damages"),
        F.min(F.when(F.col("shot"), F.col("t"))).alias("first_shot"))


@query("nearest_event", on_rounds("""
, kl AS (SELECT video_id, rid, seq, t FROM a WHERE type = 'player_kill'),
sh AS (SELECT video_id, rid, seq AS shot_seq, t AS shot_t, t - 2700000000 AS lo, greatest(t + CAST(k AS BIGINT)*60000000 + 3*3600000000, t + 12600000000) AS hi FROM a WHERE type = 'engagement_candidate' AND k % 2 = 0),
c AS (SELECT kl.*, shot_seq, row_number() OVER (PARTITION BY kl.video_id, kl.seq ORDER BY abs(kl.t - shot_t), shot_seq) AS rn FROM kl LEFT JOIN sh ON sh.video_id = kl.video_id AND sh.rid = kl.rid AND kl.t >= lo AND kl.t <= hi)
SELECT video_id, rid, seq, shot_seq FROM c WHERE rn = 1""".replace("\n, kl", ", kl", 1)))
def nearest_event(v: View):
    a = v.attached()
    kills = a.filter("type = 'player_kill'").select("video_id", "rid", "seq", "t")
    shots = a.filter("type = 'engagement_candidate' AND k % 2 = 0").select(
        "video_id", "rid", F.col("seq").alias("shot_seq"), F.col("t").alias("shot_t"),
        (F.col("t") - HOUR * 3 // 4).alias("lo"),
        F.greatest(F.col("t") + F.col("k").cast("long") * 60_000_000 + 3 * HOUR, F.col("t") + HOUR * 7 // 2).alias("hi"))
    out = jj.nearest_in_band(kills, shots, ["video_id", "rid"], "t", "lo", "hi", 12 * HOUR, ["video_id", "rid", "seq"],
                             F.abs(F.col("t") - F.col("shot_t")), "shot_seq", ["shot_seq"])
    return out.select("video_id", "rid", "seq", "shot_seq")


@query("proximity_exists", on_events("""
SELECT a.video_id, a.seq, EXISTS (SELECT 1 FROM smp b WHERE b.video_id = a.video_id AND b.damage AND abs(b.t - a.t) <= 4*3600000000) AS damage_near,
  EXISTS (SELECT 1 FROM smp b WHERE b.video_id = a.video_id AND b.flashed AND b.t >= a.t - 8*3600000000 AND b.t < a.t) AS flash_before FROM smp a""", S.format("m")))
def proximity_exists(v: View):
    s = jj.near_flags(v.samples(), KEY, ORDER, v.block, "t", F.col("damage"), 4 * HOUR, "damage_near")
    f = jj.flag_before(s, KEY, ORDER, v.block, "t", F.col("flashed"), 8 * HOUR, "flash_before")
    return f.select("video_id", "seq", "damage_near", "flash_before")


@query("merge_samples", on_events("""
, f AS (SELECT *, CAST(floor(t / 7200000000.0) AS BIGINT) AS frame FROM m),
u AS (SELECT video_id, frame, seq, score, 0 AS p FROM f WHERE k % 3 <> 0 UNION ALL SELECT video_id, frame, seq, score, 1 FROM f WHERE k % 3 = 0)
SELECT video_id, frame, seq, score, p = 1 AS refined FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY p DESC, seq DESC) AS rn FROM u) WHERE rn = 1""".replace("\n, f", ", f", 1)))
def merge_samples(v: View):
    f = v.m.select("video_id", F.floor(F.col("t") / (2 * HOUR)).alias("frame"), "seq", "score", "k")
    base, fine = f.filter("k % 3 <> 0").drop("k"), f.filter("k % 3 = 0").drop("k")
    return jj.prefer_refined(base, fine, ["video_id", "frame"], "seq")


@query("window_frames", on_events("""
SELECT DISTINCT m.video_id, CAST(floor(m.t / 600000000.0) AS BIGINT) AS frame, "window" FROM m JOIN win ON win.video_id = m.video_id
  AND floor(m.t / 600000000.0) BETWEEN floor("start" / 600000000.0) AND floor("end" / 600000000.0)
  AND (CAST(floor(m.t / 600000000.0) AS BIGINT) - CAST(floor("start" / 600000000.0) AS BIGINT)) % 3 = 0""", S.format("m"), TRIG))
def window_frames(v: View):
    ten = 600_000_000
    frames = v.m.select("video_id", F.floor(F.col("t") / ten).alias("frame")).distinct()
    win = refinement_windows_of(v).select("video_id", "window", F.floor(F.col("start") / ten).alias("f0"),
                                          F.floor(F.col("end") / ten).alias("f1"))
    return jj.frames_in_windows(frames, win, KEY, "frame", "f0", "f1", 3, 72).select("video_id", "frame", "window")


def engine_events(v: View):
    """Attached events with ids, confidence and source, as detectors emit them."""
    return v.attached().select(
        F.concat_ws("_", "type", F.col("seq").cast("string")).alias("event_id"), "video_id", "rid", "type", "t", "seq",
        (F.col("score") / 500).alias("confidence"),
        F.when(F.col("k") % 2 == 0, "feed_rows").otherwise("highlight_scan").alias("source"))


EV = """ev AS (SELECT type || '_' || seq AS event_id, video_id, rid, type, t, seq, score / 500 AS confidence,
  CASE WHEN k % 2 = 0 THEN 'feed_rows' ELSE 'highlight_scan' END AS source FROM a),
co AS (SELECT type || '_' || seq AS event_id, k % 3 <> 0 AS accepted FROM m WHERE k % 2 = 0),
lab AS (SELECT CASE WHEN k % 4 = 0 THEN type || '_' || seq ELSE 'manual_' || type || '_' || seq END AS event_id, video_id,
   CAST(k % 9 AS BIGINT) AS rid, CASE WHEN k % 5 = 0 THEN 'keyframe' ELSE type END AS type, t, seq FROM m WHERE k % 7 = 1)"""


def corrections_of(v: View):
    return v.m.filter("k % 2 = 0").select(
        F.concat_ws("_", "type", F.col("seq").cast("string")).alias("event_id"), (F.col("k") % 3 != 0).alias("accepted"))


@query("corrections", on_rounds("""
SELECT ev.event_id, ev.video_id, ev.rid, ev.type, ev.t FROM ev LEFT JOIN co USING (event_id)
WHERE ev.type NOT IN ('player_kill','player_death') OR coalesce(accepted, true)""", EV))
def corrections(v: View):
    return jj.apply_corrections(engine_events(v), corrections_of(v)).select("event_id", "video_id", "rid", "type", "t")


@query("manual_events", on_rounds("""
, ok AS (SELECT event_id, video_id, rid, type, t FROM lab WHERE type IN ('player_kill','player_death')
   AND EXISTS (SELECT 1 FROM r WHERE r.video_id = lab.video_id AND r.rid = lab.rid)
   AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.event_id = lab.event_id AND ev.video_id = lab.video_id AND ev.rid = lab.rid))
SELECT event_id, video_id, rid, type, t, round(confidence, 4) AS confidence, source FROM ev
UNION ALL SELECT event_id, video_id, rid, type, t, 1.0, 'manual_label' FROM ok""".replace("\n, ok", ", ok", 1), EV))
def manual_events(v: View):
    own = F.concat_ws("_", "type", F.col("seq").cast("string"))
    labels = v.m.filter("k % 7 = 1").select(
        F.when(F.col("k") % 4 == 0, own).otherwise(F.concat(F.lit("manual_"), own)).alias("event_id"), "video_id",
        (F.col("k") % 9).cast("long").alias("rid"), F.when(F.col("k") % 5 == 0, "keyframe").otherwise(F.col("type")).alias("type"),
        "t", "seq")
    out = jj.add_manual_events(engine_events(v), v.rounds(), labels)
    return out.withColumn("confidence", F.round("confidence", 4))


@query("correction_diagnostics", on_rounds("""
SELECT ev.event_id, ev.video_id, ev.rid, ev.type, ev.t, round(ev.confidence, 4) AS confidence, ev.source, coalesce(accepted, true) AS accepted
FROM ev LEFT JOIN co USING (event_id) WHERE ev.type IN ('player_kill','player_death')""", EV))
def correction_diagnostics(v: View):
    return jj.diagnostic_rows(engine_events(v), corrections_of(v)).select(
        "event_id", "video_id", "rid", "type", "t", F.round("confidence", 4).alias("confidence"), "source", "accepted")


@query("correction_totals", on_rounds("""
SELECT ev.video_id, count(*) FILTER (coalesce(accepted, true)) AS accepted, count(*) AS total
FROM ev LEFT JOIN co USING (event_id) WHERE ev.type IN ('player_kill','player_death') GROUP BY ev.video_id""", EV))
def correction_totals(v: View):
    rows = jj.diagnostic_rows(engine_events(v), corrections_of(v))
    return rows.groupBy("video_id").agg(F.count_if("accepted").alias("accepted"), F.count(F.lit(1)).alias("total"))


ASSETS = """sg AS (SELECT video_id, 'game_sense_' || type || '_' || rid || '_' || k AS suggestion_id, type || '_' || rid AS ref, min(t) AS t FROM a WHERE type IN ('player_kill','player_death') GROUP BY ALL),
ast AS (SELECT video_id, type || '_' || rid || CASE WHEN k % 2 = 0 THEN '' ELSE '_x' END AS event_id, type || '_' || rid AS ref, seq AS asset_no, t FROM a WHERE k % 4 = 0 OR k % 4 = 1)"""


@query("asset_attach", on_rounds("""
, c AS (SELECT sg.video_id, suggestion_id, event_id, asset_no, 0 AS p FROM sg JOIN ast ON ast.video_id = sg.video_id AND ast.ref = sg.ref AND (contains(suggestion_id, event_id) OR contains(event_id, suggestion_id))
  UNION ALL SELECT sg.video_id, suggestion_id, event_id, asset_no, 1 FROM sg JOIN ast ON ast.video_id = sg.video_id AND abs(ast.t - sg.t) < 2*3600000000)
SELECT video_id, suggestion_id, event_id, asset_no, p = 0 AS by_id FROM (SELECT *, row_number() OVER (PARTITION BY video_id, suggestion_id ORDER BY p, asset_no) AS rn FROM c) WHERE rn = 1""".replace("\n, c", ", c", 1), ASSETS))
def asset_attach(v: View):
    a = v.attached()
    ref = F.concat_ws("_", "type", F.col("rid").cast("string"))
    sugg = a.filter(F.col("type").isin("player_kill", "player_death")).groupBy(
        "video_id", F.concat_ws("_", F.lit("game_sense"), ref, F.col("k").cast("string")).alias("suggestion_id"),
        ref.alias("ref")).agg(F.min("t").alias("t"))
    assets = a.filter("k % 4 IN (0, 1)").select(
        "video_id", F.concat(ref, F.when(F.col("k") % 2 == 0, "").otherwise("_x")).alias("event_id"), ref.alias("ref"),
        F.col("seq").alias("asset_no"), "t")
    return jj.attach_assets(sugg, assets, KEY, 6 * HOUR, 2 * HOUR)


@query("template_fill", on_rounds("""
SELECT video_id, rid, key, CASE key WHEN 'round.open' THEN 'Round ' || rid || ' is still open after ' || n || ' events.'
  WHEN 'round.closed' THEN 'Round ' || rid || ' closed with ' || n || ' events.' ELSE key END AS text
FROM (SELECT *, CASE WHEN n = 1 THEN 'round.single' WHEN e IS NULL THEN 'round.open' ELSE 'round.closed' END AS key FROM r)"""))
def template_fill(v: View):
    rows = v.rounds().withColumn("key", F.when(F.col("n") == 1, "round.single").when(
        F.col("e").isNull(), "round.open").otherwise("round.closed"))
    out = jj.fill_templates(rows, tpl.template_table(v.spark), "en", "key", {"rid": F.col("rid"), "n": F.col("n")})
    return out.select("video_id", "rid", "key", "text")
