"""Context, catalogue and state queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.functions import scoring
from matchloom.operators import context as cx
from matchloom.operators import quality as q
from matchloom.operators import sessions as ss
from matchloom.operators.blocks import durable
from matchloom.operators.coaching import field_lists
from matchloom.plans.registry import HOUR, KEY, ORDER, S, View, on_events, on_rounds, query

ROUND = ["video_id", "rid"]
WEAPONS = ["rifle", "smg", "pistol", "sniper", "c4", "shotgun", "knife"]
UTILS = ["flashbang", "smoke", "he_grenade", "molotov"]


def pick(names, expr):
    out = F.lit(None).cast("string")
    for i, n in enumerate(names):
        out = F.when(expr == i, n).otherwise(out)
    return out


def pick_sql(names, expr):
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


OBS = f"""ob AS (SELECT smp_c.*, {pick_sql(WEAPONS, 'k % 8')} AS weapon, .75 + (k % 24) / 100.0 AS weapon_conf,
  CASE k % 3 WHEN 0 THEN 'native_scope_view' WHEN 1 THEN 'held_c4_geometry' ELSE 'classifier' END AS weapon_source,
  {pick_sql(UTILS, 'k % 6')} AS utility, .80 + (k % 20) / 100.0 AS utility_conf, {pick_sql(list(cx.POSITION_LABELS.values()), 'k % 20')} AS position, .30 + (k % 50) / 100.0 AS position_conf FROM smp_c)"""
SC = S.format("a").replace("smp AS", "smp_c AS")


def observations(v: View):
    k = F.col("k")
    return v.samples(v.attached()).select(
        "*", pick(WEAPONS, k % 8).alias("weapon"), (F.lit(.75) + (k % 24) / 100).alias("weapon_conf"),
        F.when(k % 3 == 0, "native_scope_view").when(k % 3 == 1, "held_c4_geometry").otherwise("classifier").alias("weapon_source"),
        pick(UTILS, k % 6).alias("utility"), (F.lit(.80) + (k % 20) / 100).alias("utility_conf"),
        pick(list(cx.POSITION_LABELS.values()), k % 20).alias("position"), (F.lit(.30) + (k % 50) / 100).alias("position_conf"))


CTX = """sd AS (SELECT video_id, rid, arg_min(team, (-c, f)) AS team, max(c) / sum(c) AS share FROM (SELECT video_id, rid, team, count(*) AS c, min((t, seq)) AS f FROM ob WHERE team IS NOT NULL GROUP BY ALL) GROUP BY 1, 2),
wv AS (SELECT ob.* FROM ob JOIN (SELECT video_id, rid, weapon FROM ob WHERE weapon IS NOT NULL AND weapon_conf >= .80 - 1e-9 GROUP BY ALL
   HAVING count(*) >= 2 OR bool_or(weapon IN ('sniper','c4') AND weapon_conf >= .95 - 1e-9 AND weapon_source IN ('native_scope_view','held_c4_geometry'))) USING (video_id, rid, weapon) WHERE weapon_conf >= .80 - 1e-9),
wm AS (SELECT video_id, rid, arg_min(weapon, (-w, f)) AS weapon, max(w) AS weight FROM (SELECT video_id, rid, weapon, round(sum(weapon_conf), 9) AS w, min((t, seq)) AS f FROM wv GROUP BY ALL) GROUP BY 1, 2),
uv AS (SELECT video_id, rid, utility FROM ob WHERE utility IS NOT NULL AND utility_conf >= .85 - 1e-9 GROUP BY ALL HAVING count(*) >= 2 OR bool_or(utility_conf >= .95 - 1e-9)),
us AS (SELECT video_id, rid, string_agg(utility, ',' ORDER BY utility) AS utility FROM uv GROUP BY 1, 2),
pv AS (SELECT ob.video_id, ob.rid, arg_min(ob.position, (t, seq)) AS position FROM ob JOIN (SELECT video_id, rid, position FROM ob WHERE position_conf >= .30 - 1e-9 GROUP BY ALL HAVING count(*) >= 2 OR bool_or(position_conf >= .60 - 1e-9)) g
   ON g.video_id = ob.video_id AND g.rid = ob.rid AND g.position = ob.position GROUP BY 1, 2),
mp0 AS (SELECT video_id, coalesce(bool_or(position_conf >= .60 - 1e-9 AND position IN ('palace_interior','snipers_nest')), false) AS st,
   count(DISTINCT CASE WHEN position_conf >= .60 - 1e-9 AND position IN ('underpass','apartments','t_ramp','shop','side_alley') THEN position END) AS sp FROM ob GROUP BY 1),
mp AS (SELECT video_id, CASE WHEN st OR sp >= 2 THEN 'mirage' END AS map_name, CASE WHEN st THEN .95 WHEN sp >= 2 THEN .85 ELSE 0 END AS map_confidence FROM mp0),
ck0 AS (SELECT *, lag(t) OVER w AS pt, lag(k) OVER w AS pk FROM ob WHERE score >= 10 WINDOW w AS (PARTITION BY video_id, rid ORDER BY t, seq)),
ck1 AS (SELECT *, sum(CASE WHEN pt IS NULL OR NOT ((t - pt)/3600000000.0 > 0 AND pk - k >= -20 AND pk - k <= (t - pt)/3600000000.0 + 40) THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, rid ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS c FROM ck0),
ck2 AS (SELECT *, lag(k) OVER (PARTITION BY video_id, rid, c ORDER BY t, seq) AS ck FROM ck1),
ck3 AS (SELECT video_id, rid, c, count(*) AS n, min(t) AS since, arg_min(k, (t, seq)) AS first_clock FROM ck2 GROUP BY ALL HAVING count(*) >= 2 AND max(ck - k) >= 1),
clk AS (SELECT video_id, rid, first_clock AS native_clock FROM (SELECT *, row_number() OVER (PARTITION BY video_id, rid ORDER BY n DESC, since) AS rn FROM ck3) WHERE rn = 1),
mo0 AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR k // 20 <> lag(k // 20) OVER w OR t - lag(t) OVER w > 172800000000 THEN 1 ELSE 0 END AS o FROM ob WHERE score >= 20 WINDOW w AS (PARTITION BY video_id, rid ORDER BY t, seq)),
mo1 AS (SELECT *, sum(o) OVER (PARTITION BY video_id, rid ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS c FROM mo0),
mo2 AS (SELECT video_id, rid, c, min(t) AS since, any_value(k // 20) AS money FROM mo1 GROUP BY ALL HAVING count(*) >= 2),
mny AS (SELECT video_id, rid, CAST(money AS BIGINT) AS money FROM (SELECT *, row_number() OVER (PARTITION BY video_id, rid ORDER BY since) AS rn FROM mo2) WHERE rn = 1),
cxt AS (SELECT r.video_id, r.rid, sd.team AS player_side, round(share, 4) AS side_share, clk.native_clock, wm.weapon, mny.money, us.utility, mp.map_name, pv.position AS map_position
   FROM r LEFT JOIN clk USING (video_id, rid) LEFT JOIN mny USING (video_id, rid) LEFT JOIN sd USING (video_id, rid) LEFT JOIN wm USING (video_id, rid) LEFT JOIN us USING (video_id, rid) LEFT JOIN pv USING (video_id, rid) LEFT JOIN mp USING (video_id))"""


def side_of(obs):
    return cx.mode_with_share(obs, ROUND, "team", ORDER)


def weapons_of(obs):
    strong = F.col("weapon").isin("sniper", "c4") & (F.col("weapon_conf") >= .95 - 1e-9) & F.col("weapon_source").isin(
        "native_scope_view", "held_c4_geometry")
    return cx.supported(obs.filter("weapon IS NOT NULL"), ROUND, "weapon", F.col("weapon_conf") >= .80 - 1e-9, strong)


def utility_of(obs):
    return cx.supported(obs.filter("utility IS NOT NULL"), ROUND, "utility", F.col("utility_conf") >= .85 - 1e-9, F.col("utility_conf") >= .95 - 1e-9)


def positions_of(obs):
    return cx.supported(obs.filter("position IS NOT NULL"), ROUND, "position", F.col("position_conf") >= .30 - 1e-9, F.col("position_conf") >= .60 - 1e-9)


def map_of(obs):
    return cx.resolve_map(obs.withColumn("_c", F.col("position_conf") + 1e-9), KEY, "position", "_c")


def round_context_of(v: View):
    """One row per round; unknown fields stay NULL."""
    obs = durable(observations(v).select(
        *ROUND, "t", "seq", "k", "score", "team", "weapon", "weapon_conf", "weapon_source", "utility", "utility_conf", "position", "position_conf"))
    rounds = obs.select(*ROUND).distinct()
    side = side_of(obs).select(*ROUND, F.col("team").alias("player_side"), F.round("share", 4).alias("side_share"))
    weapon = cx.weighted_mode(weapons_of(obs), ROUND, "weapon", "weapon_conf", ORDER).select(*ROUND, "weapon")
    util = cx.distinct_sorted(utility_of(obs), ROUND, "utility", "utility").withColumn("utility", F.array_join("utility", ","))
    pos = positions_of(obs).groupBy(*ROUND).agg(F.min_by("position", F.struct("t", "seq")).alias("map_position"))
    clock = ss.longest_clock_chain(obs.filter("score >= 10"), ROUND, ORDER, v.block, "t", "k", float(HOUR), 20, 40).select(*ROUND, F.col("first_clock").alias("native_clock"))
    stacks = obs.filter("score >= 20").withColumn("value", F.floor(F.col("k") / 20).cast("long"))
    money = ss.first_stable_value(stacks, ROUND, ORDER, v.block, "t", "value", 48 * HOUR).select(*ROUND, F.col("value").alias("money"))
    return (rounds.join(side, ROUND, "left").join(clock, ROUND, "left").join(weapon, ROUND, "left").join(money, ROUND, "left").join(util, ROUND, "left").join(pos, ROUND, "left")
            .join(map_of(obs).select("video_id", "map_name"), "video_id", "left"))


def on_context(body: str, *more: str) -> str:
    return on_rounds(body, SC, OBS, CTX, *more)


@query("mode_side", on_context("SELECT video_id, rid, team, round(share, 4) AS share FROM sd"))
def mode_side(v: View):
    return side_of(observations(v)).withColumn("share", F.round("share", 4))


@query("support_rule", on_context("SELECT video_id, rid, seq, weapon FROM wv"))
def support_rule(v: View):
    return weapons_of(observations(v)).select("video_id", "rid", "seq", "weapon")


@query("weighted_mode", on_context("SELECT video_id, rid, weapon, round(weight, 4) AS weight FROM wm"))
def weighted_mode(v: View):
    return cx.weighted_mode(weapons_of(observations(v)), ROUND, "weapon", "weapon_conf", ORDER).withColumn("weight", F.round("weight", 4))


@query("utility_sets", on_context("SELECT video_id, rid, utility FROM us"))
def utility_sets(v: View):
    out = cx.distinct_sorted(utility_of(observations(v)), ROUND, "utility", "utility")
    return out.withColumn("utility", F.array_join("utility", ","))


@query("anchor_sets", on_context("SELECT video_id, map_name, CAST(map_confidence AS DOUBLE) AS map_confidence FROM mp"))
def anchor_sets(v: View):
    return map_of(observations(v))


@query("round_context", on_context("SELECT * FROM cxt"))
def round_context(v: View):
    return round_context_of(v)


# What a coach may know of a round, in the order in which it is listed; each as SQL that is NULL when unknown.
FIELDS = {"player_side": "player_side", "native_clock": "native_clock", "weapon": "weapon", "money": "money", "utility": "utility",
          "map_position": "CASE WHEN map_name IS NOT NULL THEN map_position END"}


@query("coverage", on_context("SELECT video_id, count(*) AS rounds, " + ", ".join(f"count({e}) AS {n}" for n, e in FIELDS.items()) + " FROM cxt GROUP BY 1"))
def coverage(v: View):
    return cx.coverage(round_context_of(v), KEY, {n: F.expr(e).isNotNull() for n, e in FIELDS.items()})


@query("context_guard", on_context(
    "SELECT video_id, rid, CASE WHEN " + " AND ".join(f"({e}) IS NULL" for e in FIELDS.values()) + " THEN 'unavailable' ELSE concat_ws(', ', "
    + ", ".join(f"CASE WHEN ({e}) IS NOT NULL THEN '{n}' END" for n, e in FIELDS.items()) + ") END AS known, concat_ws(', ', "
    + ", ".join(f"CASE WHEN ({e}) IS NULL THEN '{n}' END" for n, e in FIELDS.items()) + ") AS missing FROM cxt"))
def context_guard(v: View):
    return field_lists(round_context_of(v), {n: F.expr(e) for n, e in FIELDS.items()}).select("video_id", "rid", "known", "missing")


@query("fuzzy_positions")
def fuzzy_positions(v: View):
    """Location texts with damaged letters, canonicalised."""
    raw = pick(list(cx.POSITION_LABELS.values()), F.col("k") % 20)
    cut = F.expr("substring(raw, 1, length(raw) - (seq % 4))")
    obs = v.m.select("video_id", "seq", "t", raw.alias("raw"), (F.lit(.2) + F.col("k") / 120).alias("confidence")).withColumn("raw", cut)
    return cx.canonical_positions(obs, "raw", "confidence").select("video_id", "seq", "raw", "label", "label_confidence")


CAT = """cat AS (SELECT p_partkey AS video_id, replace(p_name, ' ', '_') || CASE p_size % 5 WHEN 0 THEN '.mp4' WHEN 1 THEN '.avi' WHEN 2 THEN '.MKV' WHEN 3 THEN '.mov' ELSE '' END AS path,
  p_partkey % 17 <> 0 AS present, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 1920 ELSE p_size * 40 END AS width, CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 1082 ELSE p_size * 23 END AS height,
  CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 60.0 ELSE CAST(p_partkey % 301 AS DOUBLE) / 1.1 END AS fps, p_partkey * 37 AS frames FROM part)"""


def catalogue(v: View):
    k, s = F.col("p_partkey"), F.col("p_size")
    ext = F.when(s % 5 == 0, ".mp4").when(s % 5 == 1, ".avi").when(s % 5 == 2, ".MKV").when(s % 5 == 3, ".mov").otherwise("")
    return v.table("part").select(
        k.alias("video_id"), F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), ext).alias("path"), (k % 17 != 0).alias("present"),
        F.when(k % 7 == 0, None).when(k % 3 == 0, 1920).otherwise(s * 40).cast("int").alias("width"),
        F.when(k % 9 == 0, None).when(k % 3 == 0, 1082).otherwise(s * 23).cast("int").alias("height"),
        F.when(k % 11 == 0, None).when(k % 5 == 0, 60.0).otherwise((k % 301).cast("double") / 1.1).alias("fps"), (k * 37).alias("frames"))


@query("catalog", "WITH " + CAT + " SELECT video_id, path, width, height, round(fps, 4) AS fps, round(CASE WHEN fps > 0 THEN frames / fps END, 4) AS duration_sec FROM cat")
def catalog(v: View):
    return q.with_duration(catalogue(v)).select("video_id", "path", "width", "height", F.round("fps", 4).alias("fps"),
                                                F.round("duration_sec", 4).alias("duration_sec"))


VAL = """va AS (SELECT *, concat_ws(';', CASE WHEN NOT present THEN 'missing_file' END, CASE WHEN NOT (lower(path) LIKE '%.mp4' OR lower(path) LIKE '%.mov' OR lower(path) LIKE '%.mkv') THEN 'bad_extension' END, CASE WHEN width IS NULL OR height IS NULL THEN 'unknown_resolution' END, CASE WHEN fps IS NULL THEN 'unknown_fps' END) AS errors,
  concat_ws(';', CASE WHEN width IS NOT NULL AND height IS NOT NULL AND (width < 640 OR height < 360) THEN 'low_resolution' END, CASE WHEN fps < 1 THEN 'low_fps' END, CASE WHEN fps > 240 THEN 'high_fps' END) AS warnings FROM cat)"""


@query("catalog_dq", "WITH " + CAT + ", " + VAL + " SELECT video_id, errors, warnings, errors = '' AS is_valid FROM va")
def catalog_dq(v: View):
    return q.validate(catalogue(v)).select("video_id", F.array_join("errors", ";").alias("errors"),
                                           F.array_join("warnings", ";").alias("warnings"), "is_valid")


QD = """qd AS (SELECT *, width IS NOT NULL AND height IS NOT NULL AS kn, coalesce(abs(width - 1920) <= 4 AND abs(height - 1080) <= 4, false) AS rm, coalesce(abs(width / height - 1920 / 1080) <= .02, true) AS am, coalesce(abs(fps - 60) <= .5, false) AS fm FROM cat)"""


@query("quality_diag", "WITH " + CAT + ", " + QD + """ SELECT video_id, rm AS resolution_match, am AS aspect_match, fm AS fps_match, coalesce(width / height > 1920 / 1080 + .02, false) AS letterbox, coalesce(width / height < 1920 / 1080 - .02, false) AS pillarbox,
 concat_ws(';', CASE WHEN NOT kn THEN 'unknown_resolution' END, CASE WHEN kn AND NOT rm THEN 'resolution' END, CASE WHEN NOT am THEN 'aspect' END, CASE WHEN fps IS NULL THEN 'unknown_fps' END, CASE WHEN fps IS NOT NULL AND NOT fm THEN 'fps' END) AS quality_warnings FROM qd""")
def quality_diag(v: View):
    return q.assess(catalogue(v)).select("video_id", "resolution_match", "aspect_match", "fps_match", "letterbox", "pillarbox",
                                         F.array_join("quality_warnings", ";").alias("quality_warnings"))


@query("ingest_report", "WITH " + CAT + ", " + VAL + """, rp AS (SELECT *, CASE WHEN fps > 0 THEN greatest(1, CAST(round_even(fps / 2, 0) AS INTEGER)) END AS step FROM va),
rq AS (SELECT *, CASE WHEN fps > 0 AND frames / fps > 0 THEN CAST(floor(fps * (frames / fps) / step) AS BIGINT) END AS est, errors = '' AS ready FROM rp)
SELECT video_id, step, est AS estimated_frames, ready AS is_ready, concat_ws(' ', CASE WHEN ready THEN 'Video passed ingestion checks.' ELSE 'Video requires attention: ' || replace(concat_ws(';', nullif(errors, ''), nullif(warnings, '')), ';', '; ') END, 'Estimated ' || est || ' frames at 2.0 fps.') AS summary FROM rq""")
def ingest_report(v: View):
    return q.ingestion_report(catalogue(v), 2.0).select("video_id", "step", "estimated_frames", "is_ready", "summary")


@query("stride_sample", "SELECT l_orderkey AS video_id, l_partkey AS frame_index, round(l_partkey / 30.0, 4) AS timestamp_sec FROM lineitem WHERE l_partkey % 15 = 0")
def stride_sample(v: View):
    l = v.table("lineitem").select(F.col("l_orderkey").alias("video_id"), F.col("l_partkey").alias("frame_index"))
    return q.stride_sample(l, "frame_index", F.lit(15), F.lit(30.0)).withColumn("timestamp_sec", F.round("timestamp_sec", 4))


@query("inference_stride", "WITH " + CAT + """, n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY video_id) AS rn, CASE WHEN fps > 0 THEN greatest(1, CAST(round_even(fps / 25, 0) AS INTEGER)) END AS stride FROM cat)
SELECT video_id, stride FROM n WHERE (rn - 1) % stride = 0""")
def inference_stride(v: View):
    from matchloom.operators.scan import block_of, scan
    n = scan(catalogue(v), ["path"], ["video_id"], block_of("video_id", 100_000), rank="rn")
    n = n.withColumn("stride", scoring.inference_stride(F.col("fps"), F.lit(25.0)))
    return n.filter((F.col("rn") - 1) % F.col("stride") == 0).select("video_id", "stride")


@query("region_geometry", "WITH " + CAT + ", rg(region, nx, ny, nw, nh) AS (VALUES " + ", ".join(f"('{n}', {x}::DOUBLE, {y}::DOUBLE, {w}::DOUBLE, {h}::DOUBLE)" for n, x, y, w, h in q.REGIONS) + """),
a AS (SELECT video_id, region, width, height, greatest(0, least(CAST(floor(nx * width) AS INTEGER), width - 1)) AS x, greatest(0, least(CAST(floor(ny * height) AS INTEGER), height - 1)) AS y, greatest(1, CAST(floor(nw * width) AS INTEGER)) AS w0, greatest(1, CAST(floor(nh * height) AS INTEGER)) AS h0 FROM cat, rg WHERE width > 0 AND height > 0)
SELECT video_id, region, x, y, greatest(1, least(w0, width - x)) AS w, greatest(1, least(h0, height - y)) AS h FROM a""")
def region_geometry(v: View):
    screens = catalogue(v).filter("width > 0 AND height > 0").select("video_id", "width", "height")
    return q.region_boxes(screens, "width", "height").drop("width", "height")


@query("namespaced_state", on_events("""
SELECT video_id, seq, CASE WHEN k % 2 = 0 THEN 'player_status.hp,' ELSE '' END || 'round_info.timer,round_info.score' AS keys, CASE WHEN k % 2 = 0 THEN .8 ELSE .7 END AS confidence FROM m"""))
def namespaced_state(v: View):
    k = F.col("k")
    hp = F.when(k % 2 == 0, F.create_map(F.lit("hp"), k.cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    info = F.create_map(F.lit("timer"), (k * 2).cast("string"), F.lit("score"), F.col("score").cast("string"))
    out = q.namespaced_state(v.m, {"player_status": hp, "round_info": info})
    return out.select("video_id", "seq", F.array_join(F.map_keys("values"), ",").alias("keys"), F.round("confidence", 4).alias("confidence"))


STAT = """sf AS (SELECT video_id, seq, k * 2.6 AS mean, k * 1.0 AS std, (k * 7 % 100) / 100.0 AS dark, (k % 50) / 1000.0 AS shot_score, (k % 40) / 1000.0 AS damage_score, (k % 60) / 100.0 AS kill_score, k % 4 AS kill_rows, (k % 20) / 1000.0 AS timer_ratio, (k % 9) / 1000.0 AS feed_fraction FROM m)"""


@query("signal_flags", on_events("""
SELECT video_id, seq, mean > 205 AND std < 85 AND std < 65 AS flashed, dark > .72 AND mean < 105 AS scoped, NOT (mean > 205 AND std < 65) AND shot_score >= .04 AS shot_candidate, NOT (mean > 205 AND std < 65) AND damage_score >= .025 AS damage_candidate,
 kill_score >= .45 OR kill_rows > 0 AS kill_highlight, timer_ratio > .008 AS timer_active, feed_fraction > .005 AS kill_feed_active FROM sf""", STAT))
def signal_flags(v: View):
    k = F.col("k")
    s = v.m.select("video_id", "seq", (k * 2.6).alias("mean"), (k * 1.0).alias("std"), (k * 7 % 100 / 100).alias("dark"), (k % 50 / 1000).alias("shot_score"),
                   (k % 40 / 1000).alias("damage_score"), (k % 60 / 100).alias("kill_score"), (k % 4).alias("kill_rows"), (k % 20 / 1000).alias("timer_ratio"), (k % 9 / 1000).alias("feed_fraction"))
    return q.signal_flags(s).select("video_id", "seq", "flashed", "scoped", "shot_candidate", "damage_candidate", "kill_highlight", "timer_active", "kill_feed_active")


@query("label_map", """SELECT l_orderkey AS frame, CASE l_returnflag WHEN 'A' THEN 'ct' WHEN 'R' THEN 't' END AS team, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A','R') AND l_discount * 10 >= .30 - 1e-9 GROUP BY ALL""")
def label_map(v: View):
    names = v.spark.createDataFrame([("A", "ct"), ("R", "t")], "l_returnflag string, team string")
    l = v.table("lineitem").join(F.broadcast(names), "l_returnflag").filter(F.col("l_discount") * 10 >= .30 - 1e-9)
    return l.groupBy(F.col("l_orderkey").alias("frame"), "team").agg(F.count(F.lit(1)).alias("n"))


@query("state_bands", on_events("""
, s AS (SELECT video_id, seq, CASE WHEN k % 10 = 9 THEN NULL ELSE k END AS hp, CASE WHEN k % 3 = 0 THEN NULL ELSE (k * 3) % 100 END AS av, CASE WHEN k % 5 = 0 THEN NULL ELSE k % 5 < 4 END AS ra, k % 2 = 0 AS kf FROM m),
b AS (SELECT *, coalesce(hp, 100) AS h, coalesce(ra, true) AS act FROM s),
c AS (SELECT *, CASE WHEN h < 20 THEN 'critical' WHEN h < 50 THEN 'low' WHEN h < 80 THEN 'moderate' ELSE 'healthy' END AS band FROM b)
SELECT video_id, seq, band, coalesce(av < 60 AND h > 50, false) AS armour_tip, 'hp ' || band || ' | ' || CASE WHEN act THEN 'round active' ELSE 'round inactive' END AS status,
 coalesce(nullif(concat_ws(' | ', CASE WHEN h < 20 THEN 'avoid contact' END, CASE WHEN h >= 20 AND h < 50 THEN 'play safe' END, CASE WHEN NOT act THEN 'plan the round' END, CASE WHEN kf AND h < 50 THEN 'stay cautious' END), ''), 'context required') AS next_action, .7 AS advice_confidence FROM c""".replace("\n, s", ", s", 1)))
def state_bands(v: View):
    k = F.col("k")
    s = v.m.select("video_id", "seq", F.when(k % 10 != 9, k).alias("hp"), F.when(k % 3 != 0, (k * 3) % 100).alias("armour_value"),
                   F.when(k % 5 != 0, k % 5 < 4).alias("round_active"), (k % 2 == 0).alias("kill_feed_active"))
    return q.state_bands(s).select("video_id", "seq", "band", "armour_tip", "status", "next_action", "advice_confidence")


@query("hud_state", """
WITH p AS (SELECT l_orderkey AS frame, l_linenumber AS no, l_partkey AS part, CAST(l_quantity AS INTEGER) AS white, l_linenumber * 4 AS green, CAST(round(l_discount * 300) AS INTEGER) AS red, 97 AS bar_pixels, CAST(round(l_tax * 300) AS INTEGER) AS blue, CAST(l_quantity AS INTEGER) % 30 AS armour_white, CAST(l_quantity AS INTEGER) % 41 AS yellow,
 l_linenumber * 2 AS ct_px, CAST(l_quantity AS INTEGER) % 17 AS t_px, CAST(l_quantity AS INTEGER) * 3 AS bright, l_linenumber * 9 AS feed_green, 9973 AS total FROM lineitem)
SELECT frame, no, part, CASE WHEN NOT (white > 20 OR green + red > 30) THEN 0 WHEN green + red > 0 THEN least(100, greatest(1, CAST(round_even((green + red) / bar_pixels * 100, 0) AS INTEGER))) ELSE 50 END AS hp,
 (white > 20 OR green + red > 30) AND green + red > 0 AND red > green AS hp_low, blue > 15 OR armour_white > 20 AS armour, yellow > 20 AS ammo_visible, ct_px > 8 AS ct_score_present, t_px > 8 AS t_score_present, round(greatest(0, bright - feed_green) / total, 5) AS feed_fraction FROM p""")
def hud_state(v: View):
    qn = F.col("l_quantity").cast("int")
    p = v.table("lineitem").select(
        F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("no"), F.col("l_partkey").alias("part"), qn.alias("white"), (F.col("l_linenumber") * 4).alias("green"),
        F.round(F.col("l_discount") * 300).cast("int").alias("red"), F.lit(97).alias("bar_pixels"), F.round(F.col("l_tax") * 300).cast("int").alias("blue"), (qn % 30).alias("armour_white"),
        (qn % 41).alias("yellow"), (F.col("l_linenumber") * 2).alias("ct_px"), (qn % 17).alias("t_px"), (qn * 3).alias("bright"), (F.col("l_linenumber") * 9).alias("feed_green"), F.lit(9973).alias("total"))
    return q.hud_state(p).select("frame", "no", "part", "hp", "hp_low", "armour", "ammo_visible", "ct_score_present", "t_score_present", F.round("feed_fraction", 5).alias("feed_fraction"))


HELD = """hd AS (SELECT video_id, seq, k % 9 = 0 AS scoped, k % 11 = 0 AS c4, CASE k % 4 WHEN 0 THEN 'rifle' WHEN 1 THEN 'pistol' WHEN 2 THEN 'banana' END AS item, (60 + k % 41) / 100.0 AS item_conf, CASE k % 5 WHEN 0 THEN 'rifle' WHEN 1 THEN 'sniper' WHEN 2 THEN 'banana' END AS hint, (50 + k % 51) / 100.0 AS hint_conf FROM m),
h1 AS (SELECT *, CASE WHEN scoped THEN 'sniper' WHEN c4 THEN 'c4' WHEN item IN ('pistol','rifle','smg','shotgun','sniper','knife','grenade','c4') AND item_conf >= .80 THEN item END AS held, CASE WHEN scoped THEN .97 WHEN c4 THEN .96 WHEN item IN ('pistol','rifle') AND item_conf >= .80 THEN item_conf END AS c0, CASE WHEN scoped THEN 'native_scope_view' WHEN c4 THEN 'held_c4_geometry' WHEN item IN ('pistol','rifle') AND item_conf >= .80 THEN 'model' END AS s0 FROM hd)"""


@query("held_item", on_events("""
SELECT video_id, seq, held, round(CASE WHEN hint = held THEN least(1.0, greatest(c0, hint_conf) + .02) ELSE c0 END, 4) AS held_confidence, CASE WHEN hint = held THEN s0 || '+equipment' ELSE s0 END AS held_source FROM h1""", HELD))
def held_item(v: View):
    k = F.col("k")
    s = v.m.select("video_id", "seq", (k % 9 == 0).alias("scoped"), (k % 11 == 0).alias("c4"), pick(["rifle", "pistol", "banana"], k % 4).alias("item"),
                   ((k % 41 + 60) / 100).alias("item_conf"), F.lit("model").alias("item_source"), pick(["rifle", "sniper", "banana"], k % 5).alias("hint"),
                   ((k % 51 + 50) / 100).alias("hint_conf"), F.lit("equipment").alias("hint_source"))
    out = q.held_item(s, ("pistol", "rifle", "smg", "shotgun", "sniper", "knife", "grenade", "c4"), .80)
    return out.select("video_id", "seq", "held", F.round("held_confidence", 4).alias("held_confidence"), "held_source")


@query("admissible", on_events("""
, o AS (SELECT video_id, seq, CASE k % 5 WHEN 0 THEN 'clock' WHEN 1 THEN 'money' WHEN 2 THEN 'weapon' WHEN 3 THEN 'utility' ELSE 'position' END AS kind, ((k * 13) % 100) / 100.0 AS confidence, k * 200 AS value_num, CASE WHEN k % 10 = 4 THEN 'a1' ELSE 'shop' END AS value_str, k % 4 <> 0 AS fp, k % 3 <> 0 AS tv FROM m)
SELECT video_id, seq, kind FROM o WHERE CASE kind WHEN 'clock' THEN confidence >= .35 WHEN 'money' THEN confidence >= .55 AND value_num BETWEEN 0 AND 16000 AND fp AND tv WHEN 'weapon' THEN confidence >= .80 WHEN 'utility' THEN confidence >= .85 ELSE confidence >= .30 AND value_str = 'shop' AND fp AND tv END""".replace("\n, o", ", o", 1)))
def admissible(v: View):
    k = F.col("k")
    o = v.m.select("video_id", "seq", pick(["clock", "money", "weapon", "utility", "position"], k % 5).alias("kind"), (k * 13 % 100 / 100).alias("confidence"), (k * 200).alias("value_num"),
                   F.when(k % 10 == 4, "a1").otherwise("shop").alias("value_str"), (k % 4 != 0).alias("first_person_active"), (k % 3 != 0).alias("timer_visible"))
    return q.admissible(o).select("video_id", "seq", "kind")


@query("plausible_rounds", on_rounds("SELECT video_id, rid FROM r WHERE e - s >= 9000000000 AND n BETWEEN 1 AND 59"))
def plausible_rounds(v: View):
    return v.rounds().filter((F.col("e") - F.col("s") >= 15 * 600_000_000) & F.col("n").between(1, 59)).select("video_id", "rid")


@query("state_profile", on_events("""
SELECT 'flashed' AS key, count(*) FILTER (flashed) AS n, round_even(100.0 * count(*) FILTER (flashed) / count(*), 0) AS pct, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high, CAST(NULL AS DOUBLE) AS mean FROM smp
UNION ALL SELECT 'scoped', count(*) FILTER (scoped), round_even(100.0 * count(*) FILTER (scoped) / count(*), 0), NULL, NULL, NULL FROM smp
UNION ALL SELECT 'health', count(*) FILTER (health), round_even(100.0 * count(*) FILTER (health) / count(*), 0), NULL, NULL, NULL FROM smp
UNION ALL SELECT 'score', NULL, NULL, min(score), max(score), round(avg(score), 4) FROM smp
UNION ALL SELECT 'k', NULL, NULL, min(k), max(k), round(avg(k), 4) FROM smp""", S.format("m")))
def state_profile(v: View):
    return q.state_profile(v.samples(), ["flashed", "scoped", "health"], ["score", "k"])
