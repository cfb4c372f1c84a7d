"""Session, episode and sample queries over the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.operators import sessions as ss
from matchloom.operators.blocks import durable
from matchloom.operators.scan import ema, trailing
from matchloom.plans.registry import HOUR, KEY, ORDER, S, View, on_events, on_rounds, query, running


@query("round_sessions", on_rounds("SELECT video_id, rid, s, e, n FROM r"))
def round_sessions(v: View):
    return v.rounds().select("video_id", "rid", "s", "e", "n")


@query("gap_episodes", on_events("""
, g AS (SELECT *, CASE WHEN t - lag(t) OVER w > 6*3600000000 OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS o FROM m WINDOW w AS (PARTITION BY video_id ORDER BY t, seq)),
e AS (SELECT *, CAST(sum(o) OVER (PARTITION BY video_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode FROM g)
SELECT video_id, episode, min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM e GROUP BY video_id, episode""".replace("\n, g", ", g", 1)))
def gap_episodes(v: View):
    e = ss.gap_islands(v.m, KEY, ORDER, v.block, "t", 6 * HOUR)
    return e.groupBy("video_id", "episode").agg(
        F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("n"))


@query("flag_runs", on_events("""
SELECT video_id, min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t, seq) - row_number() OVER (PARTITION BY video_id, scoped ORDER BY t, seq) AS g
  FROM smp) WHERE scoped GROUP BY video_id, g""", S.format("m")))
def flag_runs(v: View):
    runs = ss.flag_runs(v.samples(), KEY, ORDER, v.block, F.col("scoped"))
    return runs.groupBy("video_id", "run").agg(
        F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("n")).drop("run")


def round_samples(v: View):
    """Samples of closed rounds with their time weight: next sample, else round end."""
    known = running()
    a = v.samples(v.attached(nxt=known["nxt"], ahead=known["ahead"]))
    closed = (F.col("type") != "round_end") & (F.col("_end.type") == "round_end")
    return a.filter(closed).withColumn("e", F.col("_end.t")).withColumn("w", F.col("nt") - F.col("t")).drop("_end")


RS = """rs AS (SELECT smp.*, r.e, smp.nt - smp.t AS w FROM smp JOIN r USING (video_id, rid) WHERE r.e IS NOT NULL AND smp.type <> 'round_end')"""


@query("time_weighted", on_rounds("""
SELECT video_id, rid, CAST(sum(CASE WHEN flashed THEN w ELSE 0 END) AS BIGINT) AS flash_time, CAST(sum(CASE WHEN scoped THEN w ELSE 0 END) AS BIGINT) AS scope_time,
  round(coalesce(sum(CASE WHEN motion IS NOT NULL AND NOT flashed THEN motion * w END) / nullif(sum(CASE WHEN motion IS NOT NULL AND NOT flashed THEN w END), 0), 0), 4) AS motion_avg,
  round(coalesce(sum(CASE WHEN motion < 50 AND NOT flashed THEN w END) / nullif(sum(CASE WHEN motion IS NOT NULL AND NOT flashed THEN w END), 0), 0), 4) AS stationary_ratio
FROM rs GROUP BY video_id, rid""", S.format("a"), RS))
def time_weighted(v: View):
    out = ss.weighted_round_summary(round_samples(v), ["video_id", "rid"], F.col("w"), F.col("flashed"),
                                    F.col("scoped"), F.col("motion"), still_below=50)
    return out.withColumn("motion_avg", F.round("motion_avg", 4)).withColumn(
        "stationary_ratio", F.round("stationary_ratio", 4))


@query("rising_edges", on_rounds("""
SELECT video_id, rid, count(*) AS flash_count FROM (
  SELECT *, lag(flashed) OVER (PARTITION BY video_id, rid ORDER BY t, seq) AS was FROM rs)
WHERE flashed AND NOT coalesce(was, false) GROUP BY video_id, rid""", S.format("a"), RS))
def rising_edges(v: View):
    edges = ss.rising_edges(round_samples(v), ["video_id", "rid"], ORDER, v.block, F.col("flashed"))
    return edges.groupBy("video_id", "rid").agg(F.count(F.lit(1)).alias("flash_count"))


def moments(v: View, flash_min, scope_min):
    """First four flash/scope episodes per round in time order, then the duration floor."""
    key = ["video_id", "rid"]
    base = durable(round_samples(v).select(*key, "t", "seq", "w", "flashed", "scoped"))
    parts = []
    for kind, rank in (("flash", 0), ("scope", 1)):
        flag = "flashed" if kind == "flash" else "scoped"
        runs = ss.flag_runs(base, key, ORDER, v.block, F.col(flag)).groupBy(*key, "run").agg(
            F.min("t").alias("first_t"), F.sum("w").alias("duration"))
        parts.append(runs.select(*key, "first_t", "duration", F.lit(kind).alias("moment_kind"), F.lit(rank).alias("_k")))
    both = parts[0].unionByName(parts[1])
    ranked = ss.top_per_group(both, key, ["first_t", "_k"], 4, "moment_index")
    floor = F.when(F.col("moment_kind") == "flash", flash_min).otherwise(scope_min)
    return ranked.filter(F.col("duration") >= floor).select(
        *key, F.col("moment_index").cast("long").alias("moment_index"), "moment_kind", "first_t",
        F.col("duration").cast("long").alias("duration"))


MOMENTS = """runs AS (
  SELECT video_id, rid, min(t) AS first_t, sum(w) AS duration, 'flash' AS moment_kind, 0 AS kk FROM (
    SELECT *, row_number() OVER (PARTITION BY video_id, rid ORDER BY t, seq) - row_number() OVER (PARTITION BY video_id, rid, flashed ORDER BY t, seq) AS g FROM rs)
  WHERE flashed GROUP BY video_id, rid, g
  UNION ALL
  SELECT video_id, rid, min(t), sum(w), 'scope', 1 FROM (
    SELECT *, row_number() OVER (PARTITION BY video_id, rid ORDER BY t, seq) - row_number() OVER (PARTITION BY video_id, rid, scoped ORDER BY t, seq) AS g FROM rs)
  WHERE scoped GROUP BY video_id, rid, g),
moments AS (SELECT video_id, rid, moment_index, moment_kind, first_t, CAST(duration AS BIGINT) AS duration FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id, rid ORDER BY first_t, kk) AS moment_index FROM runs)
  WHERE moment_index <= 4 AND duration >= CASE WHEN moment_kind='flash' THEN 2*3600000000 ELSE 8*3600000000 END)"""


@query("moments_top4", on_rounds("SELECT * FROM moments", S.format("a"), RS, MOMENTS))
def moments_top4(v: View):
    return moments(v, 2 * HOUR, 8 * HOUR)


@query("interval_union", on_events("""
, c AS (SELECT video_id, t - CAST(k AS BIGINT)*180000000 AS s0, t + CAST(k AS BIGINT)*360000000 AS e0 FROM m WHERE k > 0),
p AS (SELECT *, max(e0) OVER (PARTITION BY video_id ORDER BY s0, e0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
q AS (SELECT *, sum(CASE WHEN reach IS NULL OR s0 > reach + 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY s0, e0 ROWS UNBOUNDED PRECEDING) AS g FROM p)
SELECT video_id, CAST(g AS BIGINT) AS "window", min(s0) AS "start", max(e0) AS "end" FROM q GROUP BY video_id, g""".replace("\n, c", ", c", 1)))
def interval_union(v: View):
    k = F.col("k").cast("long")
    iv = v.m.select("video_id", (F.col("t") - k * 180_000_000).alias("s0"),
                                     (F.col("t") + k * 360_000_000).alias("e0"))
    return ss.union_intervals(iv, KEY, "s0", "e0", v.width, 2 * HOUR)


TRIG = """tr AS (SELECT video_id, t FROM (SELECT *, lag(health) OVER (PARTITION BY video_id ORDER BY t, seq) AS was FROM smp)
  WHERE shot OR damage OR (coalesce(was, false) AND NOT health) UNION ALL SELECT video_id, t FROM smp WHERE type = 'engagement_candidate' AND k % 25 = 0),
w0 AS (SELECT video_id, t - 2*3600000000 AS s0, max(t + 4*3600000000) AS e0 FROM tr GROUP BY video_id, t),
w1 AS (SELECT *, max(e0) OVER (PARTITION BY video_id ORDER BY s0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w0),
w2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR s0 > reach + 2700000000 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY s0 ROWS UNBOUNDED PRECEDING) AS g FROM w1),
win AS (SELECT video_id, CAST(g AS BIGINT) AS "window", min(s0) AS "start", max(e0) AS "end" FROM w2 GROUP BY video_id, g)"""


def refinement_windows_of(v: View):
    seen = v.m.filter("type = 'engagement_candidate' AND k % 25 = 0")
    return ss.refinement_windows(v.samples(), seen, KEY, ORDER, v.block, "t", ["shot", "damage"], "health", v.width,
                                 2 * HOUR, 4 * HOUR, HOUR * 3 // 4)


@query("refinement_windows", on_events("SELECT * FROM win", S.format("m"), TRIG))
def refinement_windows(v: View):
    return refinement_windows_of(v)


@query("value_chains", on_events("""
, f AS (SELECT * FROM m WHERE score >= 20),
g AS (SELECT *, k // 20 AS val, CASE WHEN lag(t) OVER w IS NULL OR k // 20 <> lag(k // 20) OVER w OR t - lag(t) OVER w > 172800000000 THEN 1 ELSE 0 END AS o FROM f WINDOW w AS (PARTITION BY video_id ORDER BY t, seq)),
h AS (SELECT *, sum(o) OVER (PARTITION BY video_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS c FROM g),
i AS (SELECT video_id, min(t) AS since, max(t) AS until, any_value(val) AS value, count(*) AS n FROM h GROUP BY video_id, c HAVING count(*) >= 2)
SELECT video_id, since, until, CAST(value AS BIGINT) AS value, n FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY since) AS rn FROM i) WHERE rn = 1""".replace("\n, f", ", f", 1)))
def value_chains(v: View):
    obs = v.m.filter("score >= 20").withColumn("val", F.floor(F.col("k") / 20).cast("long"))
    return ss.first_stable_value(obs, KEY, ORDER, v.block, "t", "val", 48 * HOUR)


@query("clock_chain", on_events("""
, f AS (SELECT * FROM m WHERE score >= 10),
g AS (SELECT *, lag(t) OVER w AS pt, lag(k) OVER w AS pk FROM f WINDOW w AS (PARTITION BY video_id ORDER BY t, seq)),
h AS (SELECT *, CASE WHEN pt IS NULL OR NOT ((t - pt)/3600000000.0 > 0 AND pk - k >= -20 AND pk - k <= (t - pt)/3600000000.0 + 40) THEN 1 ELSE 0 END AS o FROM g),
i AS (SELECT *, sum(o) OVER (PARTITION BY video_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS c FROM h),
j AS (SELECT video_id, c, count(*) AS n, min(t) AS since, max(t) AS until, arg_min(k, t) AS first_clock, max(CASE WHEN o = 0 THEN pk - k END) AS d FROM i GROUP BY video_id, c)
SELECT video_id, n, since, until, first_clock FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY n DESC, since) AS rn FROM j WHERE n >= 2 AND d >= 1) WHERE rn = 1""".replace("\n, f", ", f", 1)))
def clock_chain(v: View):
    return ss.longest_clock_chain(v.m.filter("score >= 10"), KEY, ORDER, v.block, "t", "k",
                                  unit=float(HOUR), backward=20.0, slack=40.0)


@query("carry_forward", on_events("""
SELECT video_id, seq, last_value(team IGNORE NULLS) OVER w AS team_known,
  coalesce(last_value(CASE WHEN shot THEN CAST(floor(score) AS BIGINT) END IGNORE NULLS) OVER w, 0) AS score_known
FROM smp WINDOW w AS (PARTITION BY video_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING)""", S.format("m")))
def carry_forward(v: View):
    s = v.samples().withColumn("_score", F.when(F.col("shot"), F.floor("score").cast("long")))
    out = ss.carry_forward(s, KEY, ORDER, v.block, {"team_known": F.col("team"), "score_known": F.col("_score")},
                           {"score_known": F.lit(0).cast("long")})
    return out.select("video_id", "seq", "team_known", "score_known")


@query("rate_diff", on_events("""
SELECT video_id, seq, round(least(1.0, abs(score - lag(score) OVER w) / greatest((t - lag(t) OVER w) / 60000000.0, 0.05)), 4) AS rate
FROM m WINDOW w AS (PARTITION BY video_id ORDER BY t, seq) QUALIFY lag(t) OVER w IS NOT NULL"""))
def rate_diff(v: View):
    out = ss.rate_difference(v.m, KEY, ORDER, v.block, "t", "score", 60_000_000.0)
    return out.filter("rate IS NOT NULL").select("video_id", "seq", F.round("rate", 4).alias("rate"))


@query("rolling_mean", on_events("""
SELECT video_id, seq, round(avg(CAST(k AS DOUBLE)) OVER (PARTITION BY video_id ORDER BY t, seq ROWS 4 PRECEDING), 4) AS smoothed FROM m"""))
def rolling_mean(v: View):
    out = trailing(v.m, KEY, ORDER, v.block, 5, {"smoothed": lambda w: F.avg("k").over(w)})
    return out.select("video_id", "seq", F.round("smoothed", 4).alias("smoothed"))


@query("keyframes", on_rounds("""
, vid AS (SELECT video_id, max(t) AS tail FROM m GROUP BY video_id),
kf AS (SELECT r.video_id, rid, i AS sample_index, s + CAST(floor((coalesce(e, tail) - s) * i / 3.0) AS BIGINT) AS "at"
  FROM r JOIN vid USING (video_id), (SELECT unnest([1, 2]) AS i) WHERE coalesce(e, tail) > s),
fr AS (SELECT *, CAST(floor("at" / 3600000000.0) AS BIGINT) AS frame_index FROM kf),
dd AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_index ORDER BY rid, sample_index) AS d FROM fr)
SELECT video_id, frame_index, rid, sample_index, "at" FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY rid, sample_index) AS p FROM dd WHERE d = 1) WHERE p <= 30""".replace("\n, vid", ", vid", 1)))
def keyframes(v: View):
    tails = v.m.groupBy("video_id").agg(F.max("t").alias("tail"))
    r = v.rounds().join(tails, "video_id")
    return ss.round_keyframes(r, "video_id", "s", F.coalesce("e", "tail"), 2,
                              F.floor(F.col("at") / HOUR).cast("long"), 30)


@query("ema_baseline", """WITH RECURSIVE """ + on_events("""
, o AS (SELECT video_id, seq, CAST(k AS DOUBLE) / 97 AS l, CAST((k * 7) % 100 AS DOUBLE) / 89 AS rr, row_number() OVER (PARTITION BY video_id ORDER BY t, seq) AS rn FROM m),
z AS (SELECT video_id, seq, rn, l, rr, CAST(NULL AS DOUBLE) AS bl, CAST(NULL AS DOUBLE) AS br FROM o WHERE rn = 1
  UNION ALL SELECT o.video_id, o.seq, o.rn, o.l, o.rr, CASE WHEN z.bl IS NULL THEN z.l ELSE z.bl*.85 + z.l*.15 END, CASE WHEN z.br IS NULL THEN z.rr ELSE z.br*.85 + z.rr*.15 END
  FROM z JOIN o ON o.video_id = z.video_id AND o.rn = z.rn + 1)
SELECT video_id, seq, round(CASE WHEN least(l, rr) < .035 THEN 0 ELSE coalesce(least(greatest(0, l - bl), greatest(0, rr - br)), 0) END, 4) AS damage_score FROM z""".replace("\n, o", ", o", 1))[5:])
def ema_baseline(v: View):
    s = v.m.select("video_id", "seq", "t", (F.col("k") / 97).alias("l"), ((F.col("k") * 7) % 100 / 89).alias("rr"))
    b = ema(s, KEY, ORDER, v.block, {"bl": "l", "br": "rr"})
    excess = F.coalesce(F.when(F.col("bl").isNotNull(), F.least(
        F.greatest(F.lit(0.0), F.col("l") - F.col("bl")), F.greatest(F.lit(0.0), F.col("rr") - F.col("br")))), F.lit(0.0))
    return b.select("video_id", "seq", F.round(
        F.when(F.least("l", "rr") < .035, 0.0).otherwise(excess), 4).alias("damage_score"))
