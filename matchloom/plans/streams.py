"""Streaming queries, drained over the available files."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.operators.kernels import BoxTracker, CadenceGate, DebouncedEdge, DebouncedLow
from matchloom.operators.tracking import named
from matchloom.plans.combat import TIMER, number_rounds
from matchloom.plans.registry import HOUR, KEY, ORACLE, S, View, on_events, on_rounds, query
from matchloom.sources import tables
from matchloom.streaming import live

IDLE = 400 * 86_400_000


def typed(v: View, watermark: str = "1 hour", ending: bool = True):
    """The event stream with its event time as a watermarked timestamp, and how it ends."""
    v.spark = live.with_state_store(v.spark)
    if not hasattr(v, "ordered"):
        v.ordered = live.in_time_order(v.spark, v.dir, "events", "ts")
    m = tables.typed_events(live.read_table(v.spark, v.ordered)).withColumn("ts", F.timestamp_micros("t"))
    v.ending = live.Ending(v.spark) if ending else None
    return (v.ending.join(m) if ending else m).withWatermark("ts", watermark)


def kernel(v: View, kernel, *columns):
    """Drain a kernel over the typed events."""
    rows = typed(v).select("video_id", "seq", "t", "ts", *columns)
    return live.drain(live.run_kernel(rows, KEY, ["t", "seq"], kernel, IDLE), ending=v.ending)


@query("stream_sessions", on_rounds("SELECT video_id, rid, seq, t, type AS kind FROM a"))
def stream_sessions(v: View):
    return kernel(v, live.BracketKernel(), "type")

@query("stream_debounced_low", ORACLE["debounced_low"])
def stream_debounced_low(v: View):
    return kernel(v, DebouncedLow(40, 3, 48.0 * HOUR), F.col("k").alias("hp"))

@query("stream_debounced_edge", ORACLE["debounced_edge"])
def stream_debounced_edge(v: View):
    return kernel(v, DebouncedEdge(2, 24.0 * HOUR), (F.col("k") < 60).alias("active"))

@query("stream_cadence", ORACLE["cadence_thin"])
def stream_cadence(v: View):
    return kernel(v, CadenceGate(12 * HOUR))

@query("stream_hysteresis", ORACLE["hysteresis_rounds"])
def stream_hysteresis(v: View):
    found = kernel(v, live.Smoothed(TIMER, "ratio", 2),
                   (F.col("k") / 10000).alias("ratio"), (F.col("k") * 3 + 1).alias("ct_px"), (F.col("k") + 5).alias("t_px"))
    return number_rounds(found, v)

@query("stream_score_rounds", ORACLE["score_rounds"])
def stream_score_rounds(v: View):
    found = kernel(v, live.CountedScores(unit=float(HOUR)), "type", "k")
    return number_rounds(found, v)

@query("stream_gap_sessions", ORACLE["gap_episodes"].replace("SELECT video_id, episode, min(t)", "SELECT video_id, min(t)"))
def stream_gap_sessions(v: View):
    g = live.gap_sessions(typed(v), KEY, "ts", "6 hours", F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("n"))
    return live.drain(g, ending=v.ending).select("video_id", "first_t", "last_t", "n")

@query("stream_buckets", on_events("SELECT video_id, CAST(floor(t / 28800000000.0) AS BIGINT) AS bucket, count(*) AS n, sum(k) AS total FROM m GROUP BY ALL".replace("sum(k)", "CAST(sum(k) AS BIGINT)")))
def stream_buckets(v: View):
    b = live.buckets(typed(v), KEY, "ts", "8 hours", None, F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))
    return live.drain(b, ending=v.ending).select("video_id", F.floor(F.unix_micros("_w.start") / (8 * HOUR)).alias("bucket"), "n", "total")

@query("stream_sliding", on_events("SELECT b AS bucket, count(*) AS n FROM (SELECT unnest([CAST(floor(t / 14400000000.0) AS BIGINT), CAST(floor(t / 14400000000.0) AS BIGINT) - 1]) AS b FROM m) GROUP BY b"))
def stream_sliding(v: View):
    b = live.buckets(typed(v), [], "ts", "8 hours", "4 hours", F.count(F.lit(1)).alias("n"))
    return live.drain(b, ending=v.ending).select(F.floor(F.unix_micros("_w.start") / (4 * HOUR)).alias("bucket"), "n")

@query("stream_dedup", on_events("SELECT DISTINCT video_id, CAST(floor(t / 7200000000.0) AS BIGINT) AS frame FROM m"))
def stream_dedup(v: View):
    s = typed(v, "2 hours", ending=False).select("video_id", F.floor(F.col("t") / (2 * HOUR)).alias("frame"), "ts")
    return live.drain(live.once(s, ["video_id", "frame"])).select("video_id", "frame")

@query("stream_band_join", on_events("""
SELECT a.video_id, a.seq, b.seq AS shot_seq FROM m a JOIN m b ON a.video_id = b.video_id AND a.type = 'player_kill' AND b.type = 'engagement_candidate' AND b.t BETWEEN a.t - 10800000000 AND a.t + 10800000000"""))
def stream_band_join(v: View):
    kills = typed(v, ending=False).filter("type = 'player_kill'").select("video_id", "seq", "ts")
    shots = typed(v, ending=False).filter("type = 'engagement_candidate'").select(
        F.col("video_id").alias("shot_video"), F.col("seq").alias("shot_seq"), F.col("ts").alias("shot_ts"))
    near = F.expr("video_id = shot_video AND shot_ts BETWEEN ts - INTERVAL 3 HOURS AND ts + INTERVAL 3 HOURS")
    return live.drain(live.band_join(kills, shots, near)).select("video_id", "seq", "shot_seq")

@query("stream_counters", on_events("SELECT video_id, count(*) AS frames, count(*) FILTER (flashed) AS flashed, count(*) FILTER (shot) AS shots, max(score) AS top_score FROM smp GROUP BY video_id", S.format("m")))
def stream_counters(v: View):
    s = tables.sample_signals(typed(v, ending=False))
    c = s.groupBy("video_id").agg(F.count(F.lit(1)).alias("frames"), F.count_if("flashed").alias("flashed"), F.count_if("shot").alias("shots"), F.max("score").alias("top_score"))
    return live.drain(c, "update", latest=["video_id"])

@query("stream_tracks")
def stream_tracks(v: View):
    """Frames are orders; an order's number in seconds stands for its time."""
    spark = live.with_state_store(v.spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2_000)  # of packs
    read = ["l_orderkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    l = live.read_table(spark, live.in_time_order(spark, v.dir, "lineitem", "l_orderkey", ["l_suppkey"], read))
    q, d = F.col("l_quantity") * 10, F.col("l_discount") * 1000
    sides = {"x1": q, "y1": d, "x2": q + 60 + F.col("l_tax") * 1000, "y2": d + 60 + F.col("l_linenumber") * 10}
    rows = l.select(F.col("l_suppkey").alias("supp"), F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("no"), F.col("l_returnflag").alias("label"),
                    F.col("l_partkey").alias("part"), F.col("l_extendedprice").cast("double").alias("price"), *[e.cast("double").alias(c) for c, e in sides.items()],
                    F.timestamp_seconds(F.col("l_orderkey") + 1).alias("ts"))  # time 0 is behind the first watermark
    ending = live.Ending(spark)
    order = ["frame", "no", "part", "price", *sides, "label"]
    hits = live.run_packed(ending.join(rows), ["supp"], order, live.FrameKernel(BoxTracker()), IDLE, "1 hour")
    return named(live.drain(hits, ending=ending))
