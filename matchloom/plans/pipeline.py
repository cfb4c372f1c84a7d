"""From detectors to the report: their outputs are united, sessionised again and summed up."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.operators import combat as cc
from matchloom.operators import reports as rp
from matchloom.operators import sessions as ss
from matchloom.operators.blocks import durable, run_blocks
from matchloom.plans.combat import DEATHS, HYST, TIMER, smoothed_ratio, status_samples
from matchloom.plans.registry import HOUR, KEY, View, on_events, query
from matchloom.plans.reports import ST, UNIT

#: At one time an end comes before a start, and both before what happens in the round.
TIMELINE = ["t", "ord", "seq"]


def boundaries(v: View):
    found = run_blocks(smoothed_ratio(v, 2), KEY, ["t", "seq"], v.block, TIMER)
    return durable(found.select("video_id", "seq", "t", F.col("kind").alias("type"), F.when(F.col("kind") == "round_end", 0).otherwise(1).alias("ord")))


def timeline(v: View):
    """Boundaries, deaths found within their rounds, kills and engagement candidates, attached to rounds; written once."""
    ends = boundaries(v)
    rounds = ss.session_table(ss.bracket_sessions(ends, KEY, TIMELINE, v.block), KEY)
    deaths = cc.native_deaths(rounds, status_samples(v), v.width, 9.0 * HOUR, min_eligible=.1)
    two, no = F.lit(2).alias("ord"), F.lit(None).cast("int").alias("k")
    rows = ends.select("video_id", "seq", "t", "type", "ord", no)
    rows = rows.unionByName(deaths.select("video_id", "seq", "t", F.lit("player_death").alias("type"), two, no))
    rows = rows.unionByName(v.m.filter(F.col("type").isin("player_kill", "engagement_candidate")).select("video_id", "seq", "t", "type", two, "k"))
    return durable(ss.bracket_sessions(rows, KEY, TIMELINE, v.block))


def stats(v: View):
    k = F.col("k")
    return rp.round_stats(timeline(v), (F.col("type") == "engagement_candidate") & (k < 50), k % 2 == 0, k % 3, k % 4, k % 2 == 0, F.col("video_id") % 4 != 0)


def attached_sql(rows: str) -> str:
    return f"""SELECT * FROM (SELECT *, CAST(sum(CASE WHEN type='round_start' THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY t, ord, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS rid,
  last_value(CASE WHEN type IN ('round_start','round_end') THEN type END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY t, ord, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lb FROM {rows}) WHERE type='round_start' OR lb='round_start'"""


PARTS = (HYST, "b0 AS (SELECT video_id, seq, t, kind AS type, CASE kind WHEN 'round_end' THEN 0 ELSE 1 END AS ord FROM ev)",
         f"r AS (SELECT video_id, rid, min(CASE WHEN type='round_start' THEN t END) AS s, max(CASE WHEN type='round_end' THEN t END) AS e FROM ({attached_sql('b0')}) GROUP BY ALL)",
         DEATHS.format(u="(9*3600000000)", share=.1),
         """u0 AS (SELECT video_id, seq, t, type, ord, NULL::INTEGER AS k FROM b0 UNION ALL SELECT video_id, seq, t, 'player_death', 2, NULL FROM pick WHERE video_id IN (SELECT video_id FROM gate)
  UNION ALL SELECT video_id, seq, t, type, 2, k FROM m WHERE type IN ('player_kill','engagement_candidate'))""",
         f"a AS ({attached_sql('u0')})", ST)


@query("pipeline_rounds", "WITH RECURSIVE " + on_events("SELECT * FROM stt0", *PARTS)[5:])
def pipeline_rounds(v: View):
    return stats(v)


@query("pipeline_report", "WITH RECURSIVE " + on_events("""
SELECT video_id, count(*) AS rounds, CAST(sum(kills) AS BIGINT) AS kills, count(*) FILTER (deaths > 0) AS deaths, round(avg(survival) / 1800000000, 3) AS avg_survival,
  CAST(sum(engagements) AS BIGINT) AS engagements, CAST(sum(likely_firefights) AS BIGINT) AS likely_firefights FROM stt0 GROUP BY video_id""", *PARTS)[5:])
def pipeline_report(v: View):
    return rp.match_overview(stats(v)).withColumn("avg_survival", F.round(F.col("avg_survival") / UNIT, 3))
