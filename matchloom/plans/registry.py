"""Query registry and the typed views the queries share.

``View`` binds the driver's tables to the engine's data model: a user is a
recording, an event a sample or detector event, an order a frame.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from matchloom.operators import sessions
from matchloom.operators.blocks import written
from matchloom.operators.scan import block_of, choose_width
from matchloom.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

HOUR = 3_600_000_000
KEY = ["video_id"]
ORDER = ["t", "seq"]
_WIDTHS: dict[str, int] = {}


def running() -> dict[str, dict[str, Column]]:
    """Running columns that several queries attach: start of the round, next sample, next start or end of a round."""
    return {"last": {"_s": F.when(F.col("type") == "round_start", F.col("t"))},
            "nxt": {"nt": F.col("t")},
            "ahead": {"_end": F.when(F.col("type").isin("round_start", "round_end"), F.struct("t", "type"))}}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[["View"], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(View(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return register


class View:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir
        self.kept: DataFrame | None = None

    def settled(self) -> "View":
        """This view with its typed events, and the rounds attached to them, written once: for queries that read them many times.

        ``attached`` then offers the running columns of ``running`` only.
        """
        out = View(self.spark, self.dir)
        out.m = written(self.m)
        out.kept = written(sessions.bracket_sessions(out.m, KEY, ORDER, self.block, **{n: dict(c) for n, c in running().items()}))
        return out

    def table(self, name: str) -> DataFrame:
        return tables.table(self.spark, self.dir, name)

    def spread(self, name: str) -> DataFrame:
        """A table with enough splits for heavy per-row work."""
        return tables.spread(self.table(name))

    @cached_property
    def m(self) -> DataFrame:
        """Typed events: video_id, seq, t (micros), type, score, k."""
        return tables.typed_events(self.table("events"))

    @cached_property
    def width(self) -> int:
        """Timeline block width, sized once per data set from its densest hour."""
        if self.dir not in _WIDTHS:
            _WIDTHS[self.dir] = choose_width(self.m, KEY, "t", HOUR, 2_000_000, 240 * HOUR)
        return _WIDTHS[self.dir]

    @cached_property
    def frames(self) -> int:
        """Width of the blocks of orders that a supplier's tracks run in, sized once per data set; most suppliers have one."""
        if (name := f"{self.dir} frames") not in _WIDTHS:
            _WIDTHS[name] = choose_width(self.table("lineitem"), ["l_suppkey"], "l_orderkey", 100_000, 50_000, 1 << 40)
        return _WIDTHS[name]

    @property
    def block(self) -> Column:
        return block_of("t", self.width)

    def attached(self, **extra) -> DataFrame:
        if self.kept is not None:
            known = running()
            for kind, columns in extra.items():
                if not set(columns) <= set(known.get(kind, {})):
                    raise ValueError(f"not kept: {kind} {sorted(columns)}")
            return self.kept.select(*self.m.columns, "rid", *[c for columns in extra.values() for c in columns])
        return sessions.bracket_sessions(self.m, KEY, ORDER, self.block, **extra)

    def rounds(self, **aggs: Column) -> DataFrame:
        return sessions.session_table(self.attached(), KEY, **aggs)

    def samples(self, df: DataFrame | None = None) -> DataFrame:
        """Numeric signals per sample, derived from the event payload."""
        return tables.sample_signals(self.m if df is None else df)


# Oracle fragments -----------------------------------------------------------

M = """m AS (SELECT user_id AS video_id, event_id AS seq, epoch_us(ts) AS t,
  CASE event_type WHEN 'signup' THEN 'round_start' WHEN 'error' THEN 'round_end' WHEN 'purchase' THEN 'player_kill'
    WHEN 'view' THEN 'player_death' ELSE 'engagement_candidate' END AS type,
  value AS score, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)"""

X = """x AS (SELECT *, CAST(sum(CASE WHEN type='round_start' THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS rid,
  last_value(CASE WHEN type IN ('round_start','round_end') THEN type END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lb,
  lead(t) OVER (PARTITION BY video_id ORDER BY t, seq) AS nt FROM m),
a AS (SELECT * FROM x WHERE type='round_start' OR lb='round_start')"""

R = """r AS (SELECT video_id, rid, min(CASE WHEN type='round_start' THEN t END) AS s, max(CASE WHEN type='round_end' THEN t END) AS e,
  count(*) AS n FROM a GROUP BY video_id, rid)"""

S = """smp AS (SELECT *, k % 4 = 0 AS flashed, k % 3 = 0 AS scoped, k % 10 = 7 AS shot, k % 10 = 3 AS damage, k % 6 <> 0 AS health,
  CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(floor(score) AS BIGINT) END AS motion,
  CASE WHEN k % 5 = 0 THEN 't' WHEN k % 5 = 1 THEN 'ct' END AS team FROM {0})"""


def sql(body: str, *parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + body


def on_events(body: str, *more: str) -> str:
    return sql(body, M, *more)


def on_rounds(body: str, *more: str) -> str:
    return sql(body, M, X, R, *more)
