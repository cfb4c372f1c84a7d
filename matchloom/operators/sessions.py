"""Sessions, episodes, islands and sample-weight operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from matchloom.operators.blocks import durable
from matchloom.operators.scan import islands, scan


def bracket_sessions(
    events: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    block: Column,
    kind: str = "type",
    start: str = "round_start",
    end: str = "round_end",
    **extra,
) -> DataFrame:
    """Attach each event to the session its START opened.

    A START closes a dangling session (its end stays NULL), an END closes the open
    one, rows outside a session are dropped, a trailing open session is kept.
    ``rid`` is the 1-based session ordinal.  ``extra`` passes further running
    columns to :func:`matchloom.operators.scan.scan` so they share its sort.
    """
    opening = F.col(kind) == start
    boundary = F.when(F.col(kind).isin(start, end), F.col(kind))
    total = {"rid": opening.cast("long"), **extra.pop("total", {})}
    last = {"_boundary": boundary, **extra.pop("last", {})}
    out = scan(events, key, order, block, total=total, last=last, **extra)
    return out.filter(opening | (F.col("_boundary") == start)).drop("_boundary")


def session_table(
    attached: DataFrame,
    key: Sequence[str],
    t: str = "t",
    kind: str = "type",
    start: str = "round_start",
    end: str = "round_end",
    **aggs: Column,
) -> DataFrame:
    """One row per session: start ``s``, end ``e`` (NULL = open), ``n`` events."""
    return attached.groupBy(*key, "rid").agg(
        F.min(F.when(F.col(kind) == start, F.col(t))).alias("s"),
        F.max(F.when(F.col(kind) == end, F.col(t))).alias("e"),
        F.count(F.lit(1)).alias("n"),
        *[c.alias(n) for n, c in aggs.items()])


def gap_islands(df: DataFrame, key, order, block, t: str, gap, out: str = "episode") -> DataFrame:
    """A new episode opens when the step from the previous row exceeds ``gap``."""
    return islands(df, key, order, block, {"t": F.col(t)}, lambda p, c: c["t"] - p["t"] > gap, out)


def flag_runs(df: DataFrame, key, order, block, flag: Column, out: str = "run") -> DataFrame:
    """Rows of consecutive true samples, numbered by run."""
    flagged = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    numbered = islands(flagged, key, order, block, {"f": F.col("_flag")}, lambda p, c: p["f"] != c["f"], out)
    return numbered.filter("_flag").drop("_flag")


def union_intervals(
    df: DataFrame, key, start: str, end: str, width, gap, duration: Column | None = None,
    lower: float = 0,
) -> DataFrame:
    """Clamp to ``[lower, duration]``, drop empty ones, merge when ``start <= previous end + gap``."""
    s = F.greatest(F.lit(lower), F.col(start))
    e = F.greatest(s, F.col(end))
    if duration is not None:
        s, e = F.least(s, duration), F.least(e, duration)
    rows = df.select(*key, s.alias("_s"), e.alias("_e")).filter(F.col("_e") > F.col("_s"))
    # same start: the longest covers the rest; written once because the two scans below read it four times
    rows = durable(rows.groupBy(*key, "_s").agg(F.max("_e").alias("_e")))
    block = F.floor(F.col("_s") / width).cast("long")
    reach = scan(rows, key, ["_s"], block, peak={"_reach": F.col("_e")})
    opens = F.when(F.col("_reach").isNull() | (F.col("_s") > F.col("_reach") + gap), 1).otherwise(0)
    grouped = scan(reach.withColumn("_open", opens), key, ["_s"], block, total={"window": F.col("_open")})
    return grouped.groupBy(*key, "window").agg(F.min("_s").alias("start"), F.max("_e").alias("end"))


def refinement_triggers(samples: DataFrame, key, order, block, flags: Sequence[str], health: str) -> DataFrame:
    """Samples with any flag set, or where health was visible on the previous sample and is not now."""
    seen = scan(samples, key, order, block, prev={"_was": F.col(health)})
    lost = F.coalesce(F.col("_was"), F.lit(False)) & ~F.coalesce(F.col(health), F.lit(False))
    any_flag = lost
    for f in flags:
        any_flag = any_flag | F.coalesce(F.col(f), F.lit(False))
    return seen.filter(any_flag).drop("_was")


def refinement_windows(
    samples: DataFrame, detections: DataFrame | None, key, order, block, t: str, flags: Sequence[str], health: str,
    width, before, after, gap, duration: Column | None = None,
) -> DataFrame:
    """Merged high-rate windows around triggers and around samples with detections."""
    marks = refinement_triggers(samples, key, order, block, flags, health).select(*key, t)
    if detections is not None:
        marks = marks.unionByName(detections.select(*key, t))
    spans = marks.select(*key, (F.col(t) - before).alias("_from"), (F.col(t) + after).alias("_to"))
    return union_intervals(spans, key, "_from", "_to", width, gap, duration)


def rising_edges(df: DataFrame, key, order, block, flag: Column) -> DataFrame:
    """Rows where the flag turns true."""
    f = F.coalesce(flag, F.lit(False))
    return scan(df, key, order, block, prev={"_was": f}).filter(f & ~F.coalesce(F.col("_was"), F.lit(False))).drop("_was")


def weighted_round_summary(
    samples: DataFrame, key, weight: Column, flash: Column, scope: Column, motion: Column,
    still_below: float = 0.12,
) -> DataFrame:
    """Time-weighted sums, mean and ratio; motion ignores flashed and unknown samples."""
    usable = motion.isNotNull() & ~flash
    total = F.sum(F.when(usable, weight))
    return samples.groupBy(*key).agg(
        F.sum(F.when(flash, weight).otherwise(0)).alias("flash_time"),
        F.sum(F.when(scope, weight).otherwise(0)).alias("scope_time"),
        F.coalesce(F.sum(F.when(usable, motion * weight)) / F.when(total > 0, total), F.lit(0.0)).alias("motion_avg"),
        F.coalesce(F.sum(F.when(usable & (motion < still_below), weight)) / F.when(total > 0, total),
                   F.lit(0.0)).alias("stationary_ratio"))


def value_chains(df: DataFrame, key, order, block, t: str, value: str, gap, out: str = "chain") -> DataFrame:
    """Runs of an unchanged value with bounded time steps."""
    return islands(df, key, order, block, {"t": F.col(t), "v": F.col(value)},
                   lambda p, c: (c["v"] != p["v"]) | (c["t"] - p["t"] > gap), out)


def first_stable_value(df: DataFrame, key, order, block, t: str, value: str, gap, minimum: int = 2) -> DataFrame:
    """The earliest chain of at least ``minimum`` equal readings per key."""
    chains = value_chains(df, key, order, block, t, value, gap).groupBy(*key, "chain").agg(
        F.min(t).alias("since"), F.max(t).alias("until"), F.first(value).alias("value"), F.count(F.lit(1)).alias("n"))
    best = F.min_by(F.struct("since", "until", "value", "n"), F.col("since"))
    return chains.filter(F.col("n") >= minimum).groupBy(*key).agg(best.alias("c")).select(*key, "c.*")


def longest_clock_chain(
    df: DataFrame, key, order, block, t: str, clock: str, unit: float = 1.0,
    backward: float = 1.0, slack: float = 4.0, need_drop: float = 1.0,
) -> DataFrame:
    """Longest run of readings that count down consistently with elapsed time.

    A step is consistent when time advances and ``-backward <= drop <= elapsed + slack``.
    A chain needs two readings and one drop of ``need_drop``; the earliest wins ties.
    """
    def broken(p, c):
        elapsed = (c["t"] - p["t"]) / F.lit(unit)
        drop = p["v"] - c["v"]
        return ~((elapsed > 0) & (drop >= -backward) & (drop <= elapsed + slack))

    fields = {"t": F.col(t), "v": F.col(clock).cast("double")}
    numbered = islands(df, key, order, block, fields, broken, "chain")
    stepped = scan(numbered, [*key, "chain"], order, block, prev={"_pv": F.col(clock).cast("double")})
    chains = stepped.groupBy(*key, "chain").agg(
        F.count(F.lit(1)).alias("n"), F.min(t).alias("since"), F.max(t).alias("until"),
        F.min_by(F.col(clock), F.struct(*order)).alias("first_clock"),
        F.max(F.col("_pv") - F.col(clock)).alias("_drop"))
    chains = chains.filter((F.col("n") >= 2) & (F.col("_drop") >= need_drop))
    best = F.max_by(F.struct("n", "since", "until", "first_clock"), F.struct(F.col("n"), -F.col("since")))
    return chains.groupBy(*key).agg(best.alias("c")).select(*key, "c.*")


def carry_forward(df: DataFrame, key, order, block, values: Mapping[str, Column], defaults: Mapping[str, Column] | None = None) -> DataFrame:
    """Last known value up to and including the row."""
    names = {f"_before_{n}": c for n, c in values.items()}
    out = scan(df, key, order, block, last=names)
    for n, c in values.items():
        picks = [c, F.col(f"_before_{n}")]
        if defaults and n in defaults:
            picks.append(defaults[n])
        out = out.withColumn(n, F.coalesce(*picks))
    return out.drop(*names)


def rate_difference(df: DataFrame, key, order, block, t: str, value: str, unit: float, floor: float = 0.05,
                    out: str = "rate") -> DataFrame:
    """``min(1, |difference| / max(elapsed, floor))``; NULL on the first row."""
    seen = scan(df, key, order, block, prev={"_pt": F.col(t), "_pv": F.col(value)})
    elapsed = F.greatest((F.col(t) - F.col("_pt")) / F.lit(unit), F.lit(floor))
    return seen.withColumn(out, F.when(F.col("_pt").isNotNull(), F.least(
        F.lit(1.0), F.abs(F.col(value) - F.col("_pv")) / elapsed))).drop("_pt", "_pv")


def round_keyframes(
    rounds: DataFrame, key: str, start: str, stop: Column, samples: int, frame: Column, cap: int,
) -> DataFrame:
    """Evenly spaced frames ``i / (samples + 1)`` inside each round, one per frame, first ``cap`` per key."""
    spread = rounds.withColumn("_stop", stop).filter(F.col("_stop") > F.col(start)).withColumn(
        "sample_index", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    at = F.col(start) + F.floor((F.col("_stop") - F.col(start)) * F.col("sample_index") / (samples + 1)).cast("long")
    spread = spread.withColumn("at", at).withColumn("frame_index", frame)
    once = spread.groupBy(key, "frame_index").agg(
        F.min(F.struct("rid", "sample_index", "at")).alias("f")).select(key, "frame_index", "f.*")
    return top_per_group(once, [key], ["rid", "sample_index"], cap, "position").drop("position")


def top_per_group(df: DataFrame, key: Sequence[str], order: Sequence, n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key.  Catalyst keeps ``n`` per task before the shuffle."""
    from pyspark.sql import Window
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
