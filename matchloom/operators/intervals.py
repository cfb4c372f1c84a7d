"""Range joins as equi-joins on time cells.

An interval is written to the cells it covers at the coarsest level where it
covers at most ``FAN`` of them; a point is written once per level.  Joining on
``key + level + cell`` and then testing the exact bounds gives every match once,
spreads a hot key over its cells, and never compares all pairs of a key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from matchloom.operators.scan import block_of, scan

FAN = 32
LEVELS = 4


def _cell(col: Column, width: Column | float) -> Column:
    return F.floor(col / width).cast("long")


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    on: Sequence[str],
    at: str,
    start: str,
    end: str,
    width: float,
    closed: str = "left",
    open_ended: bool = False,
) -> DataFrame:
    """Inner join of ``points.at`` into ``intervals``.

    ``closed`` is ``left`` for [start, end), ``right`` for (start, end] or ``both``.
    With ``open_ended`` a NULL end means "until the last point of the key".
    """
    on = list(on)
    iv = intervals
    stop = F.col(end)
    if open_ended:
        tails = points.groupBy(*on).agg(F.max(at).alias("_tail"))
        iv = iv.join(tails, on)
        stop = F.coalesce(F.col(end), F.col("_tail"))
    iv = iv.withColumn("_stop", stop).filter(F.col("_stop") >= F.col(start))
    span = F.col("_stop") - F.col(start)
    level = F.lit(LEVELS - 1)
    for l in range(LEVELS - 2, -1, -1):
        level = F.when(span < F.lit(float(width) * FAN ** (l + 1)), l).otherwise(level)
    size = F.lit(float(width)) * F.pow(F.lit(float(FAN)), F.col("_level"))
    iv = iv.withColumn("_level", level).withColumn(
        "_cell", F.explode(F.sequence(_cell(F.col(start), size), _cell(F.col("_stop"), size))))
    pt = points.withColumn("_level", F.explode(F.array(*[F.lit(l) for l in range(LEVELS)])))
    pt = pt.withColumn("_cell", _cell(F.col(at), size))
    lower = F.col(at) > F.col(start) if closed == "right" else F.col(at) >= F.col(start)
    upper = F.col(at) < F.col(end) if closed == "left" else F.col(at) <= F.col(end)
    if open_ended:
        upper = F.col(end).isNull() | upper
    joined = pt.join(iv, [*on, "_level", "_cell"]).filter(lower & upper)
    return joined.drop("_level", "_cell", "_stop", "_tail")


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    first: str,
    last: str,
    start: str,
    end: str,
    width: float,
) -> DataFrame:
    """``first < end and last >= start``; an open right side needs ``first >= start``.

    Each overlapping pair either has the left start inside the right interval or
    the right start inside the left one, so two point joins give every pair once.
    """
    inside = interval_join(left, right, on, first, start, end, width, "left", open_ended=True)
    covers = interval_join(right.filter(F.col(end).isNotNull()), left, on, start, first, last, width, "right")
    # a closed right interval that is empty can only be met from the left's side
    return inside.unionByName(covers.filter(F.col(first) < F.col(end)).select(*inside.columns))


def overlap_counts(
    items: DataFrame,
    intervals: DataFrame,
    on: Sequence[str],
    first: str,
    last: str,
    start: str,
    end: str,
    width: float,
    counts: Mapping[str, Column],
) -> DataFrame:
    """The columns of ``intervals`` and, per name, how many overlapping items meet the condition (of the items).

    An open interval overlaps every item that begins with or after it, so these are
    counted and not paired: all items of the key less those that began before, which a
    running sum over blocks tells.
    """
    on, names = list(on), list(counts)
    flagged = items.select(*on, first, last, *[F.coalesce(c, F.lit(False)).cast("long").alias(n) for n, c in counts.items()])
    closed, open_ = intervals.filter(F.col(end).isNotNull()), intervals.filter(F.col(end).isNull())
    pairs = overlap_join(flagged, closed, on, first, last, start, end, width)
    met = pairs.groupBy(*intervals.columns).agg(*[F.sum(n).alias(n) for n in names])
    met = closed.join(met.drop(end), [c for c in intervals.columns if c != end], "left")
    began = flagged.select(*on, F.col(first).alias("_at"), F.lit(1).alias("_item"), *names)
    marks = open_.select("*", F.col(start).alias("_at"), F.lit(0).alias("_item"))
    both = marks.unionByName(began, allowMissingColumns=True)
    before = scan(both, on, ["_at", "_item"], block_of("_at", width), total={f"_{n}": F.coalesce(n, F.lit(0)) for n in names}).filter("_item = 0")
    every = flagged.groupBy(*on).agg(*[F.sum(n).alias(f"_all_{n}") for n in names])
    rest = before.drop(*names).join(every, on, "left").select(*intervals.columns, *[(F.col(f"_all_{n}") - F.col(f"_{n}")).alias(n) for n in names])
    out = met.select(*intervals.columns, *names).unionByName(rest)
    return out.select(*intervals.columns, *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names])


def box_pairs(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    a: Sequence[str],
    b: Sequence[str],
    cell: float,
) -> DataFrame:
    """Pairs of boxes with a positive intersection, found through grid cells.

    A pair is reported by the cell that holds the lower corner of its
    intersection, so it appears once.  ``a``/``b`` name x1, y1, x2, y2.
    """
    on = list(on)

    def spread(df: DataFrame, box: Sequence[str]) -> DataFrame:
        x1, y1, x2, y2 = box
        return df.withColumn("_cx", F.explode(F.sequence(_cell(F.col(x1), cell), _cell(F.col(x2), cell)))).withColumn(
            "_cy", F.explode(F.sequence(_cell(F.col(y1), cell), _cell(F.col(y2), cell))))

    joined = spread(left, a).join(spread(right, b), [*on, "_cx", "_cy"])
    lx, ly = F.greatest(a[0], b[0]), F.greatest(a[1], b[1])
    owned = (_cell(lx, cell) == F.col("_cx")) & (_cell(ly, cell) == F.col("_cy"))
    meets = (F.least(a[2], b[2]) > lx) & (F.least(a[3], b[3]) > ly)
    return joined.filter(owned & meets).drop("_cx", "_cy")


def iou(a: Sequence[str], b: Sequence[str]) -> Column:
    """Intersection over union; touching edges give 0."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda r: (F.col(r[2]) - F.col(r[0])) * (F.col(r[3]) - F.col(r[1]))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))
