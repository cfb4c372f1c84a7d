"""Exact ordered computations over a key without putting the key in one task.

A window partitioned by the key alone sends every row of a hot key to one task.
Here each key's timeline is cut into blocks (``block`` is any monotone function
of the order, usually ``floor(t / width)``).  Rows are windowed inside their
block; a one-row-per-block summary, aggregated map-side before its shuffle,
carries the running value from block to block and is joined back on
``key + block``.  The result is the same as the unblocked window.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

BLOCK = "_block"


def block_of(column: str | Column, width: int | float) -> Column:
    col = F.col(column) if isinstance(column, str) else column
    return F.floor(col / F.lit(width)).cast("long")


def scan(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    block: Column,
    *,
    total: Mapping[str, Column] | None = None,
    peak: Mapping[str, Column] | None = None,
    last: Mapping[str, Column] | None = None,
    ahead: Mapping[str, Column] | None = None,
    prev: Mapping[str, Column] | None = None,
    nxt: Mapping[str, Column] | None = None,
    rank: str | None = None,
) -> DataFrame:
    """Add running columns over ``(key ORDER BY order)``.

    ``total``  inclusive running sum;          ``peak``  max over earlier rows;
    ``last``   last non-null of earlier rows;  ``ahead`` next non-null of later rows;
    ``prev``/``nxt`` value on the neighbouring row;  ``rank`` 1-based row number.
    """
    key, order = list(key), list(order)
    total, peak, last = dict(total or {}), dict(peak or {}), dict(last or {})
    ahead, prev, nxt = dict(ahead or {}), dict(prev or {}), dict(nxt or {})
    rows = df.withColumn(BLOCK, block)
    pos = F.struct(*order)
    w = W.partitionBy(*key, BLOCK).orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    back = W.partitionBy(*key, BLOCK).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(
        W.unboundedPreceding, -1)

    local = ["*"]
    sums: list[Column] = []
    ws = W.partitionBy(*key).orderBy(BLOCK)
    ws_before = ws.rowsBetween(W.unboundedPreceding, -1)
    ws_back = W.partitionBy(*key).orderBy(F.col(BLOCK).desc()).rowsBetween(W.unboundedPreceding, -1)
    carry: list[Column] = []
    final: dict[str, Column] = {}

    def add(name, window_expr, agg_expr, carry_expr, combine):
        local.append(window_expr.alias(f"_l_{name}"))
        sums.append(agg_expr.alias(f"_s_{name}"))
        carry.append(carry_expr(F.col(f"_s_{name}")).alias(f"_c_{name}"))
        final[name] = combine(F.col(f"_l_{name}"), F.col(f"_c_{name}"))

    for name, e in total.items():
        add(name, F.sum(e).over(upto), F.sum(e),
            lambda s: F.coalesce(F.sum(s).over(ws_before), F.lit(0)),
            lambda l, c: F.coalesce(l, F.lit(0)) + c)
    for name, e in peak.items():
        add(name, F.max(e).over(before), F.max(e),
            lambda s: F.max(s).over(ws_before), lambda l, c: F.greatest(l, c))
    for name, e in last.items():
        add(name, F.last(e, ignorenulls=True).over(before),
            F.max_by(e, F.when(e.isNotNull(), pos)),
            lambda s: F.last(s, ignorenulls=True).over(ws_before), F.coalesce)
    for name, e in ahead.items():
        add(name, F.last(e, ignorenulls=True).over(back),
            F.min_by(e, F.when(e.isNotNull(), pos)),
            lambda s: F.last(s, ignorenulls=True).over(ws_back), F.coalesce)
    for name, e in prev.items():
        box = F.struct(e.alias("v"))
        add(name, F.lag(box).over(w), F.max_by(box, pos),
            lambda s: F.lag(s).over(ws), lambda l, c: F.coalesce(l, c)["v"])
    for name, e in nxt.items():
        box = F.struct(e.alias("v"))
        add(name, F.lead(box).over(w), F.min_by(box, pos),
            lambda s: F.lead(s).over(ws), lambda l, c: F.coalesce(l, c)["v"])
    if rank:
        add(rank, F.row_number().over(w).cast("long"), F.count(F.lit(1)),
            lambda s: F.coalesce(F.sum(s).over(ws_before), F.lit(0)), lambda l, c: l + c)

    summary = rows.groupBy(*key, BLOCK).agg(*sums).select(*key, BLOCK, *carry)
    joined = rows.select(*local).join(summary, [*key, BLOCK])
    return joined.select(*df.columns, *[e.alias(n) for n, e in final.items()])


def islands(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    block: Column,
    fields: Mapping[str, Column],
    breaks: Callable[[Column, Column], Column],
    out: str = "island",
) -> DataFrame:
    """Number gap-and-island groups 1, 2, ... per key.

    ``breaks(previous, current)`` says whether a new island opens; both arguments
    are structs made of ``fields``.
    """
    key, order = list(key), list(order)
    rows = df.withColumn(BLOCK, block)
    cur = F.struct(*[e.alias(n) for n, e in fields.items()])
    w = W.partitionBy(*key, BLOCK).orderBy(*order)
    rows = rows.withColumn("_cur", cur).withColumn("_prev", F.lag("_cur").over(w))
    opens = F.when(F.col("_prev").isNull(), 0).otherwise(
        F.coalesce(breaks(F.col("_prev"), F.col("_cur")), F.lit(True)).cast("int"))
    rows = rows.withColumn("_open", opens)
    pos = F.struct(*order)
    summary = rows.groupBy(*key, BLOCK).agg(
        F.sum("_open").alias("_inner"),
        F.min_by("_cur", pos).alias("_first"),
        F.max_by("_cur", pos).alias("_final"))
    ws = W.partitionBy(*key).orderBy(BLOCK)
    summary = summary.withColumn("_left", F.lag("_final").over(ws)).withColumn(
        "_head", F.when(F.col("_left").isNull(), 1).otherwise(
            F.coalesce(breaks(F.col("_left"), F.col("_first")), F.lit(True)).cast("int")))
    summary = summary.select(
        *key, BLOCK,
        (F.coalesce(F.sum(F.col("_inner") + F.col("_head")).over(
            ws.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("_head")).alias("_base"))
    local = F.sum("_open").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("_n")
    joined = rows.select(*df.columns, BLOCK, local).join(summary, [*key, BLOCK])
    return joined.select(*df.columns, (F.col("_base") + F.col("_n")).cast("long").alias(out))


def trailing(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    block: Column,
    n: int,
    aggs: Mapping[str, Callable[..., Column]],
    chunk: int = 65536,
) -> DataFrame:
    """Aggregates over the current and the ``n - 1`` preceding rows.

    Rows are numbered, cut into chunks of equal row count, and the last ``n - 1``
    rows of a chunk are copied into the next one, so a chunk is self-contained.
    ``aggs`` maps an output name to a function of the window.
    """
    ranked = scan(df, key, order, block, rank="_rn").withColumn(
        "_chunk", F.floor((F.col("_rn") - 1) / chunk).cast("long"))
    halo = n > 1
    if halo:
        tail = (F.col("_rn") - 1) % chunk >= chunk - (n - 1)
        ranked = ranked.withColumn("_home", F.explode(F.when(
            tail, F.array(F.col("_chunk"), F.col("_chunk") + 1)).otherwise(F.array(F.col("_chunk")))))
    else:
        ranked = ranked.withColumn("_home", F.col("_chunk"))
    w = W.partitionBy(*key, "_home").orderBy(*order).rowsBetween(-(n - 1), 0)
    out = ranked.select("*", *[f(w).alias(name) for name, f in aggs.items()])
    return out.filter(F.col("_home") == F.col("_chunk")).select(*df.columns, *aggs.keys())


#: At this rate a chunk of the exponential baseline has about nine million rows.
MOST_KEPT = 0.99999


def ema(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    block: Column,
    values: Mapping[str, str],
    keep: float = 0.85,
) -> DataFrame:
    """Exponential baseline *before* the current row; the first value seeds it.

    ``values`` maps an output name to an input column.  Inside a chunk the closed
    form ``keep^j * entry + (1-keep) * sum keep^(j-1-i) x_i`` is one running sum.
    The length of a chunk follows from ``keep``: a whole chunk scales what came before
    it by about 1e-40, so two preceding chunks carry everything a double can hold and
    no power overflows. ``keep`` has to lie in (0, 1); beyond MOST_KEPT a chunk would be
    longer than a task should sort, and that is refused.
    """
    if not 0 < keep <= MOST_KEPT:
        raise ValueError(f"keep must be above 0 and at most {MOST_KEPT}, not {keep}")
    chunk = max(2, math.ceil(-40 * math.log(10) / math.log(keep)))
    ranked = scan(df, key, order, block, rank="_rn")
    ranked = ranked.withColumn("_chunk", F.floor((F.col("_rn") - 1) / chunk).cast("long")).withColumn(
        "_j", ((F.col("_rn") - 1) % chunk).cast("double"))
    w = W.partitionBy(*key, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    k = F.lit(float(keep))
    gain = 1.0 - keep
    sums, locals_, carries, finals = [], [], [], []
    ws = W.partitionBy(*key).orderBy("_chunk")
    for name, col in values.items():
        seeded = F.when(F.col("_rn") == 1, F.col(col) / F.lit(gain)).otherwise(F.col(col))
        scaled = seeded * F.pow(k, -F.col("_j"))
        locals_.append((F.sum(scaled).over(w) * F.lit(gain) * F.pow(k, F.col("_j") - 1)).alias(f"_l_{name}"))
        sums.append((F.sum(scaled) * F.lit(gain) * F.pow(k, F.max("_j"))).alias(f"_s_{name}"))
        carries.append((F.lag(f"_s_{name}").over(ws)
                        + F.coalesce(F.lag(f"_s_{name}", 2).over(ws), F.lit(0.0)) * F.pow(k, F.lit(float(chunk)))
                        ).alias(f"_c_{name}"))
        finals.append(F.when(F.col("_rn") > 1,
                             F.coalesce(F.col(f"_l_{name}"), F.lit(0.0))
                             + F.coalesce(F.col(f"_c_{name}") * F.pow(k, F.col("_j")), F.lit(0.0))).alias(name))
    summary = ranked.groupBy(*key, "_chunk").agg(*sums).select(*key, "_chunk", *carries)
    joined = ranked.select("*", *locals_).join(summary, [*key, "_chunk"])
    return joined.select(*df.columns, *finals)


def choose_width(df: DataFrame, key: Sequence[str], t: str, probe: int, target_rows: int, widest: int) -> int:
    """Block width so that the densest ``key x probe`` slot stays under ``target_rows``.

    One aggregation with a one-number result; it never grows with the data.
    """
    slots = df.groupBy(*key, F.floor(F.col(t) / probe).alias("_slot")).count()
    densest = slots.agg(F.max("count").alias("m")).first()["m"] or 1
    return int(max(1, min(widest, probe * target_rows // densest)))
