"""Point, band, nearest, merge, correction and lookup joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from matchloom.operators.intervals import interval_join
from matchloom.operators.scan import scan

CORRECTABLE = ("player_kill", "player_death")


def nearest_in_band(points: DataFrame, bands: DataFrame, on, at: str, lo: str, hi: str, width, point_key: Sequence[str],
                    distance: Column, pick: str, keep: Sequence[str]) -> DataFrame:
    """Left join of each point to its nearest admissible band (ties: smallest ``pick``)."""
    hit = interval_join(points, bands, on, at, lo, hi, width, "both")
    best = F.min_by(F.struct(*keep), F.struct(distance, F.col(pick)))
    hit = hit.groupBy(*point_key).agg(best.alias("_b")).select(*point_key, "_b.*")
    return points.join(hit, list(point_key), "left")


def near_flags(samples: DataFrame, key, order, block, t: str, flag: Column, within, out: str) -> DataFrame:
    """Whether a flagged sample of the key lies within ``within`` of the row, either side or the row itself."""
    at = F.when(flag, F.col(t))
    s = scan(samples, key, order, block, last={"_b": at}, ahead={"_a": at})
    near = (F.coalesce(flag, F.lit(False)) | F.coalesce(F.col(t) - F.col("_b") <= within, F.lit(False))
            | F.coalesce(F.col("_a") - F.col(t) <= within, F.lit(False)))
    return s.withColumn(out, near).drop("_a", "_b")


def flag_before(samples: DataFrame, key, order, block, t: str, flag: Column, within, out: str) -> DataFrame:
    """Whether a flagged sample lies in ``[t - within, t)``."""
    s = scan(samples, key, order, block, last={"_b": F.when(flag, F.col(t))})
    return s.withColumn(out, F.coalesce(F.col(t) - F.col("_b") <= within, F.lit(False))).drop("_b")


def prefer_refined(base: DataFrame, refined: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """One row per key: refined beats base, the later row wins inside a side."""
    both = base.withColumn("_p", F.lit(0)).unionByName(refined.withColumn("_p", F.lit(1)))
    rest = [c for c in base.columns if c not in key]
    best = F.max_by(F.struct(*rest, "_p"), F.struct("_p", order))
    return both.groupBy(*key).agg(best.alias("b")).select(*key, *[f"b.{c}" for c in rest], (F.col("b._p") == 1).alias("refined"))


def frames_in_windows(frames: DataFrame, windows: DataFrame, on, frame: str, start: str, end: str, step: int, width) -> DataFrame:
    """Frames at stride ``step`` counted from each window's first frame."""
    hit = interval_join(frames, windows, on, frame, start, end, width, "both")
    return hit.filter(F.pmod(F.col(frame) - F.col(start), F.lit(step)) == 0)


def apply_corrections(events: DataFrame, corrections: DataFrame, event_id: str = "event_id", kind: str = "type") -> DataFrame:
    """Drop correctable events that were rejected; everything else passes."""
    marks = corrections.select(event_id, F.col("accepted").alias("_ok"))
    joined = events.join(marks, event_id, "left")
    return joined.filter(~F.col(kind).isin(*CORRECTABLE) | F.coalesce("_ok", F.lit(True))).drop("_ok")


def add_manual_events(events: DataFrame, rounds: DataFrame, labels: DataFrame) -> DataFrame:
    """Append user labels of correctable types for existing rounds, once per new id, with confidence 1."""
    valid = labels.filter(F.col("type").isin(*CORRECTABLE))
    valid = valid.groupBy("event_id", "video_id", "rid").agg(F.min_by(F.struct("type", "t"), "seq").alias("b")).select(
        "event_id", "video_id", "rid", "b.*")
    valid = valid.join(rounds.select("video_id", "rid"), ["video_id", "rid"], "left_semi")
    valid = valid.join(events.select("event_id", "video_id", "rid"), ["event_id", "video_id", "rid"], "left_anti")
    added = valid.select("event_id", "video_id", "rid", "type", "t", F.lit(1.0).alias("confidence"),
                         F.lit("manual_label").alias("source"))
    return events.select(*added.columns).unionByName(added)


def diagnostic_rows(events: DataFrame, corrections: DataFrame) -> DataFrame:
    """Correctable events with their first source and whether they are accepted."""
    marks = corrections.select("event_id", F.col("accepted").alias("_ok"))
    return events.filter(F.col("type").isin(*CORRECTABLE)).join(marks, "event_id", "left").withColumn(
        "accepted", F.coalesce("_ok", F.lit(True))).drop("_ok")


def fill_templates(df: DataFrame, templates: DataFrame, locale: str, key: str, args: dict[str, Column], out: str = "text") -> DataFrame:
    """Look the template up by (locale, key); fall back to the key; fill ``{name}`` placeholders.

    How the caller's templates are joined is left to their size.
    """
    t = templates.filter(F.col("locale") == locale).select(F.col("key").alias(key), F.col("template").alias("_tpl"))
    text = F.coalesce("_tpl", F.col(key))
    joined = df.join(t, key, "left")
    for name, value in args.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return joined.withColumn(out, text).drop("_tpl")


def attach_assets(suggestions: DataFrame, assets: DataFrame, on, width, near, prefer_id: bool = True,
                  both_ways: bool = True) -> DataFrame:
    """At most one asset per suggestion.

    An asset whose event id occurs in the suggestion id (or the reverse) comes
    first, else the first listed one closer than ``near``.  With ``prefer_id``
    false the first listed match of either kind wins.  Ids match on their
    ``ref`` token (``type_round``), so the join is an equi-join.
    """
    keys = [*on, "suggestion_id"]
    a = assets.select(*on, F.col("ref").alias("_aref"), "event_id", "asset_no", F.col("t").alias("asset_t"))
    by_id = suggestions.withColumn("_aref", F.col("ref")).join(a, [*on, "_aref"])
    contains = F.contains("suggestion_id", "event_id")
    if both_ways:
        contains = contains | F.contains("event_id", "suggestion_id")
    by_id = by_id.filter(contains).select(*keys, "event_id", "asset_no", F.lit(0).alias("_p"))
    bands = suggestions.select(*keys, (F.col("t") - near).alias("_lo"), (F.col("t") + near).alias("_hi"))
    by_time = interval_join(a, bands, on, "asset_t", "_lo", "_hi", width, "left").filter(
        F.col("asset_t") > F.col("_lo")).select(*keys, "event_id", "asset_no", F.lit(1 if prefer_id else 0).alias("_p"))
    best = F.min(F.struct("_p", "asset_no", "event_id"))
    picked = by_id.unionByName(by_time).groupBy(*keys).agg(best.alias("b"))
    return picked.select(*keys, "b.event_id", "b.asset_no", (F.col("b._p") == 0).alias("by_id"))
