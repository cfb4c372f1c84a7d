"""Scalar scoring rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dominant_label(enemy: Column, mate: Column, keep: Column, ratio: float = 1.5) -> Column:
    """The colour with ``ratio`` times the other decides; a one-sided count decides; else keep."""
    return (F.when((mate == 0) & (enemy > 0), "enemy").when((enemy == 0) & (mate > 0), "teammate")
            .when((enemy > 0) & (enemy >= mate * ratio), "enemy").when((mate > 0) & (mate >= enemy * ratio), "teammate")
            .otherwise(keep))


def dominant_team(t: Column, ct: Column, minimum: Column, ratio: float = 1.8) -> Column:
    return F.when((t >= minimum) & (t > ct * ratio), "t").when((ct >= minimum) & (ct > t * ratio), "ct")


def clip_score(distance: Column) -> Column:
    """Cosine distance to a score in [-1, 1]."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - distance))


def inference_stride(sample_fps: Column, target_fps: Column) -> Column:
    """``max(1, round half-even(sample / target))``; NULL unless both rates are positive."""
    return F.when((sample_fps > 0) & (target_fps > 0), F.greatest(F.lit(1), F.bround(sample_fps / target_fps).cast("int")))


def fourcc(value: Column) -> Column:
    """FourCC integer to its codec label, NULL when not positive or blank."""
    def at(n: int) -> Column:
        return F.char(F.shiftright(value, n).bitwiseAND(F.lit(255)))
    text = F.rtrim(F.concat(at(0), at(8), at(16), at(24)))
    return F.when((value > 0) & (F.length(text) > 0), text)
