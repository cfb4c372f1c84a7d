"""Rule tables compiled into one projection.

A rule is a row-level predicate with the fields it emits.  All rules of a set
are evaluated in one ``explode(array_compact(array(when ...)))`` so adding a rule
adds an expression, not another pass over the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Rule:
    """``when``, ``at`` and ``confidence`` are Spark SQL expressions over the input row."""

    name: str
    when: str
    confidence: str
    category: str = ""
    severity: str = "info"
    template: str = ""
    at: str = "CAST(NULL AS BIGINT)"


def fire(df: DataFrame, rules: Sequence[Rule], keep: Sequence[str]) -> DataFrame:
    """One row per fired rule: ``keep`` columns plus rule_no, name, category, severity, confidence, template, at."""
    hits = [
        F.when(F.expr(r.when), F.struct(
            F.lit(no).alias("rule_no"), F.lit(r.name).alias("name"), F.lit(r.category).alias("category"),
            F.lit(r.severity).alias("severity"), F.expr(r.confidence).cast("double").alias("confidence"),
            F.lit(r.template or r.name).alias("template"), F.expr(r.at).cast("long").alias("at")))
        for no, r in enumerate(rules)
    ]
    fired = df.withColumn("_hit", F.explode(F.array_compact(F.array(*hits))))
    return fired.select(*keep, "_hit.*")
