"""Table functions and registered functions for SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from matchloom.operators.context import label_ratios
from matchloom.operators.knowledge import passages


@udtf(returnType="chunk_index: int, heading: string, content: string")
class ChunkText:
    """``SELECT ... FROM docs, LATERAL chunk_text(content, sep)``."""

    def eval(self, content: str, sep: str):
        yield from map(tuple, passages(content or "", sep, 900, 120, 40))


def register(spark: SparkSession) -> None:
    """Make ``chunk_text`` and ``label_ratios`` usable from SQL."""
    spark.udtf.register("chunk_text", ChunkText)
    spark.udf.register("label_ratios", label_ratios)
