"""Table readers and the typed views over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# How event names of the input stand for engine event types.
EVENT_TYPES = {
    "signup": "round_start",
    "error": "round_end",
    "purchase": "player_kill",
    "view": "player_death",
    "click": "engagement_candidate",
}


# Event times are zone-free; skewed join keys are split even when that costs a shuffle.
SESSION = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> None:
    for name, value in SESSION.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """Redistribute a plain scan with fewer splits than cores before heavy per-row work.

    A large table has many splits and is left alone.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def micros(col: str):
    return F.unix_micros(F.col(col).cast("timestamp"))


def typed_events(events: DataFrame) -> DataFrame:
    kind = F.lit(None).cast("string")
    for raw, name in EVENT_TYPES.items():
        kind = F.when(F.col("event_type") == raw, name).otherwise(kind)
    return events.select(
        F.col("user_id").alias("video_id"),
        F.col("event_id").alias("seq"),
        micros("ts").alias("t"),
        kind.alias("type"),
        F.col("value").alias("score"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def sample_signals(m: DataFrame) -> DataFrame:
    k = F.col("k")
    return m.select(
        "*",
        (k % 4 == 0).alias("flashed"),
        (k % 3 == 0).alias("scoped"),
        (k % 10 == 7).alias("shot"),
        (k % 10 == 3).alias("damage"),
        (k % 6 != 0).alias("health"),
        F.when(k % 7 != 0, F.floor("score").cast("long")).alias("motion"),
        F.when(k % 5 == 0, "t").when(k % 5 == 1, "ct").alias("team"),
    )
