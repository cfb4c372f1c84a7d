"""Message templates as a small table keyed by locale and key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Our own English wording of the engine's messages.
EN = {
    "round.open": "Round {rid} is still open after {n} events.",
    "round.closed": "Round {rid} closed with {n} events.",
    "finding.round_start": "Round starts at {time}.",
    "finding.round_end": "Round ends at {time}.",
    "finding.round_truncated": "The recording stops before this round ends.",
    "finding.kills": "{n} kills observed.",
    "finding.deaths": "The player died in this round.",
    "finding.no_combat": "No kill or death observed.",
    "finding.enemy_first_visible": "First opponent visible after {time}.",
    "finding.likely_firefight": "{n} likely firefights.",
    "action.engagement_review": "Replay the contact and check position and cover.",
    "action.incoming_damage_review": "Replay where the damage came from.",
    "action.precontact_fire_review": "Replay the shots fired before contact.",
    "action.immediate_fire_review": "Replay the immediate shots after contact.",
    "action.delayed_fire_review": "Replay why the first shot came late.",
}


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("en", k, v) for k, v in EN.items()], "locale string, key string, template string")
