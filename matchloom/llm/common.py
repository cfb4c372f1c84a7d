"""Helpers of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from matchloom.operators.blocks import durable, durable_folder

__all__ = ["durable", "pick", "position", "saved", "surely", "table"]

SPACE = r"[^\x20\x09-\x0D]+"


def position(df: DataFrame, name: str) -> int:
    """Place of a column: the exact name first, else the only one that differs in case."""
    if name in df.columns:
        return df.columns.index(name)
    near = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(near) != 1:
        raise ValueError(f"the input has no column {name}: {df.columns}")
    return near[0]


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever other columns the table has and however those are spelled."""
    at = [position(df, n) for n in names]
    plain = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"_{i}").alias(n) for i, n in zip(at, names)))


def surely(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The whole table under column names that can't clash, and the new name of one of them."""
    i = position(df, name)
    return df.toDF(*(f"_{k}" for k in range(len(df.columns)))), f"_{i}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back: column pruning, and no replay after a lost executor."""
    spark = df.sparkSession
    path = f"{durable_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
