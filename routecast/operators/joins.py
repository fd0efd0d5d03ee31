"""Joins that a few keys with most rows do not slow down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(many: DataFrame, few: DataFrame, key: str, salts: int = 8) -> DataFrame:
    """Inner join on `key`, the rows of each key of `many` dealt over `salts` tasks and those of the narrow `few` copied to each."""
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in many.columns]), F.lit(salts)).cast("int")
    return many.withColumn("_salt", salt).join(copies, [key, "_salt"]).drop("_salt")
