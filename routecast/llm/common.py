"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routecast.sources.shared import shared_dir, written

__all__ = ["SPACES", "SPACES_RE", "cut", "lower_ascii", "own_columns", "salted_join", "shared_dir", "table", "words_of", "written"]

#: The separators of `[^\x20\x09-\x0D]+`.
SPACES = " \t\n\x0b\x0c\r"
SPACES_RE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise a narrow frame in the shared checkpoint folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns of the caller cannot clash with working ones."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def salted_join(many: DataFrame, one: DataFrame, key: str, salts: int = 8) -> DataFrame:
    """Inner join on `key`, unique in the narrow frame `one`, with the rows of each key of `many` dealt over `salts` tasks."""
    copies = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return many.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in many.columns], F.monotonically_increasing_id()), F.lit(salts)).cast("int")).join(copies, [key, "_salt"]).drop("_salt")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; `lower` does the same on plain ASCII and is cheaper there."""
    upper, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, small))


def words_of(text: Column) -> Column:
    """Words `[^\x20\x09-\x0D]+` of a text; a null or blank text has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES_RE))
