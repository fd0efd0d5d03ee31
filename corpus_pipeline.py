"""Corpus pipeline: five stages over `documents`, each one of the operators of `routecast.llm`.

Every stage takes (spark, docs, sf_dir) and works on all rows the stage before kept. All but the last return the
columns of `documents`; further columns of the input are left out.

* language: documents whose language is `und` (null text, no letters) go.
* near_dedup: one document of each near-duplicate class stays, that with the smallest doc_id (of several texts under that id
  the one with the least digest); repeated rows become one. Rows without doc_id are copies of nothing and all stay.
* repeats: bytes covered by a 50-byte string that an earlier document has are cut out of the text; rows stay.
* secrets: found secrets are replaced by a mark in the text; rows stay.
* packing: pieces of 1024-token windows, one row each (see `routecast.llm.packing.SCHEMA`).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routecast.llm import language as _language
from routecast.llm import packing as _packing
from routecast.llm import secrets as _secrets
from routecast.llm import simhash as _simhash
from routecast.llm import suffix as _suffix
from routecast.llm.common import cut, own_columns, shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = own_columns(docs, *COLUMNS)
    train = docs.where(_language.fold(F.col("doc_id"), 4) != 2)
    found = _language.identify(docs, _language.learn(train), COLUMNS)
    return found.where("lang_pred <> 'und'").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = own_columns(docs, *COLUMNS).withColumn("_digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    rows = _simhash.classified(docs, keep=("_digest",)).where("doc_id is not null")
    stay = cut(rows.groupBy("root").agg(F.min(F.struct("doc_id", "_digest")).alias("s")).select("s.doc_id", "s._digest"))
    named = docs.where("doc_id is not null").join(stay, ["doc_id", "_digest"], "left_semi").dropDuplicates(["doc_id", "_digest"])
    return named.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _suffix.strip(own_columns(docs, *COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _secrets.redact(own_columns(docs, *COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _packing.op3_packing(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("repeats", repeats), ("secrets", secrets), ("packing", packing)]

ORACLE_SQL = None  # fingerprints, token ids and learned languages are beyond SQL; tests/llm has a brute-force version


def _dropped(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces; every stage but the last is written to the shared folder and read again, and dropped once the next one is written."""
    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _dropped(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
