"""Digests of whole groups without a group in memory."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def member_digests(df: DataFrame, group: str, key: str, size: str, out: str) -> DataFrame:
    """(group, size, out): the rows of each group and the SHA-256 of the JSON list of its sorted keys, null keys left out.

    Rows are brought together by group and sorted by Spark, which spills; a task feeds them to the digest batch by batch and holds one
    state. SHA-256 reads its input in order, so a group passes one task, in constant memory.
    """
    rows = df.select(F.col(group), F.col(key).alias("_key")).repartition(group).sortWithinPartitions(group, "_key")
    element = F.when(F.col("_key").isNotNull(), F.regexp_extract(F.to_json(F.array("_key")), r"(?s)^\[(.*)\]$", 1))
    schema = df.select(group).withColumn(size, F.lit(0).cast("long")).withColumn(out, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, n, state, first = None, 0, hashlib.sha256(), True

        def row(kind: pa.DataType) -> pa.RecordBatch:
            done = state.copy()
            done.update(b"[]" if first else b"]")
            return pa.RecordBatch.from_arrays([pa.array([have], kind), pa.array([n], pa.int64()), pa.array([done.hexdigest()])], [group, size, out])

        for batch in batches:
            groups, elements = batch.column(0), batch.column(1).to_pylist()
            kind = groups.type
            for g, e in zip(groups.to_pylist(), elements):
                if n and g != have:
                    yield row(kind)
                    n, state, first = 0, hashlib.sha256(), True
                have, n = g, n + 1
                if e is not None:
                    state.update((("[" if first else ",") + e).encode())
                    first = False
        if n:
            yield row(kind)

    return rows.select(group, element.alias("_element")).mapInArrow(run, schema)
