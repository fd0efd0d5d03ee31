"""Queries of the streaming forms (T6-T8). Streams read the tables as files, end when all is read, and their results are read back.

Where several batches matter, the table arrives in parts: each is written and the stream is started again from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from routecast.functions.expr import item_key
from routecast.plans.views import log, over, read
from routecast.registry import query
from routecast.sources.shared import fresh
from routecast.streaming import monitor as S


ONE_BATCH = {"maxFilesPerTrigger": 2**31 - 1}  # else a table of more than 1000 files comes in batches, whose later rows the watermark may drop


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, in a part for each core: every part costs a second a batch, and on disk it may be large."""
    cores = max(8, spark.sparkContext.defaultParallelism)
    own = {"spark.sql.streaming.stateStore.providerClass": S.ROCKS, "spark.sql.shuffle.partitions": str(min(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The table as a file stream of one batch; the pattern matches its one file or folder, since a stream takes no single file."""
    return spark.readStream.schema(read(spark, d, name).schema).options(**ONE_BATCH).parquet(f"{d}/{name}.parque[t]")


def run_once(df: DataFrame, mode: str, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns the last row of each key (in update mode several batches may give one). State is kept on disk."""
    spark, folder = df.sparkSession, fresh(df.sparkSession, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    with _rocks(spark):
        df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    out = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_batch", T.IntegerType())])).parquet(f"{folder}/out/*")
    rest = [c for c in df.columns if c not in keys]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_batch", *(order or []))).alias("r")).select(*keys, "r.*")


@query("stream_trial_counts", "SELECT l_partkey AS question_id, count(*) FILTER (l_linestatus = 'O') AS correct_count, count(*) FILTER (l_returnflag = 'A') AS invalid_count, count(*) AS k FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem) GROUP BY 1")
def stream_trial_counts(spark: SparkSession, d: str) -> DataFrame:
    """The stream's counts equal those of the batch form; of repeated keys (nulls are values) the first row in the table's files counts."""
    folder, place = fresh(spark, "first"), F.struct("_metadata.file_path", "_metadata.row_index")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("l_orderkey", "l_linenumber")]
    t = _stream(spark, d, "lineitem").select(place.alias("place"), item_key(*parts).alias("key"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_partkey").alias("question_id"),
                                             (F.col("l_linestatus") == "O").alias("success"), (F.col("l_returnflag") == "A").alias("invalid"))
    _ended(S.write_first(t, folder), f"{folder}-state")
    once = spark.readStream.schema(t.drop("place").schema).options(**ONE_BATCH).parquet(f"{folder}/*")
    return run_once(S.trial_counts(once), "update", ["question_id"])


@query("failure_windows", over("log", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS \"end\", count(*) AS n, count(*) FILTER (error) AS errors, count(*) FILTER (error) / CAST(count(*) AS DOUBLE) AS share FROM log GROUP BY 1, 2"))
def failure_windows(spark: SparkSession, d: str) -> DataFrame:
    return S.failure_windows(log(spark, d), "1 day")


@query("sliding_failures", over("log", ", w AS (SELECT time_bucket(INTERVAL 12 HOURS, ts) - to_hours(12 * v) AS start, error FROM log, range(2) r(v)) SELECT start, start + INTERVAL 1 DAY AS \"end\", count(*) AS n, count(*) FILTER (error) AS errors, count(*) FILTER (error) / CAST(count(*) AS DOUBLE) AS share FROM w GROUP BY 1, 2"))
def sliding_failures(spark: SparkSession, d: str) -> DataFrame:
    return S.failure_windows(log(spark, d), "1 day", "12 hours")


@query("error_bursts", over("log", """, e AS (SELECT key, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS first FROM log WHERE error WINDOW w AS (PARTITION BY key ORDER BY ts)), s AS (SELECT key, ts, sum(first) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT key, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS errors FROM s GROUP BY key, s"""))
def error_bursts(spark: SparkSession, d: str) -> DataFrame:
    return S.error_bursts(log(spark, d), "6 hours")


PARTS = 4
# The share of the time from the first event to the last at which an event happened, in parts; every 20th event of the first part arrives with the last part.
_SPAN = "(SELECT min(ts) AS lo, max(ts) AS hi FROM log)"
_PART = f"least({PARTS - 1}, {PARTS} * (epoch_us(ts) - epoch_us(lo)) // greatest(1, epoch_us(hi) - epoch_us(lo)))"
_ON_TIME = f", p AS (SELECT *, {_PART} AS part FROM log, {_SPAN}), ok AS (SELECT * FROM p WHERE NOT (part = 0 AND event_id % 20 = 0))"


def _arrivals(spark: SparkSession, d: str, late: bool = True) -> DataFrame:
    """key, ts, event_id, error and the number of the part in which a row arrives: by time, but for the late ones; a last part ends all windows."""
    e = log(spark, d).select("key", F.col("ts").cast("timestamp").alias("ts"), "event_id", "error")
    span = e.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    e = e.crossJoin(F.broadcast(span))  # one row
    part = F.expr(f"least({PARTS - 1}, {PARTS} * (unix_micros(ts) - unix_micros(lo)) div greatest(1, unix_micros(hi) - unix_micros(lo)))")
    held_back = (part == 0) & (F.col("event_id") % 20 == 0) & F.lit(late)
    last = span.select(F.lit(-1).cast("long").alias("key"), (F.col("hi") + F.expr("interval 3650 days")).alias("ts"), F.lit(-1).cast("long").alias("event_id"), F.lit(True).alias("error"), F.lit(PARTS).cast("long").alias("part"))
    return e.select("key", "ts", "event_id", "error", F.when(held_back, PARTS - 1).otherwise(part).cast("long").alias("part")).unionByName(last)


def parts_of(rows: DataFrame, folder: str) -> Iterator[DataFrame]:
    """Writes one part after another under `folder` and yields the stream of what has arrived."""
    plain = rows.drop("part")
    for part in range(PARTS + 1):
        rows.where(F.col("part") == part).drop("part").write.parquet(f"{folder}/part-{part}")
        yield rows.sparkSession.readStream.schema(plain.schema).parquet(f"{folder}/*")


def _ended(writer: DataStreamWriter, folder: str) -> None:
    writer.option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination()


def _kept(stream: DataFrame, folder: str) -> DataStreamWriter:
    """A writer of each batch and its number under `folder`."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch-{number:09d}")

    return stream.writeStream.foreachBatch(keep)


def _back(spark: SparkSession, schema: T.StructType, folder: str) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("_batch", T.IntegerType())])).parquet(f"{folder}/*")


def run_parts(rows: DataFrame, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All rows that the stream `made` of `rows` appends as their parts arrive."""
    spark, folder = rows.sparkSession, fresh(rows.sparkSession, "stream")
    for stream in parts_of(rows, f"{folder}/in"):
        out = made(stream)
        _ended(_kept(out, f"{folder}/out").outputMode("append"), f"{folder}/state")
    return _back(spark, out.schema, f"{folder}/out").drop("_batch")


def run_error_runs(rows: DataFrame, threshold: int, idle_ms: int | None = None) -> DataFrame:
    """The last row of each key of T8 as parts of `rows` arrive: one stream reduces a part to runs, a second one keeps the runs of each key."""
    spark, folder = rows.sparkSession, fresh(rows.sparkSession, "runs")
    with _rocks(spark):
        for stream in parts_of(rows, f"{folder}/in"):
            _ended(S.write_runs(stream, f"{folder}/runs"), f"{folder}/state-1")
            out = S.error_runs(spark.readStream.schema(S.RUN_ROWS).parquet(f"{folder}/runs/*"), threshold, idle_ms)
            _ended(_kept(out, f"{folder}/out").outputMode("update"), f"{folder}/state-2")
    return _back(spark, out.schema, f"{folder}/out").groupBy("key").agg(F.max_by(F.struct("run", "longest", "alert"), "_batch").alias("r")).select("key", "r.*")


@query("stream_failure_windows", over("log", _ON_TIME + " SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", count(*) AS n, count(*) FILTER (error) AS errors, count(*) FILTER (error) / CAST(count(*) AS DOUBLE) AS share FROM ok GROUP BY 1, 2"))
def stream_failure_windows(spark: SparkSession, d: str) -> DataFrame:
    """T7 in five batches: exactly the late rows, whose windows the watermark has closed, are lost."""
    out = run_parts(_arrivals(spark, d), lambda e: S.failure_windows(e, "1 hour", delay="10 minutes"))
    span = log(spark, d).agg(F.max("ts").cast("timestamp").alias("hi"))
    out = out.crossJoin(F.broadcast(span)).where("start <= hi").drop("hi")  # one row
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("stream_error_bursts", over("log", _ON_TIME + """, e AS (SELECT key, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS first FROM ok WHERE error WINDOW w AS (PARTITION BY key ORDER BY ts)), s AS (SELECT key, ts, sum(first) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT key, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS errors FROM s GROUP BY key, s"""))
def stream_error_bursts(spark: SparkSession, d: str) -> DataFrame:
    """T7's session windows as a stream in five batches: bursts grow over batches, come out once when the watermark has closed them, and lose the late rows."""
    out = run_parts(_arrivals(spark, d), lambda e: S.error_bursts(e, "6 hours", delay="10 minutes")).where("key >= 0")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("stream_error_runs", over("log", """, r AS (SELECT key, error, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) - row_number() OVER (PARTITION BY key, error ORDER BY ts, event_id) AS g FROM log), n AS (SELECT key, g, count(*) AS n FROM r WHERE error GROUP BY 1, 2)
SELECT key, coalesce(max(n), 0) AS longest, coalesce(max(n), 0) >= 3 AS alert FROM (SELECT DISTINCT key FROM log) LEFT JOIN n USING (key) GROUP BY 1"""))
def stream_error_runs(spark: SparkSession, d: str) -> DataFrame:
    """T8 in parts by time."""
    return run_error_runs(_arrivals(spark, d, late=False).where("key >= 0"), 3).select("key", "longest", "alert")
