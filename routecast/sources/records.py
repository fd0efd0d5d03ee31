"""Reading and writing records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def _with_corrupt(schema: T.StructType | str) -> T.StructType:
    s = T.StructType.fromDDL(schema) if isinstance(schema, str) else T.StructType(list(schema.fields))
    return s if CORRUPT in s.names else s.add(CORRUPT, "string")


def read_records(spark: SparkSession, path: str, schema: T.StructType | str, array: bool | None = None) -> DataFrame:
    """JSON lines, or one JSON array (`array`, by default for `.json` paths); bad rows keep their text in `_corrupt_record`."""
    array = path.endswith(".json") if array is None else array
    return spark.read.schema(_with_corrupt(schema)).option("mode", "PERMISSIVE").option("multiLine", array).option("columnNameOfCorruptRecord", CORRUPT).json(path)


def read_strict(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with `fault` (blank, malformed or null) for each line."""
    lines = spark.read.text(path)
    row = F.from_json("value", _with_corrupt(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    out = lines.select("value", row.alias("r"))
    fault = F.when(F.trim("value") == "", "blank").when(F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull(), "malformed")
    return out.select("r.*", fault.alias("fault")).drop(CORRUPT)


def bad_lines(spark: SparkSession, path: str, schema: T.StructType | str, whole: bool = False) -> DataFrame:
    """(file, line, value, fault) of the lines of text files that do not parse, counted from 1 in each file.

    With `whole` the files are parts of one, in the order of their names, and lines are counted on from part to part. A line's place is the number of lines of the splits before it and its own in the split; the counts of splits are the only thing summed in order.
    """
    row = F.from_json("value", _with_corrupt(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    m = F.monotonically_increasing_id()
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), m.alias("_id"), "value", row.alias("r"))
    sizes = lines.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first"))
    places = Window.orderBy("file", "split") if whole else Window.partitionBy("file").orderBy("split")  # a row a split
    before = F.coalesce(F.sum("n").over(places.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bad = lines.where((F.trim("value") != "") & (F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull()))
    found = bad.join(sizes.select("file", "split", "first", before.alias("before")), ["file", "split"])
    return found.select("file", (F.col("before") + F.col("_id") - F.col("first") + 1).alias("line"), "value", F.lit("malformed").alias("fault"))


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """S3: JSON lines without the lines that do not parse."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_latest(spark: SparkSession, path: str, schema: T.StructType | str, key: str) -> DataFrame:
    """S3: of the JSON lines that parse, the last one of each key, in the order of files by name and lines in them; lines without a key are left out."""
    row = F.from_json("value", _with_corrupt(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = spark.read.text(path).select(place.alias("place"), row.alias("r")).where(f"r is not null and r.{CORRUPT} is null and r.{key} is not null")
    last = lines.groupBy(F.col(f"r.{key}").alias("_key")).agg(F.max_by("r", "place").alias("r"))
    return last.select("r.*").drop(CORRUPT)


def read_object(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A file that holds exactly one JSON object."""
    df = spark.read.schema(_with_corrupt(schema)).option("multiLine", True).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    rows = df.limit(2).collect()
    if len(rows) != 1 or rows[0][CORRUPT] is not None:
        raise ValueError(f"{path} does not hold one JSON object")
    return df.drop(CORRUPT)


def read_participants(spark: SparkSession, path: str, schema: T.StructType | str, name: str = r"([^/]+)\.csv$") -> DataFrame:
    """CSV files with an exact header, led by a byte order mark or not; `file_id` is taken from each file's path."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("encoding", "UTF-8").csv(path)
    return df.withColumn("file_id", F.regexp_extract(F.url_decode("_metadata.file_path"), name, 1))


def participant_faults(df: DataFrame, participant: str = "participant_id", prompt: str = "prompt_id") -> DataFrame:
    """The rows with `fault`: participant (not the one that the file is named after) or repeated (a prompt that the participant has twice)."""
    again = df.groupBy(participant, prompt).agg(F.count(F.lit(1)).alias("_n"))
    fault = F.when(~F.col(participant).eqNullSafe(F.col("file_id")), "participant").when(F.col("_n") > 1, "repeated")
    return df.join(again, [participant, prompt]).select(*df.columns, fault.alias("fault"))


def read_scenarios(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Scenario CSV with an exact header; ragged or badly typed rows keep their text in `_corrupt_record`."""
    return spark.read.schema(_with_corrupt(schema)).option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", CORRUPT).csv(path)


def scenario_faults(df: DataFrame, may_be_blank: Column, column: str = "local_retries") -> DataFrame:
    """Rows with `fault`: row (ragged or badly typed) or the column's name where it is blank and must not be; an empty table is an error."""
    if df.isEmpty():
        raise ValueError("no scenario rows")
    fault = F.when(F.col(CORRUPT).isNotNull(), "row").when(F.col(column).isNull() & ~may_be_blank, column)
    return df.select(*[c for c in df.columns if c != CORRUPT], fault.alias("fault"))


def read_repeats(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines below `repN` folders, with `rep` from the path."""
    df = spark.read.schema(schema).option("recursiveFileLookup", True).json(path)
    return df.withColumn("rep", F.regexp_extract(F.col("_metadata.file_path"), r"/rep(\d+)/", 1).try_cast("int"))


def contiguous(df: DataFrame, rep: str = "rep") -> DataFrame:
    """One row (reps, contiguous): repeats run from 0 without a gap."""
    return df.agg(F.count_distinct(rep).alias("reps"), (F.coalesce(F.max(rep) + 1, F.lit(0)) == F.count_distinct(rep)).alias("contiguous"))


def nested_answers(df: DataFrame) -> DataFrame:
    """Identity, first response, `[invalid]` flag and 0/1 score of nested evaluation rows (doc, resps, filtered_resps, exact_match).

    `resps` is an array of arrays or of texts as JSON; the first text counts. A score other than 0 or 1 is null.
    """
    first = lambda c: F.coalesce(F.get(F.get(F.from_json(c, "array<array<string>>"), F.lit(0)), F.lit(0)), F.get(F.from_json(c, "array<string>"), F.lit(0)))
    return df.select("doc.*", first(F.col("resps")).alias("response"), (first(F.col("filtered_resps")) == "[invalid]").alias("invalid"),
                     F.when(F.col("exact_match").isin(0.0, 1.0), F.col("exact_match") == 1.0).alias("success"))


def answer_text(options: Column, index: Column) -> Column:
    """The option at a 0-based index, null if there is none."""
    return F.get(options, index)


def write_records(df: DataFrame, path: str, form: str = "json") -> None:
    """K1: fails if the target exists; the commit protocol publishes all files or none."""
    df.write.mode("errorifexists").format(form).save(path)


def finite(df: DataFrame) -> DataFrame:
    """The same rows; a NaN or infinity in a float column ends the job that reads them with an error."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return df.withColumns({c: F.when(bad(F.col(c)), F.raise_error(F.lit(f"{c} is not a finite number")).cast("double")).otherwise(F.col(c)) for c in floats})


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    """K2: one folder per report section, keys sorted, nothing overwritten; NaN and infinity are errors."""
    for name, df in sorted(sections.items()):
        finite(df).select(*sorted(df.columns)).write.mode("errorifexists").option("ignoreNullFields", False).json(f"{path}/{name}")


def write_csv(df: DataFrame, path: str, per: str | None = None, quote_all: bool = False) -> None:
    """K3: CSV with a header; `per` gives a folder for each of its values, rows of one value being written together."""
    out = df.repartition(per) if per else df
    writer = out.write.mode("errorifexists").option("header", True).option("quoteAll", quote_all)
    (writer.partitionBy(per) if per else writer).csv(path)


def digests(spark: SparkSession, path: str, name: str = r"([^/]+)$") -> DataFrame:
    """(name, bytes, sha256) of whole files; the name is what `name` finds in a path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", name, 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def pin_faults(found: DataFrame, pins: DataFrame) -> DataFrame:
    """(name, fault) of files that are missing, unpinned or changed against `pins` (name, sha256)."""
    p = pins.select("name", F.col("sha256").alias("pinned"))
    fault = F.when(F.col("sha256").isNull(), "missing").when(F.col("pinned").isNull(), "unpinned").when(F.col("sha256") != F.col("pinned"), "changed")
    return found.join(p, "name", "full_outer").select("name", fault.alias("fault")).where("fault is not null")
