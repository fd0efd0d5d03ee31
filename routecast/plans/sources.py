"""Queries of sources and sinks (S1-S7, K1-K3, T3): given tables written to the shared folder in a form and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routecast.plans.views import over, read, trials
from routecast.registry import query
from routecast.sources import records as R
from routecast.sources.shared import fresh

LABEL = "doc_id long, quality int, toxic int"


@query("json_records", "SELECT doc_id, CAST(quality AS INT) AS quality, CAST(toxic AS INT) AS toxic, CAST(NULL AS VARCHAR) AS _corrupt_record FROM labels")
def json_records(spark: SparkSession, d: str) -> DataFrame:
    """Labels as JSON lines."""
    path = fresh(spark, "labels")
    R.write_records(read(spark, d, "labels").select("doc_id", "quality", "toxic"), path)
    return R.read_records(spark, path, LABEL)


LINES = """x AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'malformed' WHEN doc_id % 11 = 0 THEN 'blank' END AS fault, quality, toxic FROM labels)"""


def _lines(spark: SparkSession, d: str) -> str:
    """Label lines of which every seventh id is cut short and every eleventh is blank."""
    i, path = F.col("doc_id"), fresh(spark, "lines")
    line = F.to_json(F.struct("doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")))
    read(spark, d, "labels").select(F.when(i % 7 == 0, F.substring(line, 1, 12)).when(i % 11 == 0, "  ").otherwise(line).alias("value")).write.text(path)
    return path


@query("strict_lines", f"WITH {LINES} SELECT CASE WHEN fault IS NULL THEN doc_id END AS doc_id, CASE WHEN fault IS NULL THEN quality::INT END AS quality, CASE WHEN fault IS NULL THEN toxic::INT END AS toxic, fault FROM x")
def strict_lines(spark: SparkSession, d: str) -> DataFrame:
    """S2."""
    r = R.read_strict(spark, _lines(spark, d), LABEL)
    good = F.col("fault").isNull()
    return r.select(*[F.when(good, F.col(c)).alias(c) for c in ("doc_id", "quality", "toxic")], "fault")


@query("tolerant_lines", f"WITH {LINES} SELECT doc_id, quality::INT AS quality, toxic::INT AS toxic FROM x WHERE fault IS NULL")
def tolerant_lines(spark: SparkSession, d: str) -> DataFrame:
    """S3."""
    return R.read_tolerant(spark, _lines(spark, d), LABEL)


@query("latest_lines", "SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 AND doc_id % 7 > 0 THEN 1 - quality ELSE quality END AS INT) AS quality, CAST(toxic AS INT) AS toxic FROM labels")
def latest_lines(spark: SparkSession, d: str) -> DataFrame:
    """S3 with a later row for every third id, of which every seventh is cut short and does not count."""
    i, path = F.col("doc_id"), fresh(spark, "latest")
    l = read(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    line = F.to_json(F.struct("doc_id", "quality", "toxic"))
    first = l.select(F.lit(0).alias("version"), "doc_id", line.alias("value"))
    later = l.where(i % 3 == 0).withColumn("quality", 1 - F.col("quality")).select(F.lit(1).alias("version"), "doc_id", F.when(i % 7 == 0, F.substring(line, 1, 12)).otherwise(line).alias("value"))
    first.unionByName(later).orderBy("version", "doc_id").select("value").write.text(path)
    return R.read_latest(spark, path, LABEL, "doc_id")


@query("numbered_records", f"WITH {LINES}, o AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS line FROM x) SELECT line, fault FROM o WHERE fault = 'malformed'")
def numbered_records(spark: SparkSession, d: str) -> DataFrame:
    """Where the bad lines of one file, written in parts, are, counted from 1."""
    i, path = F.col("doc_id"), fresh(spark, "numbered")
    line = F.to_json(F.struct("doc_id", "quality", "toxic"))
    rows = read(spark, d, "labels").select("doc_id", F.when(i % 7 == 0, F.substring(line, 1, 12)).when(i % 11 == 0, "  ").otherwise(line).alias("value"))
    rows.orderBy(F.col("doc_id").asc_nulls_last()).select("value").write.text(path)
    return R.bad_lines(spark, path, LABEL, whole=True).select("line", "fault")


@query("one_object", "SELECT count(*) AS n, CAST(sum(toxic) AS BIGINT) AS toxic FROM labels")
def one_object(spark: SparkSession, d: str) -> DataFrame:
    """S4."""
    path = fresh(spark, "object")
    read(spark, d, "labels").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").cast("long").alias("toxic")).coalesce(1).write.json(path)
    return R.read_object(spark, path, "n long, toxic long")


@query("participant_files", """
WITH x AS (SELECT CASE WHEN c_custkey % 50 = 0 THEN 'P0' ELSE 'P' || c_nationkey END AS participant_id, CASE WHEN c_custkey % 40 = 3 THEN 3 ELSE c_custkey END AS prompt_id, c_mktsegment AS segment, 'P' || c_nationkey AS file_id FROM customer)
SELECT *, CASE WHEN participant_id <> file_id THEN 'participant' WHEN count(*) OVER (PARTITION BY participant_id, prompt_id) > 1 THEN 'repeated' END AS fault FROM x""")
def participant_files(spark: SparkSession, d: str) -> DataFrame:
    """CSV with a header and all fields quoted, a file for each nation as the participant, named by its folder; some rows name another, some prompts come twice."""
    path, k, nation = fresh(spark, "participants"), F.col("c_custkey"), F.concat(F.lit("P"), F.col("c_nationkey").cast("string"))
    c = read(spark, d, "customer").select(F.when(k % 50 == 0, "P0").otherwise(nation).alias("participant_id"), F.when(k % 40 == 3, F.lit(3).cast("long")).otherwise(k).alias("prompt_id"), F.col("c_mktsegment").alias("segment"), nation.alias("folder"))
    R.write_csv(c, path, per="folder", quote_all=True)
    rows = R.read_participants(spark, f"{path}/*/", "participant_id string, prompt_id long, segment string", name=r"folder=([^/]+)/")
    return R.participant_faults(rows.select("participant_id", "prompt_id", "segment", "file_id"))


@query("scenario_file", "SELECT p_brand AS policy, CASE WHEN p_size % 5 > 0 THEN p_size END AS local_retries, p_size AS attempts, CASE WHEN p_size % 5 = 0 AND p_size % 2 = 1 THEN 'local_retries' END AS fault FROM part")
def scenario_file(spark: SparkSession, d: str) -> DataFrame:
    """`local_retries` may be blank only where `attempts` is even."""
    path = fresh(spark, "scenarios")
    p = read(spark, d, "part").select(F.col("p_brand").alias("policy"), F.when(F.col("p_size") % 5 > 0, F.col("p_size")).alias("local_retries"), F.col("p_size").alias("attempts"))
    R.write_csv(p, path)
    return R.scenario_faults(R.read_scenarios(spark, path, "policy string, local_retries int, attempts int"), may_be_blank=F.col("attempts") % 2 == 0)


@query("repeat_folders", over("trials", "SELECT question_id, CAST(rep - 1 AS INT) AS rep, output_tokens FROM trials"))
def repeat_folders(spark: SparkSession, d: str) -> DataFrame:
    """Answers below `repN` folders, one for each of the at most seven repeats."""
    path, t = fresh(spark, "repeats"), trials(spark, d).select("question_id", "rep", "output_tokens")
    for n in range(1, 8):
        R.write_records(t.where(F.col("rep") == n).select("question_id", "output_tokens"), f"{path}/rep{n - 1}")
    return R.read_repeats(spark, path, "question_id long, output_tokens int").select("question_id", "rep", "output_tokens")


@query("repeats_contiguous", over("trials", "SELECT count(DISTINCT rep) AS reps, max(rep) = count(DISTINCT rep) AS contiguous FROM trials"))
def repeats_contiguous(spark: SparkSession, d: str) -> DataFrame:
    return R.contiguous(trials(spark, d).select((F.col("rep") - 1).alias("rep")))


@query("report_sections", "SELECT 'lang' AS section, lang AS name, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2")
def report_sections(spark: SparkSession, d: str) -> DataFrame:
    """K2: a report of two sections."""
    path, t = fresh(spark, "report"), read(spark, d, "documents")
    counts = {c: t.groupBy(F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n")) for c in ("lang", "source")}
    R.write_report(counts, path)
    parts = [spark.read.schema("name string, n long").json(f"{path}/{c}").select(F.lit(c).alias("section"), "name", "n") for c in counts]
    return parts[0].unionByName(parts[1])


@query("file_digests", "WITH f AS (SELECT r_name, string_agg(n_name || chr(10), '' ORDER BY n_nationkey) AS c FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1) SELECT CAST(strlen(c) AS BIGINT) AS bytes, sha256(c) AS sha256 FROM f")
def file_digests(spark: SparkSession, d: str) -> DataFrame:
    """One text file a region."""
    path = fresh(spark, "regions")
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    n.join(r, n.n_regionkey == r.r_regionkey).repartition("r_name").sortWithinPartitions("r_name", "n_nationkey").select(F.col("n_name").alias("value"), "r_name").write.partitionBy("r_name").text(path)
    return R.digests(spark, f"{path}/*/*.txt").select("bytes", "sha256")


@query("pin_faults", "SELECT r_name AS name, CASE r_regionkey % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'unpinned' ELSE 'changed' END AS fault FROM region WHERE r_regionkey % 4 < 3")
def pin_faults(spark: SparkSession, d: str) -> DataFrame:
    """Digests of files, one of nation names a region, against pinned ones, with a file missing, one unpinned and one changed."""
    k, path = F.col("r_regionkey"), fresh(spark, "pinned")
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    rows = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("value"), "n_nationkey", "r_name", k)
    rows.where(k % 4 != 0).repartition("r_name").sortWithinPartitions("r_name", "n_nationkey").select("value", "r_name").write.partitionBy("r_name").text(path)
    found = R.digests(spark, f"{path}/*/*.txt", name=r"r_name=([^/]+)/")
    names = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "value"))), lambda x: F.concat(x.value, F.lit("\n")))  # a region's few nations
    pins = rows.where(k % 4 != 1).groupBy(F.col("r_name").alias("name"), k).agg(F.array_join(names, "").alias("c"))
    return R.pin_faults(found.select("name", "sha256"), pins.select("name", F.sha2(F.when(k % 4 == 2, F.concat("c", F.lit("more"))).otherwise(F.col("c")), 256).alias("sha256")))
