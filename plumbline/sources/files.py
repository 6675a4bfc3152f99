"""File sources and sinks: TSV, JSON arrays, nested JSON, source trees, CSV, resumable output."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import connectors
from .connectors import glob_regex  # noqa: F401


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master (one machine, as in tests) may go without; it gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="plumbline-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark)}/plumbline/{label}-{uuid.uuid4().hex}"


def read_tsv(spark: SparkSession, path: str, columns: list[str], missing: str | None = "") -> DataFrame:
    """Tab-separated with a header, no quoting, every cell text; blank lines go, missing cells are `missing`."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.csv(path, sep="\t", header=True, quote="", schema=schema, enforceSchema=False, mode="PERMISSIVE", ignoreTrailingWhiteSpace=True)
    return df if missing is None else df.na.fill(missing)


def write_tsv(df: DataFrame, path: str, clean: bool = False) -> None:
    """Fixed column order, null is an empty cell; `clean` turns tabs and newlines in cells into spaces."""
    cell = lambda c: F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"[\t\r\n]", " ") if clean else F.col(c).cast("string"), F.lit(""))
    df.select(*[cell(c).alias(c) for c in df.columns]).write.csv(path, sep="\t", header=True, quote="", emptyValue="")


def read_json_arrays(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A file, or a folder of files, that each hold one JSON array of records; anything else fails the read."""
    return spark.read.json(path, schema=schema, multiLine=True, mode="FAILFAST")


def read_keyed_findings(spark: SparkSession, path: str, finding: str) -> DataFrame:
    """Files that each hold one object {repo: [finding]} -> one row per finding."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.explode(F.from_json("value", f"map<string, array<struct<{finding}>>>")).alias("repo", "findings"))
    return parsed.select("repo", F.explode("findings").alias("f")).select("repo", "f.*")


def unify_findings(cli: DataFrame, trimmed: DataFrame) -> DataFrame:
    """Two input shapes, files -> detectors -> issues and a flat list, as one table of (file, rule, line)."""
    deep = cli.select(F.col("file"), F.explode("detectors").alias("d")).select("file", F.col("d.rule").alias("rule"), F.explode("d.issues").alias("line"))
    return deep.unionByName(trimmed.select("file", "rule", "line"))


def latest_file(df: DataFrame, pattern: str) -> DataFrame:
    """Only the rows of the file whose name sorts last; `df` is read from a folder."""
    named = df.withColumn("__file", F.input_file_name())
    names = named.select(F.regexp_extract("__file", pattern, 0).alias("__name"))
    last = names.agg(F.max("__name")).first()[0]
    return named.filter(F.regexp_extract("__file", pattern, 0) == F.lit(last)).drop("__file")


def source_tree(spark: SparkSession, path: str, extensions: str = "js,ts,py", skip: str = "node_modules,dist,.git,vendor", max_bytes: int = 1_000_000) -> DataFrame:
    """path (relative), length and text of all source files below a folder; folders of a skipped name are never opened."""
    connectors.register(spark)
    return spark.read.format("source_tree").options(extensions=extensions, skip=skip, maxbytes=max_bytes).load(path)


def glob_scan(spark: SparkSession, path: str, pattern: str, ignore: list[str] | None = None, max_bytes: int = 1_000_000) -> DataFrame:
    """path (relative), length and text of the files that match a glob and none of `ignore`; a folder that is ignored whole is never opened."""
    connectors.register(spark)
    return spark.read.format("source_tree").options(glob=pattern, ignore="\n".join(ignore or []), skip="", maxbytes=max_bytes).load(path)


def paged_service(spark: SparkSession, path: str, high: int, cap: int, page_size: int, **options) -> DataFrame:
    """Everything that a service with recorded answers holds, a task a range of sizes."""
    connectors.register(spark)
    return spark.read.format("paged_service").options(path=path, high=high, cap=cap, pagesize=page_size, **options).load()


def replayed_pages(responses: DataFrame, item: str) -> DataFrame:
    """Items of a paged service from its recorded responses (part, page, attempt, status, body): part, page, retries and the item.

    A page's body is that of its first good answer; refused and failed attempts (429 and 5xx) are retries.
    A part ends before its first page without a good answer, so what lies behind a gap is not reached.
    """
    good = F.col("status") == 200
    pages = responses.groupBy("part", "page").agg(
        F.min_by(F.when(good, F.col("body")), F.when(good, F.col("attempt"))).alias("body"), F.count_if(good).alias("n"), F.count_if((F.col("status") == 429) | (F.col("status") >= 500)).alias("retries")
    )
    answered = pages.filter("n > 0")
    reached = W.partitionBy("part").orderBy("page")
    run = answered.withColumn("__at", F.row_number().over(reached)).filter(F.col("__at") == F.col("page"))
    return run.select("part", "page", "retries", F.explode(F.from_json("body", f"array<{item}>")).alias("item"))


def local_or_remote(wanted: DataFrame, local: DataFrame, remote: DataFrame, key: str, value: str) -> DataFrame:
    """The local copy where there is one, else the remote."""
    j = wanted.join(local.withColumnRenamed(value, "__l"), key, "left").join(remote.withColumnRenamed(value, "__r"), key, "left")
    return j.withColumn(value, F.coalesce("__l", "__r")).drop("__l", "__r")


def resumable_scan(spark: SparkSession, path: str, out: str, progress: str, scan, schema: str = "value string", files_at_once: int = 100, **reader) -> DataFrame:
    """Scans the files of a folder batch by batch and keeps its progress, so that a scan that was stopped goes on with the files it had not finished.

    `scan` makes rows of a batch's files (columns value and path with the default text reader, a row a file). Which files
    a batch holds is logged in `progress` before it is scanned; its rows overwrite the folder of that batch in
    `out`, so a batch that is done twice counts once. New files are found by the next run. Returns all rows so far.
    """
    batches = spark.readStream.format(reader.pop("format", "text")).schema(schema).option("maxFilesPerTrigger", files_at_once).options(**({"wholetext": "true"} | reader)).load(path)

    def keep(df: DataFrame, number: int) -> None:
        scan(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    batches.withColumn("path", F.col("_metadata.file_path")).writeStream.foreachBatch(keep).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).drop("batch")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read back, so that rounds of a loop do not pile up in the plan."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_missing(df: DataFrame, path: str, key: str) -> int:
    """Append-and-resume: writes the rows whose key is not there yet and returns how many."""
    spark = df.sparkSession
    try:
        done = spark.read.schema(df.schema).parquet(path).select(key)
        df = df.join(done, key, "left_anti")
    except Exception as e:  # no output yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    n = df.count()
    df.write.mode("append").parquet(path)
    return n


def write_json_arrays(df: DataFrame, path: str) -> None:
    """Files that each are one JSON array, written record after record; a task holds a batch, never its file."""

    def run(batches):
        opened = False
        for batch in batches:
            rows = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([("," if opened or k else "[") + row for k, row in enumerate(rows)], pa.string())], names=["value"])
            opened |= bool(rows)
        yield pa.RecordBatch.from_arrays([pa.array(["]" if opened else "[]"])], names=["value"])

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(run, "value string").write.text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """All cells quoted, quotes doubled."""
    df.write.csv(path, header=True, quoteAll=True, escape='"')


def manifest(runs: DataFrame, status: Column, kinds: list[str]) -> DataFrame:
    """One row: how many runs, and how many of each status."""
    return runs.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(status == k).alias(k) for k in kinds])


def markdown_table(df: DataFrame, limit: int = 200) -> str:
    """A small result as Markdown, pipes escaped. Rows beyond `limit` are an error, never cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *rows]
    return "\n".join("| " + " | ".join(cell(v) for v in r) + " |" for r in lines)
