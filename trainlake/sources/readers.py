"""Reading tables, landed JSON files, snapshots and logs."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trainlake import schemas as S
from trainlake.functions.dates import day_literal, parse_iso
from trainlake.functions.text import strip


# ---- Names of folders ---------------------------------------------------------------------------
VERSION, BATCH, BASE = "version=", "batch_id=", "base_id="

# What orders repeated rows: the landing, the file, and within it the part that one task reads and the line there.
ORIGIN = ["landed_at", "file", "block"]
ARRIVAL = [*ORIGIN, "line"]

# The column that holds the text of a landed line that is not (or not wholly) what its schema says.
CORRUPT = "corrupt"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop_path)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table, or no rows if there is none. Any other problem is an error as usual."""
    return read_table(spark, path, schema) if path_exists(spark, path) else spark.createDataFrame([], schema)


def newest_version(spark: SparkSession, path: str) -> str | None:
    """The folder of the newest complete version of a table, if it is kept in versions."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(folder):
        return None
    names = [s.getPath().getName() for s in files.listStatus(folder) if s.isDirectory()]
    numbers = sorted((int(n.removeprefix(VERSION)) for n in names if n.startswith(VERSION)), reverse=True)
    return next((f"{path}/{VERSION}{n}" for n in numbers if path_exists(spark, f"{path}/{VERSION}{n}/_SUCCESS")), None)


def read_version(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The newest version of a table (with its folder columns), or no rows."""
    folder = newest_version(spark, path)
    return read_table(spark, folder, schema) if folder else spark.createDataFrame([], schema)


def month_range(first: date | str, last: date | str) -> Column:
    """Restricts a table in month folders to those that hold a range of dates."""
    return F.col("month").between(str(first)[:7], str(last)[:7])


def read_raw_workouts(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages (one JSON object with a ``data`` list per line). A page without the list has no rows."""
    pages = spark.read.schema(S.RAW_WORKOUT_PAGE).json(path)
    return pages.select(F.inline("data"))


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def corrupt_kept(reader, schema: T.StructType):
    """A reader (batch or stream) of JSON lines that keeps the text of those it cannot read in ``CORRUPT``."""
    return reader.schema(_with_corrupt(schema)).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)


def read_lines(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """Landed JSON lines of the given files with ``ORIGIN`` and ``CORRUPT``; no files, no rows."""
    if not paths:
        origin = T.StructType([T.StructField(n, t) for n, t in zip(ORIGIN, (T.TimestampType(), T.StringType(), T.LongType()), strict=True)])
        return spark.createDataFrame([], T.StructType([*origin.fields, *_with_corrupt(schema).fields]))
    exact = [re.sub(r"([\[\]{}*?\\])", r"\\\1", path) for path in paths]
    return corrupt_kept(spark.read, schema).json(exact).select(*_origin(), *schema.fieldNames(), CORRUPT)


def ordered_workouts(pages: DataFrame) -> DataFrame:
    """Workouts of raw pages with the file and block they came in (see ``numbered``). Where the pages have ``CORRUPT``, every
    line with such a text gives one row more, which holds the text and no workout."""
    origin = ORIGIN if "file" in pages.columns else _origin()
    if CORRUPT not in pages.columns:
        return pages.select(*origin, F.explode("data").alias("w")).select(*ORIGIN, "w.*")
    of_page = F.transform("data", lambda w: F.struct(F.lit(None).cast("string").alias(CORRUPT), w.alias("w")))
    text = F.struct(F.col(CORRUPT), F.lit(None).cast(S.RAW_WORKOUT).alias("w"))
    entries = F.concat(F.coalesce(of_page, F.array()), F.when(F.col(CORRUPT).isNotNull(), F.array(text)).otherwise(F.array()))
    return pages.select(*origin, F.inline(entries)).select(*ORIGIN, CORRUPT, "w.*")


def _origin() -> list[Column]:
    names = {"landed_at": "file_modification_time", "file": "file_path", "block": "file_block_start"}
    return [F.col(f"_metadata.{field}").alias(name) for name, field in names.items()]


def landed_files(spark: SparkSession, path: str) -> DataFrame:
    """The files of a landing folder: file, modified, size. Their content is not read."""
    found = spark.read.format("binaryFile").load(path)
    return found.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def numbered(rows: DataFrame) -> DataFrame:
    """Add ``line``, so that ``ARRIVAL`` orders rows as they were landed. A block is read by one task from its begin to
    its end, so the number follows the lines and the places within them."""
    return rows.withColumn("line", F.monotonically_increasing_id())


def read_raw_recovery(spark: SparkSession, path: str) -> DataFrame:
    """One line per athlete and day with up to six documents as JSON text."""
    return spark.read.schema(S.RAW_RECOVERY).json(path)


def ordered_recovery(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The same of the given files with ``ARRIVAL`` and ``CORRUPT``."""
    return numbered(read_lines(spark, paths, S.RAW_RECOVERY))


def read_snapshot(
    spark: SparkSession, path: str, schema: T.StructType, one_object_per_file: bool = False
) -> DataFrame:
    """Snapshot objects (of the newest version), one per line or one per file; a malformed one gives a row without values, an absent
    file no rows."""
    path = newest_version(spark, path) or path
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    with_reject = T.StructType(schema.fields + [T.StructField("_malformed", T.StringType())])
    reader = spark.read.schema(with_reject).option("mode", "PERMISSIVE")
    snapshots = reader.option("columnNameOfCorruptRecord", "_malformed").json(path, multiLine=one_object_per_file)
    return snapshots.drop("_malformed")


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank and malformed ones are skipped."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def dated_exclusions(raw: DataFrame) -> DataFrame:
    """Raw log records with their time parsed; NULL where it cannot be read."""
    return raw.withColumn("timestamp", parse_iso(F.col("timestamp")))


def read_exclusion_lines(spark: SparkSession, path: str) -> DataFrame:
    """An exclusion log kept as JSON lines."""
    return dated_exclusions(read_log(spark, path, S.RAW_EXCLUSION))


def latest_briefs(briefs: DataFrame, as_of: date | str) -> DataFrame:
    """Per athlete the brief of the day, else the newest before it."""
    return (
        briefs.where(F.col("brief_date") <= day_literal(as_of))
        .groupBy("athlete_id")
        .agg(
            F.max("brief_date").alias("brief_date"),
            F.max_by(strip(F.col("brief_text")), "brief_date").alias("brief_text"),
        )
    )
