"""Writing tables, logs and snapshots.

A table that is replaced as a whole is kept in versions: each is a folder of its own and counts once Spark's committer
has marked it complete, so a failed write leaves the one before in place. A keyed table is a log of numbered batches;
older ones are folded into a base.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trainlake import schemas as S
from trainlake.functions.dates import day_literal, time_literal
from trainlake.operators import quality, quarantine
from trainlake.operators.upsert import upsert
from trainlake.session import materialise, temporary_tables
from trainlake.sources.readers import BASE, BATCH, VERSION, path_exists, read_snapshot

# Batches beside the base before they are folded into it.
BATCHES_PER_BASE = 24

# Folders by a hash of the key, for tables that are kept in buckets.
BUCKET, BUCKETS = "bucket", 32


def append_tips(tips: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Add complete note rows (see ``notes.new_tips``) to the log, as a batch of this or the next number."""
    checked = quality.assert_not_null(tips, ["tip_id", "created_at", "author", "tip_text"])
    write_batch(checked, path, next_batch(tips.sparkSession, path) if batch_id is None else batch_id)


# ---- Tables in versions -------------------------------------------------------------------------
def _numbered(spark: SparkSession, path: str, prefix: str) -> list[int]:
    if not path_exists(spark, path):
        return []
    return sorted(int(f.removeprefix(prefix)) for f in _folders(spark, path) if f.startswith(prefix))


def _finished(spark: SparkSession, folder: str) -> bool:
    return path_exists(spark, f"{folder}/_SUCCESS")


def write_version(rows: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = (), **options: str) -> None:
    """The rows as the newest version of a table. The version before is kept for those who still read it."""
    spark = rows.sparkSession
    numbers = _numbered(spark, path, VERSION)
    finished = [n for n in numbers if _finished(spark, f"{path}/{VERSION}{n}")]
    folder = f"{path}/{VERSION}{max(numbers, default=-1) + 1}"
    rows.write.format(kind).options(**options).partitionBy(*partition_by).save(folder)
    for number in numbers:
        if number not in finished[-1:]:
            _delete(spark, f"{path}/{VERSION}{number}")


def rebuild_metrics(metrics: DataFrame, path: str) -> None:
    """Replace the derived table. Its folders are months: ``readers.month_range`` prunes them."""
    dated = metrics.withColumn("month", F.date_format("workout_date", "yyyy-MM"))
    write_version(balanced(dated, "month"), path, partition_by=("month",))


def balanced(rows: DataFrame, column: str) -> DataFrame:
    """Rows brought together by the partition column in pieces of even size: no task writes to every
    folder, and a large folder is still written by many tasks."""
    return rows.hint("rebalance", column)


def append_exclusions(records: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Add checked records by day. With a number, repeating the batch replaces just its own records."""
    checked = quarantine.with_event_date(quarantine.checked(records))
    if batch_id is None:
        balanced(checked, "event_date").write.mode("append").partitionBy("event_date").parquet(path)
        return
    numbered = balanced(checked.withColumn("batch_id", F.lit(int(batch_id))), "event_date").write.mode("overwrite")
    numbered.option("partitionOverwriteMode", "dynamic").partitionBy("event_date", "batch_id").parquet(path)


def prune_exclusions(spark: SparkSession, path: str, as_of: datetime | str, days: int = S.RETENTION_DAYS) -> None:
    """Apply the retention period to the stored log.

    Whole days before the limit are removed as folders. Only the one day the limit falls in is rewritten:
    its remaining rows are first written elsewhere, so the log is never read while being replaced.
    Records without a readable time are in no day folder and stay.
    """
    if not path_exists(spark, path):
        return
    with temporary_tables(spark):
        _prune(spark, path, datetime.fromisoformat(str(as_of)) - timedelta(days=days), as_of, days)


def _prune(spark: SparkSession, path: str, limit: datetime, as_of: datetime | str, days: int) -> None:
    day = str(limit.date())
    for folder in _folders(spark, path):
        of_day = folder.removeprefix("event_date=")
        if folder.startswith("event_date=") and not of_day.startswith("__") and of_day < day:
            _delete(spark, f"{path}/{folder}")
    if f"event_date={day}" not in _folders(spark, path):
        return
    log = spark.read.parquet(path)
    boundary = log.where(F.col("event_date") == day_literal(day))
    if not boundary.where(F.col("timestamp") < time_literal(limit)).take(1):
        return
    folders = [c for c in ("event_date", "batch_id") if c in log.columns]
    remaining = materialise(quarantine.retained(boundary, as_of, days), "retained")
    occupied = {"/".join(f"{c}={row[c]}" for c in folders) for row in remaining.select(*folders).distinct().collect()}
    if occupied:
        remaining.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)
    leaves = [f"event_date={day}"]
    if "batch_id" in folders:
        leaves = [f"event_date={day}/{f}" for f in _folders(spark, f"{path}/event_date={day}")]
    for leaf in leaves:
        if leaf not in occupied:
            _delete(spark, f"{path}/{leaf}")


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _folders(spark: SparkSession, path: str) -> list[str]:
    folder, files = _file_system(spark, path)
    return [s.getPath().getName() for s in files.listStatus(folder) if s.isDirectory()]


def _delete(spark: SparkSession, path: str) -> None:
    folder, files = _file_system(spark, path)
    files.delete(folder, True)


def write_snapshot(rows: DataFrame, path: str, keys: tuple[str, ...] = ()) -> None:
    """Nested rows as JSON, empty fields included, as the newest version. With ``keys``, rows of other keys stay."""
    if keys:
        stored = read_snapshot(rows.sparkSession, path, rows.schema)
        rows = rows.unionByName(stored.join(rows.select(*keys), list(keys), "left_anti").select(*rows.columns))
    write_version(rows, path, "json", ignoreNullFields="false")


def weekly_snapshot(weeks: DataFrame, plans: DataFrame, now: datetime | str, model: str) -> DataFrame:
    """``weeks`` (one summary per athlete and week) beside the week before and the plan made for the week
    (athlete_id, week_start, insight, next_week)."""
    figures = F.struct(*[c for c in weeks.columns if c not in ("athlete_id", "week_start")])
    by_week = Window.partitionBy("athlete_id").orderBy("week_start")
    is_next = F.lag("week_start").over(by_week) == F.date_sub("week_start", 7)
    paired = weeks.select(
        "athlete_id",
        "week_start",
        figures.alias("this_week"),
        F.when(is_next, F.lag(figures).over(by_week)).alias("prev_week"),
    )
    return paired.join(plans, ["athlete_id", "week_start"], "left").select(
        "athlete_id",
        time_literal(now).alias("generated_at"),
        "week_start",
        F.date_add("week_start", 6).alias("week_end"),
        "this_week",
        "prev_week",
        F.coalesce("insight", F.lit("")).alias("insight"),
        F.col("next_week").alias("next_week_plan"),
        F.lit(model).alias("model"),
    )


def coaching_output(
    summaries: DataFrame, answers: DataFrame, recovery: DataFrame, now: datetime | str, model: str
) -> DataFrame:
    """Summary, generated text and newest recovery signals of each athlete as one nested row."""
    signals = [c for c in recovery.columns if c != "athlete_id"]
    parts = [c for c in summaries.columns if c != "athlete_id"]
    return (
        summaries.select("athlete_id", F.struct(*parts).alias("summary"))
        .join(answers.select("athlete_id", "coaching"), "athlete_id", "left")
        .join(recovery.select("athlete_id", F.struct(*signals).alias("recovery")), "athlete_id", "left")
        .withColumn("generated_at", time_literal(now))
        .withColumn("model", F.lit(model))
    )


def write_briefs(briefs: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Keep briefs by athlete and date: of several for the same day the last written counts (see ``stored_briefs``)."""
    write_batch(briefs, path, next_batch(briefs.sparkSession, path) if batch_id is None else batch_id)


def stored_briefs(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], S.BRIEFS)
    return current_rows(spark, path, ["athlete_id", "brief_date"]).select(*S.BRIEFS.fieldNames())


# ---- Keyed tables as batch logs -----------------------------------------------------------------
def write_batch(rows: DataFrame, path: str, batch_id: int, bucket_by: str | None = None, buckets: int = BUCKETS) -> None:
    """Store the rows of one batch under its number. Repeating a batch replaces just that batch.

    With ``bucket_by`` the rows are in folders by a hash of that column, so that a read of a few keys (``touched_buckets``)
    opens the folders of these keys only. A table keeps its number of buckets."""
    if bucket_by is None:
        rows.write.mode("overwrite").parquet(f"{path}/{BATCH}{int(batch_id)}")
        return
    _same_buckets(rows.sparkSession, path, buckets)
    _in_buckets(rows.withColumn(BUCKET, bucket_of(F.col(bucket_by), buckets)), f"{path}/{BATCH}{int(batch_id)}")


def _in_buckets(rows: DataFrame, folder: str) -> None:
    balanced(rows, BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(folder)


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    """The folder of a key, with the number of all folders in its name."""
    return F.concat(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("string"), F.lit(f"of{buckets}"))


def touched_buckets(spark: SparkSession, path: str, batch_id: int) -> list[str]:
    """The buckets that a batch wrote to, from the names of its folders."""
    folder = f"{path}/{BATCH}{int(batch_id)}"
    return sorted(f.removeprefix(f"{BUCKET}=") for f in _folders(spark, folder) if f.startswith(f"{BUCKET}="))


def _same_buckets(spark: SparkSession, path: str, buckets: int) -> None:
    if not path_exists(spark, path):
        return
    for part in [f for f in _folders(spark, path) if f.startswith((BASE, BATCH))][:1]:
        names = [f for f in _folders(spark, f"{path}/{part}") if f.startswith(f"{BUCKET}=")]
        if any(not f.endswith(f"of{buckets}") for f in names):
            raise ValueError(f"{path} is kept in another number of buckets than {buckets}")


def _read(spark: SparkSession, path: str, folders: list[str], buckets: list[str] | None) -> DataFrame:
    """Rows of some folders of a table, or of some of their buckets. The filter prunes folders, the column is not kept."""
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/{f}" for f in folders])
    if BUCKET not in rows.columns:
        return rows
    return (rows if buckets is None else rows.where(F.col(BUCKET).isin(buckets))).drop(BUCKET)


def _parts(spark: SparkSession, path: str) -> tuple[int | None, list[int]]:
    """The number that the base reaches to, if there is one, and the batches after it."""
    bases = [n for n in _numbered(spark, path, BASE) if _finished(spark, f"{path}/{BASE}{n}")]
    base = max(bases, default=None)
    return base, [n for n in _numbered(spark, path, BATCH) if base is None or n > base]


def next_batch(spark: SparkSession, path: str) -> int:
    base, later = _parts(spark, path)
    return max([-1 if base is None else base, *later]) + 1


def stored_rows(
    spark: SparkSession, path: str, up_to: int | None = None, buckets: list[str] | None = None
) -> DataFrame | None:
    """All rows of the base and of the batches after it (or those up to a number), with ``batch_id``; None without any.
    The base holds one row per key and has the number it reaches to. ``buckets``: only those of a table in buckets."""
    base, later = _parts(spark, path)
    later = [n for n in later if up_to is None or n <= up_to]
    if up_to is not None and base is not None and base > up_to:
        raise ValueError(f"{path} is folded up to batch {base}; it has no state of batch {up_to}")
    parts = [_base(spark, path, base, buckets).withColumn("batch_id", F.lit(base))] if base is not None else []
    parts += [_read(spark, path, [f"{BATCH}{n}" for n in later], buckets)] if later else []
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else None


def _base(spark: SparkSession, path: str, number: int, buckets: list[str] | None) -> DataFrame:
    return _read(spark, path, [f"{BASE}{number}"], buckets).drop(BASE.rstrip("="))


def current_rows(
    spark: SparkSession, path: str, keys: list[str], up_to: int | None = None, buckets: list[str] | None = None,
    distinct: bool = False,
) -> DataFrame:
    """The newest row of each key over all batches, or those up to a number (each batch holds a key at most
    once). ``buckets``: only those of a table whose buckets hold all rows of a key. ``distinct``: what wrote the batches makes
    sure that no key repeats in one, so the newest batch is taken as it is and the few before it are only filtered.

    The base, by far the largest part, is only filtered by the keys of the later batches; while those are small it is
    neither aggregated nor shuffled.
    """
    base, later = _parts(spark, path)
    later = [n for n in later if up_to is None or n <= up_to]
    if base is None:
        first, later = _read(spark, path, [f"{BATCH}{n}" for n in later[:1]], buckets).drop("batch_id"), later[1:]
    else:
        first = _base(spark, path, base, buckets)
    if distinct and 0 < len(later) <= 2:
        for number in later:
            newer = _read(spark, path, [f"{BATCH}{number}"], buckets).drop("batch_id")
            known = newer.select(*[F.col(k).alias(f"_{k}") for k in keys])
            same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
            first = first.join(known, same, "left_anti").select(*first.columns).unionByName(newer.select(*first.columns))
        return first
    return upsert(first, _read(spark, path, [f"{BATCH}{n}" for n in later], buckets), keys, "batch_id") if later else first


def compact(spark: SparkSession, path: str, keys: list[str], bucket_by: str | None = None, buckets: int = BUCKETS) -> None:
    """Fold all batches but the newest into the base. The newest stays apart, as a stream may repeat it.

    The new base counts once it is complete; what the base before it had replaced already is removed, so a reader that
    began earlier still finds its files.
    """
    base, later = _parts(spark, path)
    folded = later[:-1]
    if not folded:
        return
    rows, folder = current_rows(spark, path, keys, up_to=folded[-1]), f"{path}/{BASE}{folded[-1]}"
    if bucket_by is None:
        rows.write.mode("overwrite").parquet(folder)
    else:
        _in_buckets(rows.withColumn(BUCKET, bucket_of(F.col(bucket_by), buckets)), folder)
    if base is not None:
        for prefix, below in ((BATCH, base + 1), (BASE, base)):
            for number in _numbered(spark, path, prefix):
                if number < below:
                    _delete(spark, f"{path}/{prefix}{number}")


def compact_if_long(
    spark: SparkSession, path: str, keys: list[str], most: int = BATCHES_PER_BASE, bucket_by: str | None = None, buckets: int = BUCKETS
) -> None:
    """Called by jobs and streams after each batch: what a read has to merge stays bounded."""
    if path_exists(spark, path) and len(_parts(spark, path)[1]) > most:
        compact(spark, path, keys, bucket_by, buckets)


def at_once(spark: SparkSession, *writes: Callable[[], None]) -> None:
    """Run independent writes side by side: small ones do not wait for each other. The first error is raised when all have ended."""
    run = inheritable_thread_target(spark)
    with ThreadPoolExecutor(len(writes)) as pool:
        for write in [pool.submit(run(w)) for w in writes]:
            write.result()
