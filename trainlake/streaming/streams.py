"""Structured Streaming jobs. Each takes a landing folder and ends by itself when it is read
(``availableNow``), or runs on with another trigger.

State that outlives a batch is in batch logs (``writers.write_batch``): a batch that is repeated after a
failure overwrites its own folder, so every job is exactly-once by idempotence.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from trainlake import schemas as S
from trainlake.functions.dates import time_literal, utc_time
from trainlake.operators import calibration, ingest, metrics
from trainlake.operators.skew import best_rows
from trainlake.operators.upsert import latest_by_key
from trainlake.session import materialise, temporary_tables, tune
from trainlake.sources import writers
from trainlake.sources.readers import (
    ARRIVAL, CORRUPT, corrupt_kept, dated_exclusions, numbered, ordered_workouts, path_exists, read_or_empty,
)


def run(stream: DataFrame, handle, checkpoint: str, mode: str = "append", **trigger) -> StreamingQuery:
    def tuned(batch: DataFrame, batch_id: int) -> None:
        # A stream runs in a session of its own without adaptive execution; the batch work wants it.
        tune(batch.sparkSession)
        with temporary_tables(batch.sparkSession):
            handle(batch, batch_id)

    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(tuned)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def landed(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)


def workout_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Workouts of the landed pages, with what orders repeated ones within a batch (``readers.ARRIVAL``), and the text of
    lines that cannot be read (``readers.CORRUPT``)."""
    reader = corrupt_kept(spark.readStream, S.RAW_WORKOUT_PAGE)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return ordered_workouts(reader.json(folder))


def sync_sessions(
    workouts: DataFrame,
    table: str,
    checkpoint: str,
    replay_days: int | None = S.REPLAY_DAYS,
    intervals: str | None = None,
    rejects: str | None = None,
    mark_of: str = "athlete",
    **trigger,
) -> StreamingQuery:
    """Keep a session table (and an interval table) up to date; of repeated workouts the last usable one counts.

    Every landed workout is stored, or in a log beside the table: ``rejects`` (without a time) or late ones
    (``late_workouts``); lines that cannot be read are in ``corrupt_lines``. A workout is late if it is dated more than ``replay_days``
    before the newest one seen in earlier batches of its athlete, or with ``mark_of="source"`` of all athletes (None: no limit). A
    date after the landing of its file counts for no mark.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        _store_sessions(batch, batch_id, table, replay_days, intervals, rejects, mark_of)

    return run(workouts, handle, checkpoint, **trigger)


def _store_sessions(
    batch: DataFrame, batch_id: int, table: str, replay_days: int | None, intervals: str | None = None,
    rejects: str | None = None, mark_of: str = "athlete", beside: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """Store the batch and return it as written. ``beside`` gets the stored rows while the smaller tables are written."""
    spark, marks = batch.sparkSession, f"{table}_marks"
    earlier = _earlier_batches(spark, marks, batch_id)
    batch = numbered(batch).persist()
    try:
        rows, writes = batch, []
        if CORRUPT in batch.columns:
            broken = batch.where(F.col(CORRUPT).isNotNull()).select(*S.CORRUPT_LINE.fieldNames())
            writes.append(lambda: writers.write_batch(broken, f"{table}_corrupt", batch_id))
            rows = batch.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
        taken = rows
        if earlier is not None and replay_days is not None:
            taken, late = _split_late(rows, earlier, replay_days, mark_of)
            writes.append(lambda: writers.write_batch(late, f"{table}_late", batch_id))
        wanted = [c for c in S.RAW_WORKOUT.fieldNames() if intervals or c != "intervals"]
        newest = latest_by_key(ingest.valid_workouts(taken), ["id"], ARRIVAL, wanted)
        rejected = ingest.rejected_workouts(taken).select(*S.RAW_WORKOUT.fieldNames())
        moved = _moved_marks(ingest.marks_of(taken, "sessions"), earlier)
        writes.append(lambda: writers.write_batch(rejected, rejects or f"{table}_rejects", batch_id))
        writes.append(lambda: writers.write_batch(moved, marks, batch_id))
        if intervals:
            writes.append(lambda: writers.write_batch(ingest.flatten_intervals(newest), intervals, batch_id))
        # The first write reads the landed files and fills the cache for the others.
        writers.write_batch(ingest.normalise(newest), table, batch_id)
        stored = spark.read.parquet(f"{table}/batch_id={batch_id}")
        writers.at_once(spark, *writes, *([lambda: beside(stored)] if beside else []))
        writers.compact_if_long(spark, marks, ["source_name", "athlete_id"])
        if intervals:
            writers.compact_if_long(spark, intervals, ["interval_id"])
    finally:
        batch.unpersist()
    writers.compact_if_long(spark, table, ["workout_id"])
    return stored


def _moved_marks(found: DataFrame, earlier: DataFrame | None) -> DataFrame:
    """The marks of the athletes of a batch; a mark never moves back."""
    if earlier is None:
        return found
    of = F.col("athlete_id").eqNullSafe(F.col("found_id"))
    before = earlier.join(found.select(F.col("athlete_id").alias("found_id")), of, "left_semi").select(*found.columns)
    return found.unionByName(before).groupBy("source_name", "athlete_id").agg(F.max("last_sync_ts").alias("last_sync_ts"))


def _split_late(batch: DataFrame, marks: DataFrame, replay_days: int, mark_of: str) -> tuple[DataFrame, DataFrame]:
    """The rows to take in, and those too late with the reason."""
    if mark_of == "athlete":
        judged = ingest.judged_by_athlete(batch, marks, replay_days)
    else:
        judged = ingest.judged_by_source(batch, marks, "sessions", replay_days)
    late = judged.where(F.col("late").isNotNull()).select(*S.LATE_WORKOUT.fieldNames())
    return judged.where(F.col("late").isNull()).drop("late"), late


def late_workouts(spark: SparkSession, table: str) -> DataFrame:
    """The workouts that came too late, with the reason: to be taken in by hand or by a stream without a limit."""
    return read_or_empty(spark, f"{table}_late", S.LATE_WORKOUT).select(*S.LATE_WORKOUT.fieldNames())


def corrupt_lines(spark: SparkSession, table: str) -> DataFrame:
    """The landed lines that could not be read."""
    return read_or_empty(spark, f"{table}_corrupt", S.CORRUPT_LINE).select(*S.CORRUPT_LINE.fieldNames())


def rejected_workouts(spark: SparkSession, table: str) -> DataFrame:
    """The workouts that the stream of a session table has set aside."""
    return read_or_empty(spark, f"{table}_rejects", S.RAW_WORKOUT).select(*S.RAW_WORKOUT.fieldNames())


def _earlier_batches(spark: SparkSession, table: str, batch_id: int) -> DataFrame | None:
    """Rows of the batches before this one (a repeated batch must not see itself), whether folded or not."""
    if not path_exists(spark, table):
        return None
    return writers.stored_rows(spark, table, up_to=batch_id - 1)


def sync_metrics(
    workouts: DataFrame, sessions: str, derived: str, checkpoint: str, replay_days: int | None = S.REPLAY_DAYS,
    buckets: int = writers.BUCKETS, **trigger,
) -> StreamingQuery:
    """Session table plus derived metrics. A changed row touches itself and the few rows after it, so each batch recomputes the
    athletes it contains from their first changed row on; six rows before that are enough history.

    What an athlete has is read from the folders of the batch's own athletes only (``_changed_history``), so the cost of a batch
    follows the batch and its athletes, not the whole table. ``buckets``: number of these folders, fixed for a table.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, history = batch.sparkSession, f"{derived}_history"
        touched = []
        _store_sessions(
            batch, batch_id, sessions, replay_days, beside=lambda stored: touched.extend(_changed_history(stored, derived, batch_id, buckets))
        )
        if not touched:
            return
        mine = spark.read.parquet(f"{history}/batch_id={batch_id}").drop(writers.BUCKET)
        before = writers.stored_rows(spark, history, batch_id - 1, touched)
        if before is None:  # all there is is new
            found = metrics.daily_metrics(mine.where("NOT moved_away")).unionByName(metrics_removed(mine))
            writers.write_batch(found.withColumn("athlete_key", _athlete_key()), derived, batch_id, "athlete_key", buckets)
            return
        times = [*HISTORY_KEYS, "workout_date"]
        versions = before.select(*times).join(mine.select(*HISTORY_KEYS), HISTORY_KEYS, "left_semi").unionByName(mine.select(*times))
        # The earliest old or new time of a changed workout; a time that is NULL sorts last.
        since = materialise(versions.groupBy("athlete_key").agg(F.min("workout_date").alias("since")), "since")
        current = writers.current_rows(spark, history, HISTORY_KEYS, batch_id, touched, distinct=True)
        current = current.where("NOT moved_away").join(since, "athlete_key")
        affected = F.col("workout_date").isNull() | F.coalesce(F.col("workout_date") >= F.col("since"), F.lit(False))
        newest_first = [F.desc(name) for name in metrics.SESSION_ORDER]
        earlier = best_rows(
            metrics.eligible_sessions(current.where(~affected)), "athlete_key", newest_first, S.LOAD_SESSIONS - 1
        )
        rows = materialise(current.where(affected).unionByName(earlier.drop("rank")), "touched")
        recomputed = metrics.daily_metrics(rows).join(since.withColumnRenamed("athlete_key", "of"), _athlete_key() == F.col("of"))
        recomputed = recomputed.where(affected).drop("since", "of")
        # Workouts that stopped being eligible or went to another athlete leave an empty marker, so that the older row is not used.
        found = recomputed.unionByName(metrics_removed(mine)).withColumn("athlete_key", _athlete_key())
        writers.write_batch(found, derived, batch_id, "athlete_key", buckets)
        writers.compact_if_long(spark, derived, HISTORY_KEYS, bucket_by="athlete_key", buckets=buckets)
        writers.compact_if_long(spark, history, HISTORY_KEYS, bucket_by="athlete_key", buckets=buckets)

    return run(workouts, handle, checkpoint, **trigger)


# An athlete may be unknown (NULL), which keys cannot be.
HISTORY_KEYS = ["athlete_key", "workout_id"]


def _athlete_key() -> Column:
    return F.coalesce(F.col("athlete_id").cast("string"), F.lit(""))


def _changed_history(changed: DataFrame, derived: str, batch_id: int, buckets: int) -> list[str]:
    """Store the changed sessions by athlete and return the buckets that they touch.

    ``{derived}_places`` says which athlete a workout belongs to, in buckets by workout. A workout that comes back with another
    athlete leaves a row ``moved_away`` in the history of the one before, so that each bucket is complete by itself."""
    spark, history, places = changed.sparkSession, f"{derived}_history", f"{derived}_places"
    now = changed.withColumns({"athlete_key": _athlete_key(), "moved_away": F.lit(False)})
    writers.write_batch(now.select("workout_id", "athlete_key"), places, batch_id, "workout_id", buckets)
    rows = now
    if writers.stored_rows(spark, places, batch_id - 1) is not None:
        touched = writers.touched_buckets(spark, places, batch_id)
        before = writers.current_rows(spark, places, ["workout_id"], batch_id - 1, touched, distinct=True)
        moved = now.join(before.withColumnRenamed("athlete_key", "was"), "workout_id").where("was <> athlete_key")
        number = F.when(F.col("was") != "", F.col("was")).cast(changed.schema["athlete_id"].dataType)
        moved = moved.withColumns({"athlete_key": F.col("was"), "athlete_id": number, "moved_away": F.lit(True)}).select(*now.columns)
        rows = now.unionByName(moved)
    writers.write_batch(rows, history, batch_id, "athlete_key", buckets)
    writers.compact_if_long(spark, places, ["workout_id"], bucket_by="workout_id", buckets=buckets)
    return writers.touched_buckets(spark, history, batch_id)


def metrics_removed(changed: DataFrame) -> DataFrame:
    """Markers for changed workouts of an athlete that are not (or no longer) eligible: their key with no split. A row of the
    newest batch is the current one of its key, so it tells by itself."""
    gone = changed.where(F.col("moved_away") | ~F.coalesce(metrics.is_eligible(), F.lit(False)))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in S.METRICS.fields[2:]]
    return gone.select("athlete_id", "workout_id", *empty)


def current_metrics(spark: SparkSession, derived: str, athletes: list[int] | None = None, buckets: int = writers.BUCKETS) -> DataFrame:
    """The metrics as they stand, of all athletes or of a few, which are read from their own buckets."""
    of = None
    if athletes is not None:
        keys = spark.createDataFrame([(str(a),) for a in athletes], "athlete_key string")
        of = [r[0] for r in keys.select(writers.bucket_of(F.col("athlete_key"), buckets)).distinct().collect()]
    newest = writers.current_rows(spark, derived, HISTORY_KEYS, buckets=of, distinct=True).where(F.col("avg_split_sec").isNotNull())
    if athletes is not None:
        newest = newest.where(F.col("athlete_id").isin(list(athletes)))
    return newest.select(*S.METRICS.fieldNames())


def exclusion_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Landed exclusion records with the time of their landing."""
    records = landed(spark, folder, S.RAW_EXCLUSION)
    return dated_exclusions(records.select("*", F.col("_metadata.file_modification_time").alias("landed_at")))


def keep_exclusion_log(
    records: DataFrame, log: str, checkpoint: str, as_of: Callable[[], datetime | str] | datetime | str | None = None,
    days: int = S.RETENTION_DAYS, **trigger,
) -> StreamingQuery:
    """Append each batch of exclusion records and apply the retention period to the log. It counts from ``as_of``, which
    may be a function that is asked at every batch; by default from the newest landing of the batch, never from the records. A record
    of a later time has a wrong one: it goes to a log of its own (``future_exclusions``)."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        limit = as_of() if callable(as_of) else as_of
        if limit is None and "landed_at" in batch.columns:
            limit = batch.agg(F.max(utc_time(F.col("landed_at")))).first()[0]
        if limit is None and "landed_at" not in batch.columns:
            raise ValueError("records without landed_at need as_of")
        batch = batch.drop("landed_at")
        if limit is None:  # an empty batch
            return
        future = F.coalesce(F.col("timestamp") > time_literal(limit), F.lit(False))
        writers.write_batch(batch.where(future), f"{log}_future", batch_id)
        writers.append_exclusions(batch.where(~future), log, batch_id)
        writers.prune_exclusions(batch.sparkSession, log, limit, days)

    return run(records, handle, checkpoint, **trigger)


def future_exclusions(spark: SparkSession, log: str) -> DataFrame:
    """The records that were set aside as they claim a time that had not come when they landed."""
    return read_or_empty(spark, f"{log}_future", S.EXCLUSION).select(*S.EXCLUSION.fieldNames())


def update_confidence(events: DataFrame, entities: DataFrame, store: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Fold each batch of lineage events into the stored confidences (id, confidence per batch)."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            ids = batch.select(F.col("object_id").alias("id")).distinct()
            affected = entities.join(ids, "id", "left_semi")
            earlier = _earlier_batches(batch.sparkSession, store, batch_id)
            if earlier is not None:
                newest = latest_by_key(earlier.join(ids, "id", "left_semi"), ["id"], ["batch_id"])
                affected = _with_stored(affected, newest)
            updated = calibration.recalibrate_fold(affected, batch).select("id", "confidence")
            writers.write_batch(updated, store, batch_id)
        finally:
            batch.unpersist()
        writers.compact_if_long(batch.sparkSession, store, ["id"])

    return run(events, handle, checkpoint, **trigger)


def current_confidence(spark: SparkSession, entities: DataFrame, store: str) -> DataFrame:
    return _with_stored(entities, writers.current_rows(spark, store, ["id"]))


def _with_stored(entities: DataFrame, stored: DataFrame) -> DataFrame:
    newest = stored.select("id", F.col("confidence").alias("stored"))
    return entities.join(newest, "id", "left").withColumn(
        "confidence", F.coalesce("stored", "confidence")
    ).drop("stored")
