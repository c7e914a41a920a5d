"""Keyed upserts on plain DataFrames: the last row of a batch wins, stored rows of its keys are replaced."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainlake.functions.dates import time_literal


RECOVERY_KEYS = ["athlete_id", "record_date"]


def latest_by_key(rows: DataFrame, keys: list[str], version: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row per key, the one with the highest version. ``max_by`` combines before the shuffle. ``columns``: those to
    return, as Spark moves and sorts all that are asked for."""
    columns = columns or rows.columns
    others = [c for c in columns if c not in keys]
    newest = F.max_by(F.struct(*others), F.struct(*version)).alias("newest")
    return rows.groupBy(*keys).agg(newest).select(*keys, "newest.*").select(*columns)


def upsert(existing: DataFrame, batch: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """``existing`` with the rows of ``batch`` in place of those that have the same key.

    Only the batch is aggregated. The stored side is filtered by an anti join on the batch keys, which
    Spark broadcasts when the batch is small, so the stored side is then not shuffled.
    """
    incoming = latest_by_key(batch, keys, [ordinal]).drop(ordinal)
    kept = existing.join(incoming.select(*keys), keys, "left_anti")
    return kept.select(*existing.columns).unionByName(incoming.select(*existing.columns))


def upsert_sessions(existing: DataFrame, batch: DataFrame, now: datetime | str) -> DataFrame:
    """Upsert by ``workout_id``. Creation time is that of the last replacement."""
    stamped = batch.withColumn("created_at", time_literal(now)).withColumn("updated_at", time_literal(now))
    return upsert(existing, stamped, ["workout_id"])


def upsert_intervals(existing: DataFrame, batch: DataFrame, now: datetime | str) -> DataFrame:
    """Upsert by ``interval_id``. Intervals that a shorter repeat no longer has stay stored."""
    return upsert(existing, batch.withColumn("created_at", time_literal(now)), ["interval_id"])


def upsert_recovery(existing: DataFrame, batch: DataFrame, now: datetime | str) -> DataFrame:
    """Upsert by athlete and day. The first creation time is kept."""
    stamped = stamped_recovery(existing, batch, ["ordinal"], now).drop("ordinal")
    return upsert(existing, stamped.withColumn("ordinal", F.lit(0)), RECOVERY_KEYS)


def stamped_recovery(existing: DataFrame, batch: DataFrame, version: list[str], now: datetime | str) -> DataFrame:
    """The last row of each athlete and day of a batch, with the creation time of the stored row if there is one."""
    incoming = latest_by_key(batch, RECOVERY_KEYS, version)
    # The stored rows of these keys only: the first creation time of each.
    known = existing.join(incoming.select(*RECOVERY_KEYS), RECOVERY_KEYS, "left_semi")
    first = known.groupBy(*RECOVERY_KEYS).agg(F.min("created_at").alias("created_at"))
    stamped = incoming.drop("created_at").join(first, RECOVERY_KEYS, "left")
    return stamped.withColumn("created_at", F.coalesce("created_at", time_literal(now)))


def mark_synced(existing: DataFrame, marks: DataFrame) -> DataFrame:
    """Set the last sync time of each source in ``marks`` (source_name, last_sync_ts)."""
    newest = marks.withColumn("ordinal", F.col("last_sync_ts"))
    return upsert(existing, newest, ["source_name"])
