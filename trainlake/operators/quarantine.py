"""The log of excluded records: rows, checks, queries and retention."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainlake import schemas as S
from trainlake.functions.dates import time_literal
from trainlake.operators.quality import require_known


def exclusions(decisions: DataFrame, now: datetime | str) -> DataFrame:
    """One log record per candidate that was left out, with the details its reason calls for."""
    reason = F.col("reason_code")
    text = lambda name: F.col(name).cast("string")
    extra = (
        F.when(
            reason.isin("pep_tier_gate", "pep_access_denied"),
            F.create_map(
                F.lit("coach_id"), text("requesting_coach"), F.lit("mode"), F.col("mode"),
                F.lit("tier"), F.col("tier"),
            ),
        )
        .when(
            reason == "completeness_below_threshold",
            F.create_map(F.lit("completeness_ratio"), text("completeness")),
        )
        .when(
            reason == "budget_truncation",
            F.create_map(
                F.lit("estimated_tokens"), text("estimated_tokens"), F.lit("token_budget"), text("token_budget")
            ),
        )
    )
    return decisions.where(reason.isNotNull()).select(
        time_literal(now).alias("timestamp"),
        F.col("id").alias("object_id"),
        "entity_type",
        "reason_code",
        F.col("priority").alias("priority_score"),
        extra.alias("extra"),
    )


def checked(records: DataFrame) -> DataFrame:
    """Records for the log; a reason outside the closed list is an error when the rows are written."""
    return records.withColumn("reason_code", require_known(F.col("reason_code"), S.REASON_CODES, "reason code"))


def with_event_date(records: DataFrame) -> DataFrame:
    """The partition column of the log; NULL for records whose time could not be read."""
    return records.withColumn("event_date", F.to_date("timestamp"))


def query(
    log: DataFrame,
    reason_code: str | None = None,
    entity_type: str | None = None,
    since: datetime | str | None = None,
) -> DataFrame:
    if reason_code:
        log = log.where(F.col("reason_code") == reason_code)
    if entity_type:
        log = log.where(F.col("entity_type") == entity_type)
    if since:
        log = log.where(F.col("timestamp") >= time_literal(since))
        if "event_date" in log.columns:  # prunes partitions
            log = log.where(F.col("event_date") >= F.to_date(time_literal(since)))
    return log


def retained(log: DataFrame, as_of: datetime | str, days: int = S.RETENTION_DAYS) -> DataFrame:
    """Records not older than ``days``; those without a readable time stay."""
    limit = time_literal(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
    return log.where(F.col("timestamp").isNull() | (F.col("timestamp") >= limit))


def counts(log: DataFrame) -> DataFrame:
    return log.groupBy("reason_code", "entity_type", F.to_date("timestamp").alias("event_date")).agg(
        F.count(F.lit(1)).alias("n_records")
    )
