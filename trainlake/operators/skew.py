"""Operators that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trainlake.session import materialise

# Rows of one key that a single task may sort. About 200 MB for the narrow rows used here.
DEFAULT_MAX_ROWS = 2_000_000


def hot_keys(rows: DataFrame, key: str, max_rows: int) -> DataFrame:
    """Keys with more than ``max_rows`` rows; at most (all rows / max_rows) of them."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > max_rows)


def earliest_first(order: list[str]) -> list[Column]:
    return [F.asc_nulls_last(name) for name in order]


def latest_first(order: list[str]) -> list[Column]:
    return [F.desc_nulls_first(name) for name in order]


def split_by_heat(
    rows: DataFrame, key: str, order: list[str], max_rows: int
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of hot keys cut into ordered segments or None).

    The hot rows are range partitioned on key and order, so a segment is a run of neighbouring rows of
    bounded size whatever the distribution; rows that are equal in both may be cut anywhere. The segment
    number is written out with the rows: it is data from there on, and no retry can compute a different one.
    """
    hot = hot_keys(rows, key, max_rows)
    hot_rows = hot.agg(F.sum("n_rows").alias("n")).first()["n"]
    if not hot_rows:
        return rows, None
    names = materialise(hot.select(F.col(key).alias("hot_key")), "hot-keys")
    is_hot = rows[key].eqNullSafe(names["hot_key"])
    segments = ceil(hot_rows / max_rows) + 1
    cut = (
        rows.join(names, is_hot, "left_semi")
        .withColumn("tie", F.monotonically_increasing_id())
        .repartitionByRange(segments, F.col(key), *earliest_first(order), F.col("tie"))
        .drop("tie")
        .withColumn("segment", F.spark_partition_id())
    )
    return rows.join(names, is_hot, "left_anti"), materialise(cut, "segments")


def ordered_segments(
    rows: DataFrame, key: str, order: list[str], max_rows: int = DEFAULT_MAX_ROWS
) -> DataFrame:
    """Add ``segment``: within a key, a higher segment holds no earlier rows."""
    ordinary, cut = split_by_heat(rows, key, order, max_rows)
    ordinary = ordinary.withColumn("segment", F.lit(0))
    return ordinary if cut is None else ordinary.unionByName(cut)


def over_recent_history(
    rows: DataFrame,
    key: str,
    order: list[str],
    frame_rows: int,
    compute: Callable[[DataFrame, WindowSpec], DataFrame],
    max_rows: int = DEFAULT_MAX_ROWS,
) -> DataFrame:
    """Apply window columns that look back at most ``frame_rows`` rows of the same key.

    Ordinary keys get one window per key. A hot key gets one window per segment, and every segment first
    receives the ``frame_rows`` rows that precede it, so the result is the same.
    """
    ordinary, cut = split_by_heat(rows, key, order, max_rows)
    result = compute(ordinary, Window.partitionBy(key).orderBy(*earliest_first(order)))
    if cut is None:
        return result

    backwards = Window.partitionBy(key, "segment").orderBy(*latest_first(order))
    tails = cut.withColumn("from_end", F.row_number().over(backwards)).where(F.col("from_end") <= frame_rows)
    # The tails of all earlier segments contain the last rows before a segment, in order.
    along = Window.partitionBy(key).orderBy("segment", *earliest_first(order))
    before = (
        tails.select(
            key,
            "segment",
            F.lag("segment").over(along).alias("previous_segment"),
            F.collect_list(F.struct(*rows.columns))
            .over(along.rowsBetween(-frame_rows, -1))
            .alias("history"),
        )
        .where(F.col("segment") != F.col("previous_segment"))
        .select("segment", F.inline("history"))
        .withColumn("is_history", F.lit(True))
    )
    extended = cut.withColumn("is_history", F.lit(False)).unionByName(before)
    history_first = Window.partitionBy(key, "segment").orderBy(F.desc("is_history"), *earliest_first(order))
    split = compute(extended, history_first)
    return result.unionByName(split.where(~F.col("is_history")).drop("segment", "is_history"))


def best_rows(rows: DataFrame, key: str, order: list[Column], k: int, own: Column | None = None) -> DataFrame:
    """The first ``k`` rows per key with their ``rank``; with ``own``, fewer where that expression says so.

    Two levels: every input partition keeps ``k`` rows per key, groups of partitions are cut to ``k``
    again, and only then does one task see what is left of a key. Which partition a row is in does not
    change the result.
    """
    grouped = rows.withColumn("slice", F.spark_partition_id() % 64)
    first = Window.partitionBy(key, "slice").orderBy(*order)
    last = Window.partitionBy(key).orderBy(*order)
    within = F.lit(True) if own is None else F.col("rank") <= own
    return (
        grouped.withColumn("rank", F.row_number().over(first))
        .where((F.col("rank") <= k) & within)
        .drop("slice")
        .withColumn("rank", F.row_number().over(last))
        .where((F.col("rank") <= k) & within)
    )
