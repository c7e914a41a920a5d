"""What the corpus operators share: reading, stored intermediate tables and row keys."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trainlake.session import materialise

# Rows that Arrow hands to Python at once. Texts can be long; with 64 MB (Spark's own limit) this bounds a batch.
BATCH_ROWS = 1024

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder. The shuffles that made it are removed when it is written, so the
    disk holds the largest step and not the sum of all."""
    with setting(df.sparkSession, _CLEANUP, "true"):
        return materialise(df, label)


def discard(table: DataFrame) -> None:
    """Remove a table made by ``stored`` that nothing reads any more."""
    spark = table.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0]).getParent() if table.inputFiles() else None
    if folder is not None:
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def with_place(table: DataFrame, name: str) -> DataFrame:
    """Add the place of each row in a table that Spark wrote in order: the number of its part, then its row in it. A table
    that is no file is written first, which keeps the order of its partitions."""
    try:
        found = table.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return with_place(stored(table, "placed"), name)
    per_file = int(table.sparkSession.conf.get("spark.sql.files.maxRecordsPerFile", "0"))
    part = F.regexp_extract("_file", r"^part-(\d+)", 1).cast("long")
    file = F.coalesce(F.try_to_number(F.regexp_extract("_file", r"-c(\d+)\.", 1), F.lit("9" * 9)).cast("long"), F.lit(0))
    return found.withColumn(name, F.shiftleft(part, 40) + file * max(0, per_file) + F.col("_row")).drop("_file", "_row")


def text_of(column: str) -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def bounded_sample(rows: DataFrame, most: int, *columns: str) -> DataFrame:
    """The ``most`` rows with the smallest hashes of ``columns``. Of many rows, those that cannot be among them are left out
    before tasks send theirs to be merged, so what is sent does not grow with the number of tasks."""
    place = F.xxhash64(*columns).bitwiseAND(F.lit(2**31 - 1))
    share = min(1.0, 2 * most / max(1, rows.count()))
    return rows.where(place <= int(share * 2**31)).orderBy(place, *columns).limit(most)


def some(rows: list[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """A frame of the rows, if there are any: an empty frame has no types that Arrow could check."""
    if rows:
        yield pd.DataFrame(rows, columns=columns)


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting of the session for the time of one write."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def spread(rows: int, per_task: int) -> int:
    """How many tasks so that each has about ``per_task`` of the rows."""
    return max(1, -(-rows // per_task))


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of whole groups of rows that arrive sorted by ``keys``, with the limits of the groups in each: many small
    groups at once, and no group split. What is held back is never more than one group and one batch."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        frame = batch if held is None else pd.concat([held, batch], ignore_index=True)
        new = np.zeros(len(frame), dtype=bool)
        for key in keys:
            values = frame[key].to_numpy()
            new[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(new)
        if not len(starts):
            held = frame
            continue
        yield frame.iloc[: starts[-1]], np.concatenate([[0], starts])
        held = frame.iloc[starts[-1] :].reset_index(drop=True)
    if held is not None:
        yield held, np.array([0, len(held)])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of the undirected edges (a, b); root is the smallest node that can be reached.

    Large and small stars in turn: every node hangs its neighbours on the smallest one it knows. The number of rounds
    grows with the logarithm of the longest path. All steps are joins and minima, so a node with very many neighbours is
    only a skewed key."""
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    print_of = [F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    before = None
    while (print_now := tuple(now.agg(*print_of).first())) != before:
        before = print_now
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        lowest = stored(lowest, "lowest")
        large = stored(both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(), "large-star")
        lowest = stored(large.groupBy("a").agg(F.min("b").alias("low")), "lowest")
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = small.unionByName(lowest.select("a", F.col("low").alias("b"))).where("a <> b").distinct()
        now = stored(small, "small-star")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
