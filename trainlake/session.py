"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators rely on. All can be set on a running session.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split skewed join partitions even where that costs one more shuffle afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Let "row_number() <= k" cut rows before the shuffle for any k used here.
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
}

SHUFFLE_PARTITION_BYTES = 128 * 1024**2

_LOCAL_FOLDER_KEY = "spark.trainlake.local.folder"


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shuffle_partitions(input_bytes: int, cores: int) -> int:
    """Partitions for a shuffle of about the input size: near 128 MB each and two waves of tasks at least.
    Adaptive execution joins them when there is less to move, but never adds any."""
    return max(2 * cores, -(-input_bytes // SHUFFLE_PARTITION_BYTES))


def build_session(
    app_name: str = "trainlake",
    master: str | None = None,
    input_bytes: int | None = None,
    cores: int = 8,
    **settings: str,
) -> SparkSession:
    """A session with the runtime settings. ``input_bytes`` and ``cores`` (of the whole cluster) size the
    shuffles; without them Spark's own setting stays."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if input_bytes is not None:
        builder = builder.config("spark.sql.shuffle.partitions", shuffle_partitions(input_bytes, cores))
    for key, value in {**RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster; a new /tmp folder only where one process does all (``local[...]``)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = spark.conf.get(_LOCAL_FOLDER_KEY, None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="trainlake-")
        spark.conf.set(_LOCAL_FOLDER_KEY, folder)
    return folder


def _own_folder(spark: SparkSession) -> str:
    return f"{work_folder(spark)}/trainlake/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path nobody has used before, so nothing is ever overwritten."""
    return f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def drop_work_tables(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application, when nothing reads them any more."""
    _delete(spark, _own_folder(spark))


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


_created: ContextVar[list[str] | None] = ContextVar("created", default=None)


@contextmanager
def temporary_tables(spark: SparkSession):
    """Removes the tables written by ``materialise`` inside the block at its end. Only for blocks that finish
    all work on them, such as one batch of a stream."""
    paths: list[str] = []
    token = _created.set(paths)
    try:
        yield
    finally:
        _created.reset(token)
        for path in paths:
            _delete(spark, path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the work folder and read it back.

    Cuts the lineage with something that survives the loss of executors, and freezes values that
    another evaluation might compute differently (partition numbers).
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    if (created := _created.get()) is not None:
        created.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
