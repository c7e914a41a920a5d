"""The confidence of entities as keyed state of the stream itself (Spark's ``transformWithState`` on RocksDB).

``streams.update_confidence`` looks the stored confidence of the entities of a batch up in a table; here it lives with the
key, in the state store of the query, and a batch touches the state of its own entities only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from trainlake import schemas as S
from trainlake.operators import calibration
from trainlake.sources import writers
from trainlake.streaming.streams import run

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def folded(confidence: float, seq: np.ndarray, observed: np.ndarray) -> float:
    """The confidence after all events in order of ``seq`` (then of what they observed), clamped after each. A step keeps values
    of [0, 1] there, so the clamp acts on others only, and then the steps are one weighted sum."""
    order = np.lexsort((observed, seq))
    seen = observed[order]
    if 0 <= confidence <= 1 and len(seen) and seen.min() >= 0 and seen.max() <= 1:
        keep = (1 - S.EMA_ALPHA) ** np.arange(len(seen), 0, -1)
        return float(keep[0] * confidence + S.EMA_ALPHA / (1 - S.EMA_ALPHA) * (keep @ seen))
    for value in seen.tolist():
        confidence = min(1.0, max(0.0, (1 - S.EMA_ALPHA) * confidence + S.EMA_ALPHA * value))
    return confidence


class ConfidenceState(StatefulProcessor):
    """One number per entity. An entity without events for ``idle_ms`` loses its state; its confidence is in the output."""

    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("confidence", "confidence double", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Two numbers for each event of the key in this micro-batch, whatever comes with it.
        start, seqs, values = None, [], []
        for batch in rows:
            start = float(batch["confidence"].iloc[0]) if start is None else start
            seqs.append(batch["seq"].to_numpy())
            values.append(batch["observed"].to_numpy())
        known = self.state.get() if self.state.exists() else None
        confidence = folded(start if known is None else float(known[0]), np.concatenate(seqs), np.concatenate(values))
        self.state.update((confidence,))
        yield pd.DataFrame({"id": [key[0]], "confidence": [confidence]})

    def close(self) -> None:
        pass


def keep_confidence(
    events: DataFrame, entities: DataFrame, store: str, checkpoint: str, idle_hours: float | None = None, **trigger
) -> StreamingQuery:
    """Fold lineage events (a stream of object_id, seq, referenced, usefulness) into the confidence of each entity and write what
    changed to ``store``, which ``streams.current_confidence`` reads.

    An entity begins with the confidence in ``entities``. With ``idle_hours`` the state of entities without events goes after that time;
    if one comes back, it begins with ``entities`` again, so give the current ones (``streams.current_confidence``) at a restart. Events of
    one micro-batch are put in order; those of an earlier number that arrive in a later one count when they come. A task holds
    two numbers per event of an entity in a micro-batch, whose size the trigger bounds (``files_per_batch`` of ``streams.landed``). A
    query with ``idle_hours`` has always one more micro-batch to run, so without a trigger it runs a single one.
    """
    spark = events.sparkSession
    seen = calibration.observed(F.col("complete"), F.col("referenced"), F.col("usefulness"))
    known = entities.select(F.col("id").alias("object_id"), "confidence", calibration.complete_of(entities).alias("complete"))
    rows = events.join(known, "object_id").select(F.col("object_id").alias("id"), "seq", seen.alias("observed"), "confidence")
    idle_ms = None if idle_hours is None else int(idle_hours * 3_600_000)
    updated = rows.groupBy("id").transformWithStateInPandas(
        ConfidenceState(idle_ms), "id string, confidence double", "Update", "None" if idle_ms is None else "ProcessingTime"
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        writers.write_batch(batch, store, batch_id)
        writers.compact_if_long(batch.sparkSession, store, ["id"])

    if idle_ms is not None and not trigger:
        trigger = {"once": True}
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        return run(updated, handle, checkpoint, mode="update", **trigger)
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
