"""Confidence updates from the use of context records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainlake import schemas as S
from trainlake.operators.context import completeness
from trainlake.operators.skew import split_by_heat
from trainlake.operators.upsert import latest_by_key

Scorer = Callable[[Column, Column, Column, Column], Column]

EVENTS_PER_TASK = 200_000


def complete_of(entities: DataFrame) -> Column:
    """Completeness of entities; measured ones have it already."""
    return F.col("completeness") if "completeness" in entities.columns else completeness()


def with_initial_confidence(entities: DataFrame) -> DataFrame:
    """On first ingest the confidence is the completeness."""
    return entities.withColumn("confidence", F.coalesce(F.col("confidence"), complete_of(entities)))


def observed(complete: Column, referenced: Column, usefulness: Column) -> Column:
    return complete * F.when(referenced, F.coalesce(usefulness, F.lit(1.0))).otherwise(F.lit(0.0))


def moving_average(confidence: Column, complete: Column, referenced: Column, usefulness: Column) -> Column:
    return (1 - S.EMA_ALPHA) * confidence + S.EMA_ALPHA * observed(complete, referenced, usefulness)


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def recalibrate_batch(entities: DataFrame, events: DataFrame, scorer: Scorer = moving_average) -> DataFrame:
    """One update per entity from ``events`` (object_id, seq, referenced, usefulness); of several events of
    an entity the last counts. Entities without an event keep their confidence.

    ``scorer`` maps (confidence, completeness, referenced, usefulness) to a new value: a column expression,
    or a ``pandas_udf("double")``. The result is clamped to [0, 1].
    """
    last = latest_by_key(events, ["object_id"], ["seq"]).select(
        F.col("object_id").alias("id"), "referenced", "usefulness", F.lit(True).alias("has_event")
    )
    scored = clamp(scorer(F.col("confidence"), F.col("complete"), F.col("referenced"), F.col("usefulness")))
    updated = F.when(F.col("has_event"), scored).otherwise(F.col("confidence"))
    return (
        # Completeness first: the join then carries texts only if the caller wants them back.
        entities.withColumn("complete", complete_of(entities))
        .join(last, "id", "left")
        .withColumn("confidence", updated)
        .select(*entities.columns)
    )


# A moving-average step followed by the clamp is c -> min(high, max(low, gain * c + offset)). Such maps
# compose into one of the same form, so a long history can be folded piece by piece.
def _compose(first: Column, then: Column) -> Column:
    bound = lambda v: F.least(then["high"], F.greatest(then["low"], then["gain"] * v + then["offset"]))
    return F.struct(
        (then["gain"] * first["gain"]).alias("gain"),
        (then["gain"] * first["offset"] + then["offset"]).alias("offset"),
        bound(first["low"]).alias("low"),
        bound(first["high"]).alias("high"),
    )


def _identity() -> Column:
    infinity = F.lit(float("inf"))
    return F.struct(
        F.lit(1.0).alias("gain"), F.lit(0.0).alias("offset"), (-infinity).alias("low"), infinity.alias("high")
    )


def _step(offset: Column) -> Column:
    """One event as such a map."""
    return F.struct(
        F.lit(1 - S.EMA_ALPHA).alias("gain"), offset.alias("offset"), F.lit(0.0).alias("low"), F.lit(1.0).alias("high")
    )


def folded_events(events: DataFrame, entities: DataFrame, events_per_task: int = EVENTS_PER_TASK) -> DataFrame:
    """(id, step): all events of an entity, in order of ``seq``, as one map of its confidence.

    Events of entities with a very long history are cut into ordered segments; each segment is folded on
    its own and then the segments of an entity, so no task collects an unbounded history.
    """
    complete = entities.select(F.col("id").alias("object_id"), complete_of(entities).alias("complete"))
    used = observed(F.lit(1.0), F.col("referenced"), F.col("usefulness"))
    narrow = events.select("object_id", "seq", used.alias("used"))
    event = F.struct("seq", (S.EMA_ALPHA * F.col("complete") * F.col("used")).alias("offset"))
    fold_events = F.aggregate("events", _identity(), lambda done, x: _compose(done, _step(x["offset"])))
    fold_pieces = F.aggregate("pieces", _identity(), lambda done, x: _compose(done, x["step"]))

    def folded(rows: DataFrame) -> DataFrame:
        grouped = rows.groupBy("object_id", "segment").agg(F.array_sort(F.collect_list(event)).alias("events"))
        return grouped.select("object_id", "segment", fold_events.alias("step"))

    ordinary, cut = split_by_heat(narrow, "object_id", ["seq", "used"], events_per_task)
    pieces = folded(ordinary.withColumn("segment", F.lit(0)).join(complete, "object_id"))
    if cut is not None:
        # The join brings all segments of an entity together; the exchange after it takes them apart again.
        pieces = pieces.unionByName(folded(cut.join(complete, "object_id").repartition("object_id", "segment")))
    return (
        pieces.groupBy(F.col("object_id").alias("id"))
        .agg(F.array_sort(F.collect_list(F.struct("segment", "step"))).alias("pieces"))
        .select("id", fold_pieces.alias("step"))
    )


def recalibrate_fold(entities: DataFrame, events: DataFrame, events_per_task: int = EVENTS_PER_TASK) -> DataFrame:
    """Apply every event of each entity in order of ``seq``, clamping after each step."""
    folded = folded_events(events, entities, events_per_task)
    step = F.col("step")
    updated = F.least(step["high"], F.greatest(step["low"], step["gain"] * F.col("confidence") + step["offset"]))
    return (
        entities.join(folded, "id", "left")
        .withColumn("confidence", F.when(step.isNotNull(), updated).otherwise(F.col("confidence")))
        .select(*entities.columns)
    )
