import random
import re

import pandas as pd
import pytest
from helpers import entity
from pyspark.sql import functions as F

from trainlake.operators import calibration

EVENT = "object_id string, seq long, referenced boolean, usefulness double"


def confidence(df):
    return {r.id: r.confidence for r in df.collect()}


def test_first_confidence_is_completeness(spark):
    table = entity(spark, {"id": "a", "confidence": None, "content": ""}, {"id": "b", "confidence": 0.3})
    assert confidence(calibration.with_initial_confidence(table)) == {
        "a": pytest.approx(5 / 6), "b": 0.3
    }


def test_one_event_per_entity(spark):
    table = entity(
        spark, {"id": "used", "confidence": 0.5}, {"id": "unused", "confidence": 0.5}, {"id": "part", "confidence": 0.5, "content": ""},
        {"id": "none", "confidence": 0.5}, {"id": "default", "confidence": 0.5},
    )
    events = spark.createDataFrame(
        [("used", 1, True, 1.0), ("unused", 1, False, 1.0), ("part", 1, True, 0.5), ("other", 1, True, 1.0), ("default", 1, True, None)], EVENT
    )
    assert confidence(calibration.recalibrate_batch(table, events)) == pytest.approx(
        {"used": 0.65, "unused": 0.35, "part": 0.7 * 0.5 + 0.3 * 5 / 6 * 0.5, "none": 0.5, "default": 0.65}
    )


def test_of_several_events_the_last_counts(spark):
    events = spark.createDataFrame([("p1", 2, True, 1.0), ("p1", 1, False, 1.0)], EVENT)
    updated = calibration.recalibrate_batch(entity(spark, {"confidence": 0.5}), events)
    assert confidence(updated) == {"p1": pytest.approx(0.65)}
    assert updated.columns == entity(spark).columns


def test_scorers_are_clamped(spark):
    table = entity(spark, {"id": "a", "confidence": 0.9}, {"id": "b", "confidence": 0.1})
    events = spark.createDataFrame([("a", 1, True, 1.0), ("b", 1, True, 1.0)], EVENT)
    stretch = lambda c, complete, referenced, usefulness: c * 4 - 1
    assert confidence(calibration.recalibrate_batch(table, events, stretch)) == {"a": 1.0, "b": 0.0}

    @F.pandas_udf("double")
    def halved(c: pd.Series, complete: pd.Series, referenced: pd.Series, usefulness: pd.Series) -> pd.Series:
        return c / 2 + complete * 0

    assert confidence(calibration.recalibrate_batch(table, events, halved)) == {"a": 0.45, "b": 0.05}


@pytest.mark.parametrize("events_per_task", [7, 50, 10_000])
def test_history_is_folded_in_order_with_clamps(spark, events_per_task):
    """Values outside [0, 1] make the clamps act; one entity has most events."""
    generator = random.Random(5)
    history = [
        (generator.choice(["hot", "hot", "hot", "b", "c"]), i, generator.random() < 0.7, generator.choice([-4.0, 0.2, 0.9, 6.0]))
        for i in range(400)
    ]
    start = {"hot": 0.4, "b": 0.9, "c": 0.1, "quiet": 0.6}
    table = entity(spark, *[{"id": k, "confidence": v, "content": "" if k == "b" else "x"} for k, v in start.items()])
    shuffled = history[:]
    generator.shuffle(shuffled)
    events = spark.createDataFrame(shuffled, EVENT).repartition(5)
    expected = dict(start)
    for name, _, referenced, usefulness in history:
        complete = 5 / 6 if name == "b" else 1.0
        value = 0.7 * expected[name] + 0.3 * complete * (usefulness if referenced else 0.0)
        expected[name] = max(0.0, min(1.0, value))
    assert confidence(calibration.recalibrate_fold(table, events, events_per_task)) == pytest.approx(expected, abs=1e-12)


def test_segments_of_a_hot_entity_stay_apart_after_the_join(spark):
    events = spark.createDataFrame([("p1", i, True, 0.5) for i in range(300)], "object_id string, seq long, referenced boolean, usefulness double")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = calibration.folded_events(events, entity(spark), 50)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert re.search(r"hashpartitioning\(object_id#\d+, segment#\d+, \d+\), REPARTITION_BY_COL", plan)
