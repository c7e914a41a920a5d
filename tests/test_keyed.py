"""Confidence as keyed state: restarts, clamped values, idle entities."""

import json
import random
import time

import numpy as np
import pytest
from helpers import entity

from trainlake import schemas as S
from trainlake.operators import calibration
from trainlake.streaming import keyed, streams

EVENTS = "object_id string, seq long, referenced boolean, usefulness double"


def by_steps(confidence, events):
    for _, value in sorted(events):
        confidence = min(1.0, max(0.0, (1 - S.EMA_ALPHA) * confidence + S.EMA_ALPHA * value))
    return confidence


def test_fold_equals_single_steps():
    rng = random.Random(1)
    for _ in range(300):
        low, high = rng.choice([(0, 1), (-3, 3), (0, 2)])
        events = [(rng.randrange(9), rng.uniform(low, high)) for _ in range(rng.randrange(1, 30))]
        start = rng.choice([0.0, 0.4, 1.0, 1.7])
        seq, values = (np.array(x) for x in zip(*events, strict=True))
        assert keyed.folded(start, seq, values) == pytest.approx(by_steps(start, events), abs=1e-12)


@pytest.fixture
def lake(spark, tmp_path):
    (tmp_path / "landing").mkdir()
    entities = entity(spark, *[{"id": str(i), "confidence": 0.1 * i} for i in range(6)])
    empty = spark.createDataFrame([], EVENTS)
    count = [0]

    def land(*rows):
        count[0] += 1
        lines = [json.dumps(dict(zip(("object_id", "seq", "referenced", "usefulness"), r, strict=True))) for r in rows]
        (tmp_path / "landing" / f"{count[0]}.json").write_text("\n".join(lines))

    def run(known=entities, **options):
        events = streams.landed(spark, str(tmp_path / "landing"), empty.schema)
        keyed.keep_confidence(events, known, str(tmp_path / "store"), str(tmp_path / "progress"), **options).awaitTermination()
        return {r.id: r.confidence for r in streams.current_confidence(spark, entities, str(tmp_path / "store")).collect()}

    return land, run, entities


def test_restarts_go_on_with_the_state(spark, lake):
    land, run, entities = lake
    history = [(str(i % 5), i, i % 3 != 0, (i % 4) / 3) for i in range(60)]
    for k in range(3):
        part = history[20 * k : 20 * (k + 1)]
        random.Random(k).shuffle(part)
        land(*part, ("unknown", 5, True, 1.0))
        found = run()
    at_once = calibration.recalibrate_fold(entities, spark.createDataFrame(history, EVENTS))
    assert found == {r.id: pytest.approx(r.confidence, abs=1e-12) for r in at_once.collect()}


def test_idle_entities_lose_their_state(lake):
    land, run, _ = lake
    land(("1", 1, False, None))
    first = run(idle_hours=1 / 3600)["1"]
    time.sleep(2)
    land(("1", 2, False, None))
    again = run(idle_hours=1 / 3600)["1"]
    assert first == again == pytest.approx(0.07)  # begun anew; a state would have given 0.049
