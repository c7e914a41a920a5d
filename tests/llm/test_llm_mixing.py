import random
from collections import Counter
from fractions import Fraction

import pytest
from corpus import hard, hard_rows, none

from trainlake.llm.pfair_mixing import mixed, mixing_stage, period


def earliest_deadline_first(weights):
    total, done, order = sum(weights), [0] * len(weights), []
    for slot in range(total):
        ready = [(-(-(n + 1) * total // w), i) for i, (n, w) in enumerate(zip(done, weights)) if n * total // w <= slot]
        order.append(min(ready)[1])
        done[order[-1]] += 1
    return order


@pytest.mark.parametrize("weights", [[1], [1, 1], [4, 3, 3, 2, 2, 1], [97, 2, 1], [5, 7, 11, 13]])
def test_period_follows_the_rule_and_stays_within_a_block(spark, weights):
    order = period(spark, weights)
    assert order == earliest_deadline_first(weights)
    for t in range(1, len(order) + 1):
        taken = Counter(order[:t])
        assert all(abs(taken[i] - Fraction(t * w, len(order))) < 1 for i, w in enumerate(weights))


def test_every_block_is_placed_between_release_and_deadline(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randrange(200), rng.choice("aaaaabbc"), "en", 1, "", 0, "", 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, hard(spark).schema)
    found = mixed(docs, {"a": 2, "b": 5}, block_chars=500, part_rows=100).select("row.doc_id", "row.source", "phase", "block", "slot", "release", "deadline", "start").collect()
    assert sorted(r.doc_id for r in found) == list(range(3000))
    assert all(r.release <= r.slot < r.deadline for r in found)
    slots = {(r.source, r.block): r.slot for r in found}
    assert len(set(slots.values())) == len(slots)  # no slot is used twice
    phase = [r for r in found if r.phase == 0]
    end = max(r.slot for r in phase) + 1
    for t in (end // 3, end // 2, end):
        taken = Counter(s for s, slot in {(r.source, r.slot) for r in phase} if slot < t)
        assert all(abs(taken[s] - t * w / 8) < 1 for s, w in {"a": 2, "b": 5, "c": 1}.items())
    by_source = {}
    for r in found:
        by_source.setdefault(r.source, []).append((r.start, r.block, r.slot))
    for rows in by_source.values():  # the order within a source follows its blocks
        rows.sort()
        assert [b for _, b, _ in rows] == sorted(b for _, b, _ in rows) and [s for _, _, s in rows] == sorted(s for _, _, s in rows)


def test_stage_keeps_all_rows_and_columns(spark, data):
    docs = hard(spark)
    found = mixing_stage(spark, docs, data)
    assert found.columns == docs.columns
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, docs.collect()))
    assert len(found.collect()) == len(hard_rows())
    assert mixing_stage(spark, none(spark), data).count() == 0


def test_bad_weights_are_refused(spark):
    with pytest.raises(ValueError):
        period(spark, [0, 1])
    with pytest.raises(ValueError):
        period(spark, [30000])


def test_any_number_of_sources(spark):
    """Sources without a weight of their own are scheduled as a class; everything is placed, shares hold for the class."""
    rng = random.Random(6)
    names = ["a"] * 900 + ["b"] * 900 + [f"host{i}" for i in range(400)] * 3 + [None] * 5
    rows = [(i, "x" * rng.randrange(50, 150), s, "en", 1, "", 0, "", 0) for i, s in enumerate(names)]
    docs = spark.createDataFrame(rows, hard(spark).schema)
    found = mixed(docs, {"a": 401, "b": 802}, block_chars=500, part_rows=100).select("row.doc_id", "source_key", "phase", "slot", "release", "deadline").collect()
    assert sorted(r.doc_id for r in found) == list(range(len(names)))
    assert {r.source_key for r in found} == {"=a", "=b", "others"} and all(r.release <= r.slot < r.deadline for r in found)
    phase = {(r.source_key, r.slot) for r in found if r.phase == 0}
    end = max(slot for _, slot in phase) + 1
    taken = Counter(s for s, _ in phase)
    assert all(abs(taken[s] - end * w / 1604) < 1 for s, w in {"=a": 401, "=b": 802, "others": 401}.items())
    large = mixed(docs, {"a": 1}, default_weight=1000, block_chars=500, part_rows=100).select("row.doc_id").collect()
    assert sorted(r.doc_id for r in large) == list(range(len(names)))
    with pytest.raises(ValueError):
        mixed(docs, {f"host{i}": 1 for i in range(300)})
