import pytest
from helpers import entity, rows

from trainlake.operators import quality


def test_nulls(spark):
    table = spark.createDataFrame([(1, "a", "x"), (2, None, "x"), (3, None, None)], "k int, a string, b string")
    assert rows(quality.null_violations(table, ["a", "b"]), ["k", "missing"]) == [(2, "a"), (3, "a,b")]
    assert quality.assert_not_null(table, ["k"]) is table
    with pytest.raises(quality.QualityError, match="required value"):
        quality.assert_not_null(table, ["b"])


def test_keys(spark):
    table = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "k int, a string")
    assert rows(quality.duplicate_keys(table, ["k"])) == [(1, 2)]
    assert quality.assert_unique(table, ["k", "a"]) is table
    with pytest.raises(quality.QualityError, match="not unique"):
        quality.assert_unique(table, ["k"])


def test_entities(spark):
    table = entity(
        spark, {"id": "a"}, {"id": "b", "confidence": 1.0001}, {"id": "c", "confidence": -0.1}, {"id": "d", "tier": "Gold"},
        {"id": "e", "entity_type": "workout"}, {"id": "f", "goal_text": "x"}, {"id": "g", "confidence": 0.0}, {"id": "h", "tier": None},
        {"id": "i", "confidence": None},
    )
    assert rows(quality.rejected_entities(table), ["id", "problem"]) == [
        ("b", "confidence_out_of_range"), ("c", "confidence_out_of_range"), ("d", "unknown_tier"), ("e", "unknown_kind"),
        ("f", "foreign_field"), ("h", "unknown_tier"),
    ]
    assert [r[0] for r in rows(quality.valid_entities(table), ["id"])] == ["a", "g", "i"]
