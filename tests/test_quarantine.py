from datetime import datetime, timedelta

import pytest
from helpers import rows

from trainlake import schemas as S
from trainlake.operators import quarantine
from trainlake.sources import readers, writers

AS_OF = datetime(2024, 2, 10, 12)


def log(spark, *items):
    base = {"object_id": "x", "entity_type": "session_note", "reason_code": "pep_tier_gate", "priority_score": 0.5, "timestamp": AS_OF}
    return spark.createDataFrame([tuple({**base, **i}.get(n) for n in S.EXCLUSION.fieldNames()) for i in items], S.EXCLUSION)


def aged(spark):
    ages = {"new": 0, "edge": 30, "same day": 30 + 1 / 24, "old": 31, "older": 90}
    items = [{"object_id": k, "timestamp": AS_OF - timedelta(days=v)} for k, v in ages.items()]
    return log(spark, *items, {"object_id": "undated", "timestamp": None})


def names(df):
    return [r[0] for r in rows(df, ["object_id"])]


def test_unknown_reasons_are_errors(spark, tmp_path):
    with pytest.raises(Exception, match="unknown reason code: mood"):
        writers.append_exclusions(log(spark, {"reason_code": "mood"}), str(tmp_path / "log"))
    writers.append_exclusions(log(spark, *[{"reason_code": r} for r in S.REASON_CODES]), str(tmp_path / "good"))
    assert readers.read_table(spark, str(tmp_path / "good"), S.EXCLUSION).count() == 4


def test_query(spark):
    table = log(
        spark, {"object_id": "a"}, {"object_id": "b", "reason_code": "budget_truncation"}, {"object_id": "c", "entity_type": "goal_record"},
        {"object_id": "d", "timestamp": AS_OF - timedelta(days=2)}, {"object_id": "e", "timestamp": None},
    )
    assert names(quarantine.query(table)) == ["a", "b", "c", "d", "e"]
    assert names(quarantine.query(table, reason_code="budget_truncation")) == ["b"]
    assert names(quarantine.query(table, entity_type="goal_record")) == ["c"]
    assert names(quarantine.query(table, since=AS_OF - timedelta(days=1))) == ["a", "b", "c"]
    assert names(quarantine.query(quarantine.with_event_date(table), since=AS_OF)) == ["a", "b", "c"]


def test_retention(spark):
    assert names(quarantine.retained(aged(spark), AS_OF)) == ["edge", "new", "undated"]


def test_stored_log_is_pruned(spark, tmp_path):
    path = str(tmp_path / "log")
    writers.append_exclusions(aged(spark), path)
    writers.prune_exclusions(spark, path, AS_OF)
    stored = lambda: names(readers.read_table(spark, path, S.EXCLUSION))
    assert stored() == ["edge", "new", "undated"]
    folders = sorted(p.name for p in (tmp_path / "log").iterdir() if p.is_dir())
    assert folders == ["event_date=2024-01-11", "event_date=2024-02-10", "event_date=__HIVE_DEFAULT_PARTITION__"]
    writers.prune_exclusions(spark, path, AS_OF + timedelta(minutes=1))  # empties the boundary day
    assert stored() == ["new", "undated"]
    writers.prune_exclusions(spark, path, AS_OF + timedelta(minutes=1))
    assert stored() == ["new", "undated"]
    writers.prune_exclusions(spark, str(tmp_path / "absent"), AS_OF)


def test_a_log_that_expired_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "log")
    writers.append_exclusions(log(spark, {"timestamp": AS_OF - timedelta(days=50)}), path)
    for _ in range(2):
        writers.prune_exclusions(spark, path, AS_OF)
    assert readers.read_table(spark, path, S.EXCLUSION).count() == 0
    writers.append_exclusions(log(spark, {"object_id": "next"}), path)
    assert names(readers.read_table(spark, path, S.EXCLUSION)) == ["next"]


def test_counts(spark):
    table = log(spark, {}, {}, {"reason_code": "budget_truncation", "timestamp": None})
    assert rows(quarantine.counts(table), ["reason_code", "event_date", "n_records"]) == [
        ("budget_truncation", None, 1), ("pep_tier_gate", AS_OF.date(), 2)
    ]
