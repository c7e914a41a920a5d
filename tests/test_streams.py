import json
import re
from datetime import datetime, timedelta

import pytest
from helpers import entity, rows
from pyspark.sql import functions as F

from trainlake import schemas as S
from trainlake.operators import calibration, ingest, metrics, upsert
from trainlake.sources import readers, writers
from trainlake.streaming import streams

START = datetime(2024, 1, 1, 8)


def workout(number, day, distance=2000, athlete=1, time=6000):
    return {
        "id": number, "athlete_id": athlete, "date": (START + timedelta(days=day)).isoformat(), "distance": distance, "time": time
    }


class Landing:
    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, folder, 0
        (folder / "landing").mkdir()

    def path(self, name):
        return str(self.folder / name)

    def land(self, *objects):
        self.n += 1
        (self.folder / "landing" / f"{self.n}.json").write_text("\n".join(json.dumps(o, default=str) for o in objects))

    def workouts(self):
        return streams.workout_stream(self.spark, self.path("landing"))


@pytest.fixture
def landing(spark, tmp_path):
    return Landing(spark, tmp_path)


def stored(landing):
    found = writers.current_rows(landing.spark, landing.path("sessions"), ["workout_id"])
    return {r.workout_id: r.distance_m for r in found.collect()}


def sync(landing, **options):
    query = streams.sync_sessions(landing.workouts(), landing.path("sessions"), landing.path("progress"), **options)
    query.awaitTermination()


def test_repeated_workouts_keep_the_last_version(landing):
    landing.land({"data": [workout(1, 0), workout(2, 1), workout(1, 0, 2100)]}, {"meta": "no data"})
    sync(landing)
    landing.land({"data": [workout(2, 1, 2200), workout(3, 2)]})
    sync(landing)
    assert stored(landing) == {"1": 2100, "2": 2200, "3": 2000}


def test_intervals_are_kept_too(landing):
    parts = lambda *seconds: {"intervals": [{"distance": 250, "time": s, "spm": 20} for s in seconds]}
    landing.land({"data": [{**workout(1, 0), **parts(60, 61, 62)}, workout(2, 0)]})
    sync(landing, intervals=landing.path("intervals"))
    landing.land({"data": [{**workout(1, 0), **parts(70)}]})
    sync(landing, intervals=landing.path("intervals"))
    found = writers.current_rows(landing.spark, landing.path("intervals"), ["interval_id"])
    assert rows(found, ["interval_id", "work_duration_sec"]) == [("1_0", 70.0), ("1_1", 61.0), ("1_2", 62.0)]


def test_old_workouts_are_not_taken_in_again(landing):
    landing.land({"data": [workout(1, 0), workout(2, 10), {**workout(9, 0), "date": "?"}]})
    sync(landing)
    landing.land({"data": [workout(1, 0, 2100), workout(2, 10, 2200), workout(4, 7), workout(5, 6), {**workout(8, 0), "date": "?"}]})
    sync(landing)
    assert stored(landing) == {"1": 2000, "2": 2200, "4": 2000, "9": 2000}


def test_a_repeated_batch_changes_nothing(landing):
    spark, table = landing.spark, landing.path("sessions")
    batch = lambda *w: spark.createDataFrame(
        [(START + timedelta(days=20), "f", 0, *[str(x[n]) if n == "id" else x.get(n) for n in S.RAW_WORKOUT.fieldNames()[:4]], float(x["time"]), None) for x in w],
        "landed_at timestamp_ntz, file string, block long, id string, athlete_id long, date string, distance int, time double,"
        " intervals array<struct<distance:int,time:double,spm:int>>",
    )
    streams._store_sessions(batch(workout(1, 0), workout(2, 9)), 0, table, 3)
    for _ in range(3):
        streams._store_sessions(batch(workout(1, 0, 5), workout(2, 9, 2200)), 1, table, 3)
    assert stored(landing) == {"1": 2000, "2": 2200}
    assert spark.read.parquet(table).count() == 3


def test_metrics_follow_late_and_changed_workouts(landing):
    """After every arrival the derived table equals a full rebuild."""
    arrivals = [
        [workout(i, i, 2000 + 10 * i, athlete=i % 2, time=6000 + 37 * i) for i in range(0, 24, 2)],
        [workout(i, i, 2000 + 10 * i, athlete=i % 2, time=6000 + 37 * i) for i in range(1, 24, 4)],  # late
        [workout(4, 4, 400, athlete=0), workout(6, 30, 2600, athlete=0, time=7000)],  # no longer eligible; moved
        [workout(4, 5, 2500, athlete=0)],  # eligible again
        [workout(99, 3, 3000, athlete=7)],
        [{**workout(8, 8, 2700, athlete=0), "date": "?"}],  # its date is lost: now the last one
        [{**workout(50, 8, 2750, athlete=0), "date": "?"}],
        [workout(23, 23, 2230, athlete=0, time=6851)],  # moved to another athlete
    ]
    for arrival in arrivals:
        landing.land({"data": arrival})
        query = streams.sync_metrics(
            landing.workouts(), landing.path("sessions"), landing.path("derived"), landing.path("progress"), replay_days=None
        )
        query.awaitTermination()
        current = writers.current_rows(landing.spark, landing.path("sessions"), ["workout_id"])
        derived = streams.current_metrics(landing.spark, landing.path("derived"))
        assert rows(derived) == rows(metrics.daily_metrics(current).select(*derived.columns))


def test_exclusion_log_keeps_its_retention(landing):
    as_of = datetime(2024, 2, 10, 12)
    record = lambda name, age: {"timestamp": (as_of - timedelta(days=age)).isoformat(), "object_id": name,
                                "entity_type": "goal_record", "reason_code": "pep_tier_gate", "priority_score": 0.5}
    for batch in ([record("a", 0), record("b", 30), record("c", 30.2)], [record("d", 31), record("e", 30), record("f", 1)]):
        landing.land(*batch)
        records = streams.exclusion_stream(landing.spark, landing.path("landing"))
        streams.keep_exclusion_log(records, landing.path("log"), landing.path("progress"), as_of).awaitTermination()
    found = readers.read_table(landing.spark, landing.path("log"), S.EXCLUSION)
    assert [r[0] for r in rows(found, ["object_id"])] == ["a", "b", "e", "f"]


def test_confidence_equals_one_fold_over_everything(landing, spark):
    entities = entity(spark, *[{"id": str(i), "confidence": 0.1 * i} for i in range(6)])
    schema = "object_id string, seq long, referenced boolean, usefulness double"
    history = [(str(i % 5), i, i % 3 != 0, (i % 4) / 3) for i in range(60)]
    for k in range(3):
        part = history[20 * k: 20 * (k + 1)]
        landing.land(*[dict(zip(("object_id", "seq", "referenced", "usefulness"), e)) for e in part])
        events = streams.landed(spark, landing.path("landing"), spark.createDataFrame([], schema).schema)
        streams.update_confidence(events, entities, landing.path("store"), landing.path("progress")).awaitTermination()
    streamed = streams.current_confidence(spark, entities, landing.path("store"))
    at_once = calibration.recalibrate_fold(entities, spark.createDataFrame(history, schema))
    found = lambda df: {r.id: pytest.approx(r.confidence, abs=1e-12) for r in df.collect()}
    assert {r.id: r.confidence for r in streamed.collect()} == found(at_once)


def test_stream_equals_batch(landing):
    items = [workout(i, i % 9, 1000 + i, athlete=i % 3) for i in range(40)]
    landing.land({"data": items})
    sync(landing)
    raw = readers.read_raw_workouts(landing.spark, landing.path("landing"))
    streamed = writers.current_rows(landing.spark, landing.path("sessions"), ["workout_id"])
    assert rows(streamed) == rows(ingest.normalise(raw).select(*streamed.columns))
    assert streamed.where(F.col("workout_date").isNull()).count() == 0


def test_one_wrong_date_stops_nobody(landing):
    """A date after the landing moves no mark, and each athlete has its own; what comes too late is kept."""
    landing.land({"data": [workout(1, 0), {**workout(2, 0, athlete=2), "date": "2199-01-01T00:00:00"}, workout(3, 40, athlete=3)]})
    sync(landing)
    landing.land({"data": [workout(4, 1), workout(5, 2), workout(6, 1, athlete=2), workout(7, 1, athlete=3), workout(8, -9), workout(9, 0, athlete=4),
                           {**workout(10, 0), "date": "?"}]})
    sync(landing)
    assert set(stored(landing)) == {"1", "2", "3", "4", "5", "6", "9"}
    late = streams.late_workouts(landing.spark, landing.path("sessions"))
    assert rows(late, ["id", "late"]) == [("10", "no_date"), ("7", "before_limit"), ("8", "before_limit")]


def test_a_mark_never_moves_back(landing):
    for days in ((10,), (8,), (9, 6)):
        landing.land({"data": [workout(100 + d, d) for d in days]})
        sync(landing)
    assert set(stored(landing)) == {"110", "108", "109"}
    writers.compact(landing.spark, landing.path("sessions") + "_marks", ["source_name", "athlete_id"])
    landing.land({"data": [workout(1, 6)]})
    sync(landing)
    assert [r.id for r in streams.late_workouts(landing.spark, landing.path("sessions")).collect()] == ["106", "1"]


def test_lines_that_cannot_be_read_are_kept(landing):
    (landing.folder / "landing" / "odd.json").write_text(
        '{"data": [{"id": 1, "athlete_id": 1, "time": 9, "distance": 600}]}\n{"data": [{"id": 2,\n\n[]\nnonsense\n{"data": 5}\n{"meta": 1}\n'
    )
    sync(landing)
    assert set(stored(landing)) == {"1"}
    found = streams.corrupt_lines(landing.spark, landing.path("sessions"))
    assert {r.corrupt for r in found.collect()} >= {'{"data": [{"id": 2,', "nonsense", '{"data": 5}'}
    assert all(r.file.endswith("odd.json") for r in found.collect())


def test_future_records_empty_no_log(landing):
    record = lambda name, time: {"timestamp": time, "object_id": name, "entity_type": "goal_record",
                                 "reason_code": "pep_tier_gate", "priority_score": 0.5}
    now = datetime.now()
    days = lambda n: (now - timedelta(days=n)).isoformat()
    for batch in ([record("a", days(1)), record("b", days(2))], [record("c", "2199-01-01T00:00:00"), record("d", days(40))], []):
        landing.land(*batch)
        records = streams.exclusion_stream(landing.spark, landing.path("landing"))
        streams.keep_exclusion_log(records, landing.path("log"), landing.path("progress")).awaitTermination()
    log = readers.read_table(landing.spark, landing.path("log"), S.EXCLUSION)
    assert [r[0] for r in rows(log, ["object_id"])] == ["a", "b"]
    assert [r.object_id for r in streams.future_exclusions(landing.spark, landing.path("log")).collect()] == ["c"]


def pruned(df):
    """Every scan of the plan opens some buckets only."""
    scans = re.findall(r"FileScan .*", df._jdf.queryExecution().executedPlan().toString())
    return bool(scans) and all("PartitionFilters: [bucket" in scan or "IN (" in scan.split("PartitionFilters: ")[1][:40] for scan in scans)


def test_a_batch_reads_the_buckets_of_its_athletes_only(landing, spark):
    derived, buckets = landing.path("derived"), 16

    def run():
        query = streams.sync_metrics(landing.workouts(), landing.path("sessions"), derived, landing.path("progress"), None, buckets=buckets)
        query.awaitTermination()

    landing.land({"data": [workout(100 * a + i, i, 2000 + 10 * i, athlete=a, time=6000 + 37 * i) for a in range(40) for i in range(4)]})
    run()
    landing.land({"data": [workout(702, 2, 2900, athlete=7), workout(903, 3, 2500, athlete=8)]})  # the second moves from 9 to 8
    run()
    touched = writers.touched_buckets(spark, f"{derived}_history", 1)
    bucket = lambda *keys: {r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(writers.bucket_of(F.col("k"), buckets)).collect()}
    assert set(touched) == bucket("7", "8", "9") == set(writers.touched_buckets(spark, derived, 1))
    assert len(writers.touched_buckets(spark, f"{derived}_history", 0)) > 10
    assert len(writers.touched_buckets(spark, f"{derived}_places", 1)) <= 2
    rows_read = writers.current_rows(spark, f"{derived}_history", streams.HISTORY_KEYS, 1, touched)
    assert pruned(rows_read)
    current = writers.current_rows(spark, landing.path("sessions"), ["workout_id"])
    assert rows(streams.current_metrics(spark, derived)) == rows(metrics.daily_metrics(current))
    few = streams.current_metrics(spark, derived, [8, 9], buckets)
    assert rows(few) == rows(metrics.daily_metrics(current.where("athlete_id in (8, 9)")))
    assert pruned(few) and not pruned(streams.current_metrics(spark, derived))
    with pytest.raises(ValueError):
        writers.write_batch(current.withColumn("athlete_key", F.lit("")), derived, 9, "athlete_key", 8)


def test_buckets_stay_complete_when_batches_are_folded(landing, spark):
    """Moved, ineligible and unknown athletes, with every table folded after each batch."""
    derived = landing.path("derived")
    arrivals = [
        [workout(i, i, 2000 + 10 * i, athlete=i % 3, time=6000 + 37 * i) for i in range(12)],
        [workout(4, 4, 2000, athlete=2), {**workout(5, 5, 2000), "athlete_id": None}],
        [workout(4, 4, 2000, athlete=0), workout(7, 7, 100, athlete=1)],
        [{**workout(5, 6, 2100), "athlete_id": None}, workout(7, 7, 2200, athlete=2), workout(4, 4, 2050, athlete=2)],
    ]
    for arrival in arrivals:
        landing.land({"data": arrival})
        query = streams.sync_metrics(landing.workouts(), landing.path("sessions"), derived, landing.path("progress"), None, buckets=4)
        query.awaitTermination()
        for path, keys, by in ((derived, streams.HISTORY_KEYS, "athlete_key"), (f"{derived}_history", streams.HISTORY_KEYS, "athlete_key"),
                               (f"{derived}_places", ["workout_id"], "workout_id")):
            writers.compact(spark, path, keys, by, 4)
        current = writers.current_rows(spark, landing.path("sessions"), ["workout_id"])
        assert rows(streams.current_metrics(spark, derived)) == rows(metrics.daily_metrics(current))


def test_a_few_batches_are_read_without_grouping(landing, spark):
    """Moved, ineligible and unknown athletes in a first batch and two later ones, which are only filtered."""
    derived = landing.path("derived")
    arrivals = [
        [*[workout(i, i, 2000 + 10 * i, athlete=i % 3, time=6000 + 37 * i) for i in range(12)], workout(20, 1, 100), workout(20, 2, 90)],
        [workout(4, 4, 2000, athlete=2), {**workout(5, 5, 2000), "athlete_id": None}, workout(20, 2, 2400)],
        [workout(4, 4, 2000, athlete=0), workout(7, 7, 100, athlete=1), {**workout(5, 6, 2100), "athlete_id": None}],
    ]
    for arrival in arrivals:
        landing.land({"data": arrival})
        query = streams.sync_metrics(landing.workouts(), landing.path("sessions"), derived, landing.path("progress"), None, buckets=4)
        query.awaitTermination()
        current = writers.current_rows(spark, landing.path("sessions"), ["workout_id"])
        assert rows(streams.current_metrics(spark, derived)) == rows(metrics.daily_metrics(current))
    plan = streams.current_metrics(spark, derived)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "LeftAnti" in plan
    for path in (derived, f"{derived}_history"):
        plain = writers.current_rows(spark, path, streams.HISTORY_KEYS)
        assert rows(writers.current_rows(spark, path, streams.HISTORY_KEYS, distinct=True), plain.columns) == rows(plain, plain.columns)


def test_newest_version_moves_wanted_columns_only(spark):
    table = spark.createDataFrame([("a", 1, "x" * 9, 1), ("a", 2, "y" * 9, 3), ("b", 3, "z" * 9, 2)], "id string, v int, file string, line int")
    found = upsert.latest_by_key(table, ["id"], ["file", "line"], ["id", "v"])
    assert found.columns == ["id", "v"] and rows(found) == [("a", 2), ("b", 3)]
