import json
from datetime import date, datetime

import pytest
from helpers import rows
from pyspark.sql import functions as F

from trainlake import schemas as S
from trainlake.session import materialise, new_path, shuffle_partitions, temporary_tables, work_folder
from trainlake.sources import readers, writers


def test_work_folder_is_the_one_the_session_names(spark):
    assert work_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert new_path(spark, "x") != new_path(spark, "x")
    table = materialise(spark.range(5), "x")
    assert table.count() == 5 and work_folder(spark) in table.inputFiles()[0]


def test_temporary_tables_are_removed_at_the_end(spark):
    kept = materialise(spark.range(3), "kept")
    with temporary_tables(spark):
        path = materialise(spark.range(5), "inner").inputFiles()[0]
        assert readers.path_exists(spark, path)
    assert not readers.path_exists(spark, path) and kept.count() == 3


def test_shuffles_are_sized_by_the_data():
    assert shuffle_partitions(10**6, 8) == 16
    assert shuffle_partitions(100 * 1024**4, 4000) == 100 * 1024**4 // (128 * 1024**2)


def test_pages_of_workouts(spark, tmp_path):
    pages = [
        {"data": [{"id": 1, "date": "2024-01-05", "distance": 500, "time": 1200, "intervals": [{"distance": 250, "time": 60, "spm": 20}]},
                  {"id": 2, "other": {"x": 1}}]},
        {"data": []}, {"meta": 1},
    ]
    (tmp_path / "a.json").write_text("\n".join(json.dumps(p) for p in pages))
    found = readers.read_raw_workouts(spark, str(tmp_path))
    assert rows(found, ["id", "distance", "time"]) == [("1", 500, 1200.0), ("2", None, None)]
    assert found.schema == S.RAW_WORKOUT


def test_absent_tables_are_empty_and_broken_ones_are_errors(spark, tmp_path):
    assert readers.read_or_empty(spark, str(tmp_path / "none"), S.TIPS).collect() == []
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        readers.read_or_empty(spark, str(tmp_path / "bad"), S.TIPS).collect()


def test_snapshots(spark, tmp_path):
    schema = S.struct("insight STRING, n INT")
    (tmp_path / "whole.json").write_text('{\n "insight": "ok",\n "n": 1\n}')
    (tmp_path / "lines.json").write_text('{"insight": "a"}\n{"insight": \n{"n": 2}')
    read = lambda name, **k: rows(readers.read_snapshot(spark, str(tmp_path / name), schema, **k))
    assert read("whole.json", one_object_per_file=True) == [("ok", 1)]
    assert read("lines.json") == [("a", None), (None, 2), (None, None)]
    assert read("none.json") == []
    path = str(tmp_path / "written")
    writers.write_snapshot(spark.createDataFrame([("x", None)], schema), path)
    assert rows(readers.read_snapshot(spark, path, schema)) == [("x", None)]
    text = "".join(f.read_text() for f in (tmp_path / "written").glob("*/*.json"))
    assert json.loads(text) == {"insight": "x", "n": None}


def test_logs_skip_bad_lines(spark, tmp_path):
    good = {"timestamp": "2024-01-05T10:00:00.25+00:00", "object_id": "a", "reason_code": "r", "extra": {"n": 1, "mode": "m"}}
    (tmp_path / "log.jsonl").write_text("\n".join(
        ["", json.dumps(good), "oops", "  ", '{"object_id": "b"', json.dumps({**good, "object_id": "c"}),
         json.dumps({**good, "object_id": "d", "timestamp": "once"})]))
    found = readers.read_exclusion_lines(spark, str(tmp_path / "log.jsonl"))
    moment, extra = datetime(2024, 1, 5, 10, 0, 0, 250000), {"n": "1", "mode": "m"}
    assert [(r.object_id, r.timestamp, r.extra) for r in found.orderBy("object_id").collect()] == [
        ("a", moment, extra), ("c", moment, extra), ("d", None, extra)
    ]
    assert found.count() == 3
    assert readers.read_exclusion_lines(spark, str(tmp_path / "none")).count() == 0


def test_briefs(spark, tmp_path):
    path = str(tmp_path / "briefs")
    briefs = lambda *r: spark.createDataFrame(list(r), S.BRIEFS)
    writers.write_briefs(briefs((1, date(2024, 1, 5), "five"), (2, date(2024, 1, 5), "other"), (1, date(2024, 1, 7), "seven")), path)
    writers.write_briefs(briefs((1, date(2024, 1, 7), " again ")), path)
    stored = writers.stored_briefs(spark, path)
    found = lambda day: rows(readers.latest_briefs(stored, day), ["athlete_id", "brief_text"])
    assert found("2024-01-06") == [(1, "five"), (2, "other")]
    assert found("2024-01-07") == [(1, "again"), (2, "other")]
    assert found("2024-01-01") == []


def test_tips_without_a_text_are_refused(spark, tmp_path):
    tips = spark.createDataFrame([("t", 1, datetime(2024, 1, 1), None, "coach", None, None, None, False)], S.TIPS)
    with pytest.raises(ValueError):
        writers.append_tips(tips, str(tmp_path / "tips"))


def test_batches_replace_themselves_and_compact(spark, tmp_path):
    path = str(tmp_path / "t")
    batch = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    writers.write_batch(batch(("a", 1), ("b", 1)), path, 0)
    writers.write_batch(batch(("a", 9)), path, 1)
    writers.write_batch(batch(("a", 2), ("c", 2)), path, 1)  # the batch is repeated
    now = lambda: rows(writers.current_rows(spark, path, ["k"]), ["k", "v"])
    assert now() == [("a", 2), ("b", 1), ("c", 2)]
    folders = lambda: sorted(p.name for p in (tmp_path / "t").iterdir())
    for number in (2, 3):
        writers.compact(spark, path, ["k"])
        writers.write_batch(batch(("b", number + 1)), path, number)
        assert now() == [("a", 2), ("b", number + 1), ("c", 2)]
    # batch 2 is folded with the next base; the batches that the first base replaced are gone
    assert folders() == ["base_id=0", "base_id=1", "batch_id=1", "batch_id=2", "batch_id=3"]
    writers.write_batch(batch(("a", 7)), path, 3)  # the newest batch is repeated after folding
    assert now() == [("a", 7), ("b", 3), ("c", 2)] and writers.next_batch(spark, path) == 4
    with pytest.raises(ValueError):
        writers.stored_rows(spark, path, up_to=0)


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    frame = lambda *r: spark.createDataFrame(list(r), "athlete_id long, v int")
    writers.write_snapshot(frame((1, 1), (2, 1)), path)
    broken = frame((1, 2)).withColumn("v", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception):
        writers.write_snapshot(broken, path)
    found = lambda: rows(readers.read_snapshot(spark, path, frame().schema))
    assert found() == [(1, 1), (2, 1)]
    writers.write_snapshot(frame((2, 5)), path, ("athlete_id",))
    assert found() == [(1, 1), (2, 5)]
    writers.write_snapshot(frame((3, 3)), path)
    assert found() == [(3, 3)]


def test_metrics_are_replaced_by_month(spark, tmp_path):
    path = str(tmp_path / "metrics")
    row = lambda moment: (1, "a", moment, 150.0, 600, 2000, None, None, 150.0, None, 10.0, "steady", "normal")
    writers.rebuild_metrics(spark.createDataFrame([row(datetime(2024, 1, 5)), row(datetime(2024, 2, 5))], S.METRICS), path)
    assert sorted(p.name for p in (tmp_path / "metrics").glob("*/month=*")) == ["month=2024-01", "month=2024-02"]
    writers.rebuild_metrics(spark.createDataFrame([row(datetime(2024, 3, 5))], S.METRICS), path)
    assert readers.read_version(spark, path, S.METRICS).count() == 1
