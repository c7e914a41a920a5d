"""The physical plans that matter at scale."""

import re

from helpers import day, sessions
from pyspark.sql import functions as F

from trainlake import schemas as S
from trainlake.operators import context, metrics, notes, skew, summary, upsert
from trainlake.session import materialise
from trainlake.sources import readers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def count(df, operator):
    return len(re.findall(rf"\b{operator}\b", plan(df)))


def stored_sessions(spark):
    table = sessions(spark, [(i % 7, str(i), day(i % 30), 400 + i, 600 + i, 140.0 + i % 20) for i in range(300)])
    return materialise(table, "sessions")


def test_metrics_need_one_shuffle_and_one_sort(spark):
    df = metrics.daily_metrics(stored_sessions(spark))
    assert count(df, "Exchange") == 1 and count(df, "Sort") == 1 and count(df, "Window") == 1
    text = plan(df)
    assert "GreaterThanOrEqual(distance_m,500)" in text and "LessThanOrEqual(avg_split_sec,300.0)" in text
    assert "SinglePartition" not in text and "BatchEvalPython" not in text


def test_unused_windows_are_dropped(spark):
    weekly = summary.iso_week_volume(metrics.daily_metrics(stored_sessions(spark)))
    assert count(weekly, "Window") == 0 and count(weekly, "Exchange") == 1
    scanned = re.search(r"ReadSchema: (\S+)", plan(weekly)).group(1)
    assert "duration_sec" not in scanned and "workout_id" not in scanned


def test_date_ranges_reach_the_scan(spark):
    rows = summary.week_rows(stored_sessions(spark).withColumns(
        {"session_type": F.lit("steady"), "fatigue_flag": F.lit("normal"), "weekly_load_min": F.lit(1.0)}
    ), "2024-01-08", "2024-01-10")
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(workout_date", rows._jdf.queryExecution().toString())


def test_ranks_are_cut_before_the_shuffle(spark):
    best = skew.best_rows(stored_sessions(spark), "athlete_id", [F.desc("workout_date")], 3)
    assert plan(best).count("Partial") >= 2
    tips = spark.createDataFrame([], S.TIPS)
    assert "WindowGroupLimit" in plan(notes.recent_tips(tips, 5))


def test_newest_metrics_shuffle_only_cut_rows(spark):
    text = plan(metrics.newest_metrics(stored_sessions(spark)))
    first_exchange = text.rindex("Exchange")
    assert "WindowGroupLimit" in text[first_exchange:]


def test_small_batches_do_not_shuffle_the_stored_side(spark):
    stored = stored_sessions(spark)
    batch = materialise(stored.limit(5).withColumn("ordinal", F.lit(1)), "batch")
    merged = upsert.upsert(stored, batch, ["workout_id"])
    merged.collect()
    text = plan(merged)
    assert "BroadcastHashJoin" in text.split("Initial Plan")[0] and "LeftAnti" in text


def test_a_compacted_table_is_read_without_a_shuffle(spark, tmp_path):
    from trainlake.sources import writers

    path = str(tmp_path / "t")
    writers.write_batch(stored_sessions(spark), path, 5)
    assert "Exchange" not in plan(writers.current_rows(spark, path, ["workout_id"]))
    writers.write_batch(stored_sessions(spark).limit(3), path, 6)
    current = writers.current_rows(spark, path, ["workout_id"])
    current.collect()
    first = plan(current).split("Initial Plan")[0].split("BroadcastQueryStage")[0]
    assert "LeftAnti" in first and "ShuffleQueryStage" not in first


def test_no_text_is_shuffled_for_a_decision(spark, data):
    from trainlake.plans import bindings as B

    offer = B.candidates(spark, data), *context.written(B.requests(spark, data), B.grants(spark, data))
    scored = context.scored_candidates(*offer)
    above_scan = plan(scored).split("FileScan")[0]
    for line in above_scan.splitlines():
        if "Exchange" in line:
            assert "content" not in line
    assert count(scored, "CartesianProduct") == 0 and count(scored, "BroadcastNestedLoopJoin") == 0


def test_decisions_do_not_move_the_scores(spark, data):
    from trainlake.plans import bindings as B

    decided = context.decide(B.candidates(spark, data), B.requests(spark, data), B.grants(spark, data))
    decided.collect()
    assert "Exchange hashpartitioning" not in plan(decided).split("Initial Plan")[0]


def test_log_queries_prune_days(spark, tmp_path):
    from trainlake.operators import quarantine
    from trainlake.sources import writers

    log = spark.createDataFrame([(day(i), "x", "goal_record", "pep_tier_gate", 0.5, None) for i in range(9)], S.EXCLUSION)
    writers.append_exclusions(log, str(tmp_path / "log"))
    stored = spark.read.parquet(str(tmp_path / "log"))
    found = quarantine.query(stored, since="2024-01-08 00:00:00")
    assert found.count() == 2
    assert re.search(r"PartitionFilters: \[.*event_date", found._jdf.queryExecution().toString())


def test_tables_are_read_with_their_schema(spark):
    stored = stored_sessions(spark)
    assert readers.read_or_empty(spark, stored.inputFiles()[0], S.SESSIONS).schema == S.SESSIONS
