import json
from datetime import date

import pytest
from helpers import day, rows, sessions
from pyspark.sql import functions as F

from trainlake import schemas as S
from trainlake.operators import metrics, recovery

FULL = {
    "battery_doc": [{"charged": 20}, {"charged": 72}],
    "hrv_doc": {"hrvSummary": {"status": "BALANCED"}},
    "sleep_doc": {"dailySleepDTO": {"sleepScores": {"overall": {"value": 81}}}},
    "heart_rate_doc": {"allMetrics": {"metricsMap": {"WELLNESS_RESTING_HEART_RATE": [{"value": 52.0}, {"value": 1}]}}},
    "stress_doc": {"overallStressLevel": 28},
    "readiness_doc": [{"score": 85}, {"score": 1}],
}
SIGNALS = ["body_battery", "hrv_status", "sleep_score", "resting_hr", "stress", "readiness"]
VALUES = (72, "BALANCED", 81, 52, 28, 85)


def extracted(spark, **changes):
    documents = {k: json.dumps(v) for k, v in FULL.items()} | changes
    row = (1, date(2024, 1, 1), *[documents[n] for n in S.RAW_RECOVERY.fieldNames()[2:]])
    return tuple(recovery.extract_signals(spark.createDataFrame([row], S.RAW_RECOVERY)).select(*SIGNALS).first())


def test_all_signals(spark):
    assert extracted(spark) == VALUES


@pytest.mark.parametrize("broken", [None, "", "[]", "{}", "{", "null", "17"])
@pytest.mark.parametrize("position", range(6))
def test_one_bad_document_hides_one_signal(spark, broken, position):
    document = S.RAW_RECOVERY.fieldNames()[2 + position]
    expected = tuple(None if i == position else v for i, v in enumerate(VALUES))
    assert extracted(spark, **{document: broken}) == expected


def daily(spark, n=9):
    return spark.createDataFrame(
        [(1, date(2024, 1, 1 + i), 65 + 5 * i, "LOW", 60 + i, 50, 99 + i, None) for i in range(n)],
        S.struct("athlete_id BIGINT, record_date DATE, body_battery INT, hrv_status STRING, sleep_score INT,"
                 " resting_hr INT, stress INT, readiness INT"),
    )


def test_newest_days(spark):
    assert [r[0].day for r in rows(recovery.newest_days(daily(spark)), ["record_date"])] == [3, 4, 5, 6, 7, 8, 9]


def test_sessions_meet_the_signals_of_their_day(spark):
    m = metrics.daily_metrics(sessions(spark, [(1, str(i), day(i, 6 + i), 2000, 600, 150.0) for i in range(12)]))
    met = recovery.recovery_vs_performance(m, daily(spark))
    assert [r[0] for r in rows(met, ["workout_id"])] == ["2", "3", "4", "5", "6", "7", "8"]
    assert recovery.recovery_vs_performance(m, daily(spark), days=None).count() == 9


def test_bands(spark):
    found = {(r.record_date.day, r.signal): (r.value_text, r.band) for r in recovery.signal_bands(daily(spark)).collect()}
    assert [found[d, "body_battery"][1] for d in (1, 2, 4, 5)] == ["bad", "warn", "warn", "good"]
    assert found[1, "hrv_status"] == ("LOW", "warn") and found[1, "readiness"] == (None, "warn")
    assert found[1, "stress"] == ("99", "warn") and found[2, "stress"] == ("100", "good")
    assert found[1, "resting_hr"] == ("50", "warn")


@pytest.mark.parametrize(
    "battery, colour, target", [(70, "teal", 150.0), (69, "amber", 154.0), (49, "red", 154.0), (0, "red", 150.0), (None, "red", 150.0)]
)
def test_battery(one, battery, colour, target):
    level = F.lit(battery).cast("int")
    assert one(recovery.battery_colour(level), recovery.adjusted_target(F.lit(150.0), level)) == (colour, target)
