from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from trainlake import schemas as S


def day(n, hour=8):
    return datetime(2024, 1, 1, hour) + timedelta(days=n)


def sessions(spark, rows):
    """Rows (athlete, workout id, time, distance, duration, split)."""
    schema = S.struct(
        "athlete_id BIGINT, workout_id STRING, workout_date TIMESTAMP_NTZ, distance_m INT, duration_sec INT,"
        " avg_split_sec FLOAT"
    )
    return spark.createDataFrame(rows, schema)


def by_id(df, key="workout_id"):
    return {row[key]: row for row in df.collect()}


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return x


def rows(df, columns=None):
    """All rows in a fixed order, for comparison."""
    columns = columns or sorted(df.columns)
    found = [tuple(value(x) for x in row) for row in df.select(*columns).collect()]
    return sorted(found, key=lambda r: tuple((x is None, str(x)) for x in r))


def entity(spark, *overrides):
    """Entities with every required field of their kind; each override is a dict."""
    base = {
        "id": "p1", "participant_id": "p1", "created_at": datetime(2024, 1, 28), "tier": "gold", "confidence": 1.0,
        "content": "rows three times a week", "entity_type": "participant_profile",
    }
    kinds = {
        "participant_profile": {"display_name": "Pat"},
        "session_note": {"session_date": datetime(2024, 1, 20), "coach_id": "c1"},
        "goal_record": {"goal_text": "finish"},
    }
    full = []
    for changes in overrides or ({},):
        kind = changes.get("entity_type", base["entity_type"])
        row = {**base, **kinds.get(kind, {}), **changes}
        full.append(tuple(row.get(name) for name in S.ENTITY.fieldNames()))
    return spark.createDataFrame(full, S.ENTITY)


def now():
    return F.lit("2024-01-28 00:00:00").cast("timestamp_ntz")
