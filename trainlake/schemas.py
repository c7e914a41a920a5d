"""All table schemas, and the values that are fixed by the domain."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "FLOAT": T.FloatType(),
    "DOUBLE": T.DoubleType(),
    "STRING": T.StringType(),
    "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampType(),
    "TIMESTAMP_NTZ": T.TimestampNTZType(),
    "STRINGS": T.ArrayType(T.StringType()),
    "STRING_MAP": T.MapType(T.StringType(), T.StringType()),
}


def struct(columns: str) -> T.StructType:
    """A schema from "name TYPE, …"; unlike a DDL string it needs no running session."""
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


RAW_INTERVAL = struct("distance INT, time DOUBLE, spm INT")
RAW_WORKOUT = T.StructType(
    struct("id STRING, athlete_id BIGINT, date STRING, distance INT, time DOUBLE").fields
    + [T.StructField("intervals", T.ArrayType(RAW_INTERVAL))]
)
RAW_WORKOUT_PAGE = T.StructType([T.StructField("data", T.ArrayType(RAW_WORKOUT))])

# Workouts that come too late to be taken in, and landed lines that cannot be read.
LATE_WORKOUT = T.StructType([*RAW_WORKOUT.fields, *struct("late STRING, landed_at TIMESTAMP, file STRING").fields])
CORRUPT_LINE = struct("landed_at TIMESTAMP, file STRING, block BIGINT, line BIGINT, corrupt STRING")
LANDED_FILE = struct("file STRING, modified TIMESTAMP, size BIGINT")

RAW_RECOVERY = struct(
    "athlete_id BIGINT, record_date DATE, battery_doc STRING, hrv_doc STRING, sleep_doc STRING,"
    " heart_rate_doc STRING, stress_doc STRING, readiness_doc STRING"
)

SESSIONS = struct(
    "workout_id STRING, athlete_id BIGINT, workout_date TIMESTAMP_NTZ, distance_m INT,"
    " duration_sec INT, avg_split_sec FLOAT, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
)
INTERVALS = struct(
    "interval_id STRING, workout_id STRING, interval_index INT, work_duration_sec FLOAT,"
    " rest_duration_sec FLOAT, distance_m INT, split_sec FLOAT, spm INT, created_at TIMESTAMP_NTZ"
)
SYNC_STATE = struct("source_name STRING, last_sync_ts TIMESTAMP_NTZ")
RECOVERY_DAILY = struct(
    "athlete_id BIGINT, record_date DATE, body_battery INT, hrv_status STRING, sleep_score INT,"
    " resting_hr INT, stress INT, readiness INT, created_at TIMESTAMP_NTZ"
)
TIPS = struct(
    "tip_id STRING, athlete_id BIGINT, created_at TIMESTAMP_NTZ, session_date STRING, author STRING,"
    " tip_text STRING, tag STRING, session_type STRING, expect_taper BOOLEAN"
)
METRICS = struct(
    "athlete_id BIGINT, workout_id STRING, workout_date TIMESTAMP_NTZ, avg_split_sec FLOAT,"
    " duration_sec INT, distance_m INT, prev_split FLOAT, delta FLOAT, rolling_avg_split DOUBLE,"
    " consistency DOUBLE, weekly_load_min DOUBLE, session_type STRING, fatigue_flag STRING"
)
ENTITY_BASE = struct(
    "id STRING, participant_id STRING, created_at TIMESTAMP_NTZ, tier STRING, confidence DOUBLE, content STRING"
)
# Fields that each kind of context entity adds to the base fields.
ENTITY_KINDS = {
    "participant_profile": struct(
        "display_name STRING, goals_summary STRING, preferred_pronouns STRING"
    ),
    "session_note": struct(
        "session_date TIMESTAMP_NTZ, coach_id STRING, summary STRING, action_items STRINGS"
    ),
    "goal_record": struct("goal_text STRING, target_date TIMESTAMP_NTZ, status STRING"),
}
ENTITY = T.StructType(
    ENTITY_BASE.fields
    + [T.StructField("entity_type", T.StringType())]
    + [field for kind in ENTITY_KINDS.values() for field in kind.fields]
)
EXCLUSION = struct(
    "timestamp TIMESTAMP_NTZ, object_id STRING, entity_type STRING, reason_code STRING,"
    " priority_score DOUBLE, extra STRING_MAP"
)
# The log as JSON lines: the time is text and may carry an offset.
RAW_EXCLUSION = struct(
    "timestamp STRING, object_id STRING, entity_type STRING, reason_code STRING, priority_score DOUBLE,"
    " extra STRING_MAP"
)
PLAN_DAY = struct(
    "day STRING, date STRING, session_type STRING, label STRING, target_split STRING,"
    " duration_min STRING, notes STRING"
)
PLAN = T.StructType(
    [T.StructField("insight", T.StringType()), T.StructField("next_week", T.ArrayType(PLAN_DAY))]
)
BRIEFS = struct("athlete_id BIGINT, brief_date DATE, brief_text STRING")

# ---- Fixed values -------------------------------------------------------------------------------
MIN_DISTANCE_M = 500
MAX_SPLIT_SEC = 300
PERSONAL_BEST_MIN_DISTANCE_M = 1000
RACE_MAX_SPLIT_SEC = 140
THRESHOLD_MAX_SPLIT_SEC = 145
FATIGUE_DELTA_SEC = 2
FATIGUE_LOAD_MIN = 60
CAUTION_DELTA_SEC = 1
LOAD_SESSIONS = 7
SPREAD_SESSIONS = 4
ROLLING_SESSIONS = 2
REPLAY_DAYS = 3
NOTE_WINDOW = 10
RECOVERY_DAYS = 7
FRESH_DAYS = 7
DECAY_DAYS = 30
RECENCY_FLOOR = 0.5
FULL_TEXT_PRIORITY = 0.85
MIN_COMPLETENESS = 0.5
SUMMARY_RATIO = 0.3
TOKEN_BUDGET = 4000
CHARS_PER_TOKEN = 4
EMA_ALPHA = 0.3
RETENTION_DAYS = 30
MODE_TIERS = {"execution": ["gold"], "exploration": ["gold", "silver"]}
TIERS = ["gold", "silver", "bronze"]
REASON_CODES = [
    "completeness_below_threshold",
    "pep_access_denied",
    "pep_tier_gate",
    "budget_truncation",
]
REQUIRED_BASE_FIELDS = ["id", "participant_id", "created_at", "tier", "content"]
REQUIRED_KIND_FIELDS = {
    "participant_profile": ["display_name"],
    "session_note": ["session_date", "coach_id"],
    "goal_record": ["goal_text"],
}
FATIGUE_COLOURS = {"normal": 0x00E5B4, "caution": 0xF59E0B, "fatigue": 0xEF4444}
FATIGUE_MARKERS = {"normal": "🟢", "caution": "🟡", "fatigue": "🔴"}
SESSION_COLOURS = {"steady": "#3b82f6", "threshold": "#f59e0b", "race": "#ef4444"}
UNKNOWN_SESSION_COLOUR = "#7a8ba8"
# signal -> (low, high); None where the reference band is open (0 and 100 are used then).
RECOVERY_BANDS = {
    "body_battery": (70, 85),
    "hrv_status": (None, None),
    "sleep_score": (65, 80),
    "resting_hr": (None, None),
    "stress": (None, None),
    "readiness": (60, 75),
}
LOW_BATTERY = 70
BATTERY_AMBER = 50
LOW_BATTERY_SPLIT_RELIEF_SEC = 4
# (from week, to week, name) of the 30-week programme.
TRAINING_PHASES = [
    (1, 6, "Base Aerobic"),
    (7, 12, "Aerobic Threshold"),
    (13, 18, "VO₂max Development"),
    (19, 24, "Race Specificity"),
    (25, 28, "Peak & Taper"),
    (29, 30, "Competition"),
]
