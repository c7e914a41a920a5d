"""The given tables read as domain tables. Every binding is a projection of a whole table (plus one
aggregation where a table has one row per athlete), so queries over it grow with the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainlake.operators import context, ingest, metrics, notes

AS_OF = "2024-01-28"  # a Sunday
MID_WEEK = "2024-01-24"  # a Wednesday
SYNC_TIME = "2024-02-01 00:00:00"
COMPETITION = "2024-01-20"
TRAINING_START = "2023-11-27"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ---- Sessions -----------------------------------------------------------------------------------
_DISTANCE = "CAST(300 + (event_id * 7919) % 9700 AS INT)"
_TENTHS = (
    "CAST(FLOOR((300 + (event_id * 7919) % 9700) * (1250 + (event_id * 104729"
    " + CAST(ROUND(value * 100) AS BIGINT)) % 2000) / 500.0D) AS BIGINT)"
)


def workouts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "event_id",
        "CAST(event_id AS STRING) AS workout_id",
        "user_id AS athlete_id",
        "ts AS workout_date",
        f"{_DISTANCE} AS distance_m",
        f"{_TENTHS} AS time_ds",
    )


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    return workouts(spark, folder).select(
        "workout_id",
        "athlete_id",
        "workout_date",
        "distance_m",
        *ingest.session_measures(F.col("time_ds"), F.col("distance_m")),
    )


def daily_metrics(spark: SparkSession, folder: str, **options) -> DataFrame:
    return metrics.daily_metrics(sessions(spark, folder), **options)


def raw_workouts(spark: SparkSession, folder: str) -> DataFrame:
    """Payloads as they land, with odd ones planted: three spellings of the date, unreadable dates, missing
    times, missing and zero distances, zero to four intervals."""
    local = "date_format(ts + INTERVAL 2 HOURS, \"yyyy-MM-dd'T'HH:mm:ss\")"
    return table(spark, folder, "events").selectExpr(
        "CAST(event_id AS STRING) AS id",
        "user_id AS athlete_id",
        "CASE WHEN event_id % 89 = 0 THEN 'no date'"
        " WHEN event_id % 3 = 0 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
        f" WHEN event_id % 3 = 1 THEN concat({local}, '+02:00')"
        " ELSE date_format(ts, 'yyyy-MM-dd HH:mm:ss') END AS date",
        f"CASE WHEN event_id % 83 = 0 THEN NULL WHEN event_id % 79 = 0 THEN 0 ELSE {_DISTANCE} END AS distance",
        f"CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST({_TENTHS} AS DOUBLE) END AS time",
        "transform(slice(array(0, 1, 2, 3), 1, CAST(event_id % 5 AS INT)), i -> named_struct("
        "'distance', CAST(250 * (i + 1) AS INT), 'time', CAST(event_id % 100 + 60 + i AS DOUBLE),"
        " 'spm', CAST(18 + i AS INT))) AS intervals",
    )


def line_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """One payload per line item with as many intervals as its line number."""
    return table(spark, folder, "lineitem").selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id",
        "l_suppkey AS athlete_id",
        "CAST(NULL AS STRING) AS date",
        "CAST(l_quantity * 50 AS INT) AS distance",
        "l_extendedprice AS time",
        "transform(sequence(1, l_linenumber), i -> named_struct('distance', CAST(l_quantity * 50 AS INT) + i,"
        " 'time', l_extendedprice / 100, 'spm', CAST(18 + i AS INT))) AS intervals",
    )


# ---- Recovery -----------------------------------------------------------------------------------
def recovery_daily(spark: SparkSession, folder: str) -> DataFrame:
    days = table(spark, folder, "events").selectExpr(
        "user_id AS athlete_id", "CAST(ts AS DATE) AS record_date", "EXTRACT(DAY FROM ts) AS day_no"
    ).distinct()
    return days.selectExpr(
        "athlete_id",
        "record_date",
        "CAST(40 + (athlete_id * 13 + day_no * 7) % 60 AS INT) AS body_battery",
        "CASE (athlete_id + day_no) % 3 WHEN 0 THEN 'BALANCED' WHEN 1 THEN 'UNBALANCED' ELSE 'LOW' END AS hrv_status",
        "CAST(50 + (athlete_id * 17 + day_no * 11) % 50 AS INT) AS sleep_score",
        "CAST(45 + (athlete_id + day_no) % 25 AS INT) AS resting_hr",
        "CAST((athlete_id * 5 + day_no * 3) % 100 AS INT) AS stress",
        "CAST(CASE WHEN (athlete_id + day_no) % 10 = 0 THEN NULL"
        " ELSE 30 + (athlete_id * 3 + day_no * 19) % 70 END AS INT) AS readiness",
    )


def recovery_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The recovery table as nested JSON documents; every kind of document is missing, empty or broken for
    some days."""
    odd = "(athlete_id * 31 + EXTRACT(DAY FROM record_date))"
    return recovery_daily(spark, folder).selectExpr(
        "athlete_id",
        "record_date",
        f"CASE {odd} % 13 WHEN 1 THEN NULL WHEN 2 THEN '[]' ELSE"
        " to_json(array(named_struct('charged', 1), named_struct('charged', body_battery))) END AS battery_doc",
        f"CASE {odd} % 13 WHEN 3 THEN NULL WHEN 4 THEN '{{}}' ELSE"
        " to_json(named_struct('hrvSummary', named_struct('status', hrv_status))) END AS hrv_doc",
        f"CASE {odd} % 13 WHEN 5 THEN NULL WHEN 6 THEN '{{\"dailySleepDTO\": {{}}}}' ELSE to_json(named_struct("
        "'dailySleepDTO', named_struct('sleepScores', named_struct('overall', named_struct('value', sleep_score)))))"
        " END AS sleep_doc",
        f"CASE {odd} % 13 WHEN 7 THEN NULL WHEN 8 THEN '{{\"allMetrics\": {{\"metricsMap\": {{}}}}}}' ELSE"
        " to_json(named_struct('allMetrics', named_struct('metricsMap', named_struct("
        "'WELLNESS_RESTING_HEART_RATE', array(named_struct('value', resting_hr)))))) END AS heart_rate_doc",
        f"CASE {odd} % 13 WHEN 9 THEN NULL WHEN 10 THEN '{{broken' ELSE"
        " to_json(named_struct('overallStressLevel', stress)) END AS stress_doc",
        f"CASE {odd} % 13 WHEN 11 THEN NULL WHEN 12 THEN '[]' ELSE"
        " to_json(array(named_struct('score', readiness))) END AS readiness_doc",
    )


# ---- Notes --------------------------------------------------------------------------------------
def raw_notes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").selectExpr(
        "CONCAT('tip_', CAST(conv_id AS STRING), '_', CAST(turn AS STRING)) AS tip_id",
        "conv_id % 20 AS athlete_id",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, CAST(conv_id % 700 AS INT), CAST(turn AS INT)) AS created_at",
        "CASE WHEN role = 'user' THEN 'athlete' ELSE 'coach' END AS author",
        "text AS tip_text",
        "CASE (conv_id + turn) % 7 WHEN 0 THEN 'recovery' WHEN 1 THEN 'performance' WHEN 2 THEN 'hard'"
        " WHEN 3 THEN 'race' WHEN 4 THEN 'technical' WHEN 5 THEN 'caution' END AS tag",
        "CASE (conv_id * 3 + turn) % 5 WHEN 0 THEN 'recovery' WHEN 1 THEN 'hard' WHEN 2 THEN 'race'"
        " WHEN 3 THEN 'technique' END AS session_type",
    ).withColumn("session_date", F.col("created_at").cast("date").cast("string"))


def tips(spark: SparkSession, folder: str) -> DataFrame:
    return raw_notes(spark, folder).withColumn(
        "expect_taper", notes.expects_taper(F.col("tag"), F.col("session_type"))
    )


# ---- Context entities ---------------------------------------------------------------------------
def _untiered(documents: DataFrame) -> DataFrame:
    """Three kinds of entities; every 17th record is nearly empty, every 11th has no content."""
    bare = "doc_id % 17 = 0"
    kind = lambda n, value: f"CASE WHEN doc_id % 3 = {n} AND NOT {bare} THEN {value} END"
    return documents.selectExpr(
        "doc_id",
        "CAST(doc_id AS STRING) AS id",
        f"CASE WHEN {bare} THEN '' ELSE CAST(doc_id % 50 AS STRING) END AS participant_id",
        f"CASE WHEN NOT {bare} THEN TIMESTAMP_NTZ '{AS_OF} 00:00:00'"
        " - make_dt_interval(CAST(doc_id % 45 AS INT), CAST(doc_id % 7 AS INT)) END AS created_at",
        "CAST(50 + (doc_id * 37) % 51 AS DOUBLE) / 100 AS confidence",
        f"CASE WHEN doc_id % 11 = 0 OR {bare} THEN '' ELSE text END AS content",
        "CASE doc_id % 3 WHEN 0 THEN 'participant_profile' WHEN 1 THEN 'session_note' ELSE 'goal_record' END"
        " AS entity_type",
        f"{kind(0, 'source')} AS display_name",
        f"{kind(0, 'CASE WHEN doc_id % 2 = 0 THEN lang END')} AS goals_summary",
        "CAST(NULL AS STRING) AS preferred_pronouns",
        kind(1, "TIMESTAMP_NTZ '2024-01-01 06:00:00' + make_dt_interval(CAST(doc_id % 28 AS INT))") + " AS session_date",
        f"{kind(1, 'lang')} AS coach_id",
        f"{kind(1, 'source')} AS summary",
        f"{kind(1, 'array(lang, source)')} AS action_items",
        f"{kind(2, 'source')} AS goal_text",
        "CAST(NULL AS TIMESTAMP_NTZ) AS target_date",
        f"{kind(2, 'CASE WHEN doc_id % 2 = 0 THEN NULL ELSE lang END')} AS status",
    )


def _with_tiers(rows: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Three tiers, from the labels; what has none is silver."""
    tiers = table(spark, folder, "labels").selectExpr(
        "doc_id", "CASE WHEN toxic = 1 THEN 'bronze' WHEN quality = 1 THEN 'gold' END AS tier"
    )
    return rows.drop("tier").join(tiers, "doc_id", "left").withColumn("tier", F.coalesce("tier", F.lit("silver")))


def entities(spark: SparkSession, folder: str, documents: DataFrame | None = None) -> DataFrame:
    """The entities of all documents, or of the given ones."""
    documents = table(spark, folder, "documents") if documents is None else documents
    return _with_tiers(_untiered(documents), spark, folder)


def measured_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Measured before the labels are joined, so that this join moves no texts either; the sizes are
    corrected for the name of the tier."""
    assumed = "silver"
    rows = _untiered(table(spark, folder, "documents")).withColumn("tier", F.lit(assumed))
    measured = context.measured(rows).withColumn("doc_id", F.col("id").cast("bigint"))
    longer = F.length("tier") - len(assumed)
    return _with_tiers(measured, spark, folder).withColumns(
        {name: F.col(name) + longer for name in ("full_chars", "summary_chars")}
    )


_COACH = "CASE WHEN {p} % 3 = 0 THEN 0 ELSE {p} % 5 END"
_MODES = "array('exploration', 'execution')"


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Every entity offered to its coach in both modes. The first coach gets more than a third of all."""
    rows = measured_entities(spark, folder).withColumnRenamed("doc_id", "ordinal")
    offers = rows.selectExpr("*", f"{_COACH.format(p='ordinal')} AS coach_no", f"explode({_MODES}) AS offered_mode")
    return offers.withColumn("request_id", F.concat_ws("-", "coach_no", "offered_mode")).drop(
        "coach_no", "offered_mode"
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    coaches = table(spark, folder, "documents").selectExpr(f"{_COACH.format(p='doc_id')} AS coach_no").distinct()
    return coaches.selectExpr("coach_no", f"explode({_MODES}) AS mode").selectExpr(
        "concat_ws('-', coach_no, mode) AS request_id",
        "concat('coach_', coach_no) AS coach_id",
        "mode",
        "mode AS policy_mode",
        "CASE WHEN mode = 'exploration' THEN 4000 ELSE 200 * (coach_no + 2) END AS token_budget",
        f"TIMESTAMP_NTZ '{AS_OF} 00:00:00' AS as_of",
    )


def grants(spark: SparkSession, folder: str) -> DataFrame:
    """Four fifths of the participants of a coach's own records; only two coaches may see the unnamed one."""
    pairs = _untiered(table(spark, folder, "documents")).selectExpr(
        f"{_COACH.format(p='doc_id')} AS coach_no", "participant_id"
    ).distinct()
    return pairs.where(
        "CASE WHEN participant_id = '' THEN coach_no < 2"
        " ELSE (CAST(participant_id AS INT) + coach_no) % 5 <> 0 END"
    ).selectExpr("concat('coach_', coach_no) AS coach_id", "participant_id")


def lineage(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("doc_id % 4 <> 0").selectExpr(
        "CAST(doc_id AS STRING) AS object_id",
        "doc_id AS seq",
        "doc_id % 2 = 1 AS referenced",
        "CAST(doc_id % 5 AS DOUBLE) / 4 AS usefulness",
    )


def lineage_history(spark: SparkSession, folder: str) -> DataFrame:
    """Many events per entity, from the event table; the first entity gets a third of them."""
    return table(spark, folder, "events").selectExpr(
        "CAST(CASE WHEN event_id % 3 = 0 THEN 1 ELSE event_id % 150 END AS STRING) AS object_id",
        "event_id AS seq",
        "event_id % 7 <> 3 AS referenced",
        "CAST(event_id % 5 + 1 AS DOUBLE) / 7 AS usefulness",
    )


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """The entities the lineage history is about: all of them, also the nearly empty ones."""
    return measured_entities(spark, folder)
