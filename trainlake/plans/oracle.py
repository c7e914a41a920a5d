"""Independent SQL for the registered queries, over the same tables.

The tables are bound to the domain by common table expressions; each query names the last one it needs.
"""

from __future__ import annotations

# Written out here, not taken from the library: a mistake there must show.
_BLANKS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WHITESPACE, NOT_WHITESPACE = f"[{_BLANKS}]", f"[^{_BLANKS}]"
SYSTEM_TEXT = "The context below was validated beforehand. Use only what these objects state; add nothing to them."

ORACLE: dict[str, str] = {}
_CTE: list[tuple[str, str]] = []


def _cte(name: str, sql: str) -> None:
    _CTE.append((name, sql))


def _needed(name: str) -> set[str]:
    """``name`` and the expressions it is built on (each may only use earlier ones)."""
    wanted: set[str] = set()
    todo = [name]
    known = dict(_CTE)
    while todo:
        one = todo.pop()
        if one in wanted:
            continue
        wanted.add(one)
        words = set("".join(c if c.isalnum() or c == "_" else " " for c in known[one]).split())
        todo += [n for n in known if n in words]
    return wanted


def q(name: str, sql: str, *ctes: str) -> None:
    """Register ``sql``, preceded by the table expressions it needs."""
    if not ctes:
        ORACLE[name] = sql
        return
    needed = set().union(*[_needed(c) for c in ctes])
    parts = [f"{n} AS (\n{s}\n)" for n, s in _CTE if n in needed]
    ORACLE[name] = "WITH " + ",\n".join(parts) + "\n" + sql


# ---- Expressions --------------------------------------------------------------------------------
def fmt(x: str, suffix: str = "/500m", null: str = "—") -> str:
    t = f"CAST(FLOOR(CAST({x} AS DOUBLE) * 10 + 0.5) AS BIGINT)"
    text = f"printf('%d:%02d.%d', {t} // 600, ({t} % 600) // 10, {t} % 10) || '{suffix}'"
    return f"CASE WHEN {x} IS NULL THEN '{null}' ELSE {text} END"


def r1(x: str) -> str:
    return f"CAST(format('{{:.1f}}', CAST({x} AS DOUBLE)) AS DOUBLE)"


def one(x: str) -> str:
    return f"format('{{:.1f}}', CAST({x} AS DOUBLE))"


def signed(x: str, zero: str = "") -> str:
    sign = f"CASE WHEN {x} > 0 THEN '+' WHEN {x} = 0 THEN '{zero}' ELSE '' END"
    return f"CASE WHEN {x} IS NULL THEN '—' ELSE {sign} || {one(x)} || 's' END"


def or_text(x: str, missing: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), '{missing}')"


DIRECTION = "CASE WHEN delta < 0 THEN 'FASTER (improved)' WHEN delta IS NOT NULL THEN 'SLOWER (regressed)' END"
TREND = (
    "CASE WHEN delta < 0 THEN 'improving (getting faster)'"
    " WHEN delta IS NOT NULL THEN 'declining (getting slower)' END"
)
NL = "chr(10)"

# ---- Sessions -----------------------------------------------------------------------------------
_cte(
    "workouts",
    """SELECT event_id, CAST(event_id AS VARCHAR) AS workout_id, user_id AS athlete_id, ts AS workout_date,
  CAST(300 + (event_id * 7919) % 9700 AS INT) AS distance_m,
  CAST(FLOOR((300 + (event_id * 7919) % 9700)
     * (1250 + (event_id * 104729 + CAST(ROUND(value * 100) AS BIGINT)) % 2000) / 500.0) AS BIGINT) AS time_ds
FROM events""",
)
_cte(
    "sessions",
    """SELECT event_id, workout_id, athlete_id, workout_date, distance_m,
  CAST(FLOOR(time_ds / 10.0) AS INT) AS duration_sec,
  CAST(CASE WHEN distance_m > 0 AND time_ds <> 0
       THEN (CAST(time_ds AS DOUBLE) / 10) / (CAST(distance_m AS DOUBLE) / 500) END AS FLOAT) AS avg_split_sec
FROM workouts""",
)


def _metrics_sql(source: str) -> str:
    return f"""SELECT t.athlete_id, t.workout_id, t.workout_date, t.avg_split_sec, t.duration_sec, t.distance_m,
  prev_split, avg_split_sec - prev_split AS delta, rolling_avg_split, consistency, weekly_load_min,
  CASE WHEN avg_split_sec <= 140 THEN 'race' WHEN avg_split_sec <= 145 THEN 'threshold' ELSE 'steady' END
    AS session_type,
  CASE WHEN avg_split_sec - prev_split > 2 AND weekly_load_min > 60 THEN 'fatigue'
       WHEN avg_split_sec - prev_split > 1 THEN 'caution' ELSE 'normal' END AS fatigue_flag
FROM (
  SELECT *,
    LAG(avg_split_sec) OVER w AS prev_split,
    AVG(avg_split_sec) OVER (w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS rolling_avg_split,
    STDDEV_SAMP(avg_split_sec) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS consistency,
    CAST(SUM(duration_sec) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS DOUBLE) / 60 AS weekly_load_min
  FROM {source} WHERE distance_m >= 500 AND avg_split_sec <= 300
  WINDOW w AS (PARTITION BY athlete_id ORDER BY workout_date NULLS LAST, workout_id)
) t"""


_cte("metrics", _metrics_sql("sessions"))
_cte("latest", "SELECT * FROM metrics QUALIFY ROW_NUMBER() OVER (PARTITION BY athlete_id ORDER BY workout_date DESC, workout_id DESC) = 1")

ROUNDED = "* REPLACE (ROUND(rolling_avg_split, 4) AS rolling_avg_split, ROUND(consistency, 4) AS consistency, ROUND(weekly_load_min, 4) AS weekly_load_min)"
for name in ("daily_metrics", "daily_metrics_split", "metrics_rebuild"):
    q(name, f"SELECT {ROUNDED} FROM metrics", "metrics")
q("metrics_row_count", "SELECT COUNT(*) AS n_rows FROM metrics", "metrics")

# ---- Ingest -------------------------------------------------------------------------------------
_cte(
    "payloads",
    """SELECT event_id, CAST(event_id AS VARCHAR) AS id, athlete_id,
  CASE WHEN event_id % 89 = 0 THEN NULL ELSE date_trunc('second', workout_date) END AS moment,
  CASE WHEN event_id % 89 = 0 THEN 'no date'
       WHEN event_id % 3 = 0 THEN strftime(workout_date, '%Y-%m-%dT%H:%M:%SZ')
       WHEN event_id % 3 = 1 THEN strftime(workout_date + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S+02:00')
       ELSE strftime(workout_date, '%Y-%m-%d %H:%M:%S') END AS date,
  CASE WHEN event_id % 83 = 0 THEN NULL WHEN event_id % 79 = 0 THEN 0 ELSE distance_m END AS distance,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE time_ds END AS time_ds
FROM workouts""",
)


def _normal(distance: str, where: str = "TRUE") -> str:
    return f"""SELECT id AS workout_id, athlete_id, moment AS workout_date, CAST({distance} AS INT) AS distance_m,
  CAST(FLOOR(time_ds / 10.0) AS INT) AS duration_sec,
  CAST(CASE WHEN {distance} > 0 AND time_ds <> 0
       THEN (CAST(time_ds AS DOUBLE) / 10) / (CAST({distance} AS DOUBLE) / 500) END AS FLOAT) AS avg_split_sec
FROM payloads WHERE time_ds IS NOT NULL AND {where}"""


q("workout_normalise", _normal("distance"), "payloads")
q("workout_rejects", "SELECT id, athlete_id, CAST(distance AS INT) AS distance FROM payloads WHERE time_ds IS NULL", "payloads")
q(
    "interval_flatten",
    """SELECT id || '_' || i AS interval_id, id AS workout_id, CAST(i AS INT) AS interval_index,
  CAST(l_extendedprice / 100 AS FLOAT) AS work_duration_sec, metres + CAST(i AS INT) + 1 AS distance_m,
  CAST((l_extendedprice / 100) / (CAST(metres + i + 1 AS DOUBLE) / CAST(500 AS DOUBLE)) AS FLOAT) AS split_sec,
  CAST(19 + i AS INT) AS spm
FROM (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_extendedprice,
        CAST(l_quantity * 50 AS INT) AS metres, UNNEST(range(l_linenumber)) AS i FROM lineitem) t""",
)
_cte(
    "intervals",
    """SELECT *, CAST(250 * (i + 1) AS INT) AS metres, CAST(event_id % 100 + 60 + i AS DOUBLE) AS seconds
FROM (SELECT event_id, id, UNNEST(range(event_id % 5)) AS i
      FROM (SELECT * FROM payloads WHERE time_ds IS NOT NULL AND event_id % 5 < 5)) t""",
)
q(
    "interval_flatten_scaled",
    """SELECT id || '_' || i AS interval_id, id AS workout_id, CAST(i AS INT) AS interval_index,
  CAST(seconds * CAST(0.1 AS DOUBLE) AS FLOAT) AS work_duration_sec,
  metres AS distance_m,
  CAST((seconds * CAST(0.1 AS DOUBLE)) / (CAST(metres AS DOUBLE) / CAST(500 AS DOUBLE)) AS FLOAT) AS split_sec,
  CAST(18 + i AS INT) AS spm FROM intervals""",
    "intervals",
)
q(
    "incremental_filter",
    """SELECT id, athlete_id, date FROM payloads
WHERE moment >= (SELECT MAX(ts) - INTERVAL 5 DAY FROM events WHERE event_type = 'click') - INTERVAL 3 DAY""",
    "payloads",
)
q("incremental_first_run", "SELECT id, athlete_id, date FROM payloads", "payloads")
q("sync_lookup", "SELECT MAX(ts) - INTERVAL 5 DAY AS last_sync_ts FROM events WHERE event_type = 'view'")
OLD, NEW = "TIMESTAMP '2024-01-31 12:00:00'", "TIMESTAMP '2024-02-01 00:00:00'"
q(
    "upsert_sessions",
    f"""SELECT workout_id, athlete_id, workout_date,
  CASE WHEN again THEN distance_m + 200 ELSE distance_m END AS distance_m, duration_sec, avg_split_sec,
  CASE WHEN again THEN {NEW} ELSE {OLD} END AS created_at, CASE WHEN again THEN {NEW} ELSE {OLD} END AS updated_at
FROM (SELECT *, event_id % 10 = 0 OR event_id % 13 = 0 AS again FROM sessions)""",
    "sessions",
)
q(
    "upsert_intervals",
    f"""SELECT id || '_' || i AS interval_id, id AS workout_id, CAST(i AS INT) AS interval_index,
  CAST(seconds AS FLOAT) AS work_duration_sec, metres AS distance_m,
  CAST(seconds / (CAST(metres AS DOUBLE) / CAST(500 AS DOUBLE)) AS FLOAT) AS split_sec,
  CAST(CASE WHEN again THEN 23 + i ELSE 18 + i END AS INT) AS spm,
  CASE WHEN again THEN {NEW} ELSE {OLD} END AS created_at
FROM (SELECT *, (event_id % 3 = 0 OR event_id % 13 = 0) AND i < event_id % 5 - 1 AS again FROM intervals)
WHERE again OR event_id % 13 <> 0""",
    "intervals",
)
_cte(
    "recovery",
    """SELECT athlete_id, record_date, day_no,
  CAST(40 + (athlete_id * 13 + day_no * 7) % 60 AS INT) AS body_battery,
  CASE (athlete_id + day_no) % 3 WHEN 0 THEN 'BALANCED' WHEN 1 THEN 'UNBALANCED' ELSE 'LOW' END AS hrv_status,
  CAST(50 + (athlete_id * 17 + day_no * 11) % 50 AS INT) AS sleep_score,
  CAST(45 + (athlete_id + day_no) % 25 AS INT) AS resting_hr,
  CAST((athlete_id * 5 + day_no * 3) % 100 AS INT) AS stress,
  CAST(CASE WHEN (athlete_id + day_no) % 10 = 0 THEN NULL
       ELSE 30 + (athlete_id * 3 + day_no * 19) % 70 END AS INT) AS readiness
FROM (SELECT DISTINCT user_id AS athlete_id, CAST(ts AS DATE) AS record_date,
             EXTRACT(DAY FROM ts) AS day_no FROM events) e""",
)
q(
    "upsert_recovery",
    f"""SELECT athlete_id, record_date, body_battery, hrv_status, sleep_score, resting_hr,
  CASE WHEN odd % 10 = 0 OR odd % 11 = 0 THEN stress + 1 ELSE stress END AS stress, readiness,
  CASE WHEN odd % 11 = 0 THEN {NEW} ELSE {OLD} END AS created_at
FROM (SELECT *, athlete_id + day_no AS odd FROM recovery)""",
    "recovery",
)
q(
    "sync_mark",
    """SELECT event_type AS source_name,
  CASE WHEN event_type IN ('view', 'click') THEN MAX(ts) ELSE MAX(ts) - INTERVAL 5 DAY END AS last_sync_ts
FROM events GROUP BY event_type""",
)
for name in ("recovery_extract", "raw_recovery_scan", "refresh_recovery"):
    q(
        name,
        """SELECT athlete_id, record_date, CASE WHEN odd NOT IN (1, 2) THEN body_battery END AS body_battery,
  CASE WHEN odd NOT IN (3, 4) THEN hrv_status END AS hrv_status,
  CASE WHEN odd NOT IN (5, 6) THEN sleep_score END AS sleep_score,
  CASE WHEN odd NOT IN (7, 8) THEN resting_hr END AS resting_hr,
  CASE WHEN odd NOT IN (9, 10) THEN stress END AS stress,
  CASE WHEN odd NOT IN (11, 12) THEN readiness END AS readiness
FROM (SELECT *, (athlete_id * 31 + day_no) % 13 AS odd FROM recovery)""",
        "recovery",
    )

# ---- Per athlete --------------------------------------------------------------------------------
for name in ("latest_session", "newest_metrics"):
    q(name, f"SELECT {ROUNDED} FROM latest", "latest")
_cte(
    "fastest",
    """SELECT * EXCLUDE (event_id) FROM sessions WHERE avg_split_sec IS NOT NULL AND distance_m >= 1000
QUALIFY ROW_NUMBER() OVER (PARTITION BY athlete_id ORDER BY avg_split_sec, workout_date, workout_id) = 1""",
)
q("fastest_session", "SELECT * FROM fastest", "fastest")
_cte(
    "best",
    f"""SELECT athlete_id, avg_split_sec AS best_split_sec, workout_date AS best_date,
  {fmt('avg_split_sec')} || ' (' || {one('avg_split_sec')} || 's) on ' || strftime(workout_date, '%b %d')
    AS personal_best FROM fastest""",
)
q("personal_best", "SELECT * FROM best", "best")
q(
    "top_k_sessions",
    """SELECT * EXCLUDE (event_id),
  CAST(ROW_NUMBER() OVER (PARTITION BY athlete_id ORDER BY workout_date DESC, workout_id DESC) AS INT) AS rank
FROM sessions QUALIFY rank <= 3""",
    "sessions",
)
_cte(
    "summaries",
    f"""SELECT m.athlete_id, workout_date AS session_time, {fmt('avg_split_sec')} AS split_formatted,
  {r1('avg_split_sec')} AS split_raw_sec, {fmt('prev_split')} AS prev_split_formatted, {r1('delta')} AS delta_sec,
  {DIRECTION} AS delta_direction, {fmt('rolling_avg_split')} AS rolling_split_formatted,
  {r1('duration_sec / CAST(60 AS DOUBLE)')} AS duration_min, distance_m, fatigue_flag AS fatigue,
  {r1('weekly_load_min')} AS weekly_load_min, session_type, {TREND} AS trend,
  coalesce(personal_best, 'N/A') AS personal_best_split, CAST(format('{{:.2f}}', consistency) AS DOUBLE) AS consistency_stddev
FROM latest m LEFT JOIN best b ON m.athlete_id = b.athlete_id""",
)
q("session_summary", "SELECT * FROM summaries", "summaries")
q("prompt_summary", "SELECT * EXCLUDE (split_raw_sec) FROM summaries", "summaries")
_cte(
    "briefs",
    f"""SELECT athlete_id, workout_date AS session_time, {r1('avg_split_sec')} AS split, CAST(delta AS DOUBLE) AS delta,
  {r1('rolling_avg_split')} AS rolling_split, {r1('duration_sec / CAST(60 AS DOUBLE)')} AS duration_min, distance_m,
  {r1('weekly_load_min')} AS weekly_load_min, fatigue_flag, session_type,
  CASE WHEN delta < 0 THEN 'improving' WHEN delta IS NOT NULL THEN 'declining' END AS trend FROM latest""",
)
q("brief_summary", "SELECT * FROM briefs", "briefs")

# ---- Notes --------------------------------------------------------------------------------------
_cte(
    "tips",
    """SELECT *, coalesce(tag = 'recovery', FALSE) OR coalesce(session_type = 'recovery', FALSE) AS expect_taper,
  strftime(created_at, '%Y-%m-%d') AS session_date
FROM (SELECT CONCAT('tip_', CAST(conv_id AS VARCHAR), '_', CAST(turn AS VARCHAR)) AS tip_id,
  conv_id % 20 AS athlete_id,
  TIMESTAMP '2024-01-01 00:00:00' + (conv_id % 700) * INTERVAL 1 HOUR + turn * INTERVAL 1 MINUTE AS created_at,
  CASE WHEN role = 'user' THEN 'athlete' ELSE 'coach' END AS author,
  text AS tip_text,
  CASE (conv_id + turn) % 7 WHEN 0 THEN 'recovery' WHEN 1 THEN 'performance' WHEN 2 THEN 'hard'
       WHEN 3 THEN 'race' WHEN 4 THEN 'technical' WHEN 5 THEN 'caution' END AS tag,
  CASE (conv_id * 3 + turn) % 5 WHEN 0 THEN 'recovery' WHEN 1 THEN 'hard' WHEN 2 THEN 'race'
       WHEN 3 THEN 'technique' END AS session_type
FROM conversations)""",
)
_cte(
    "ranked_tips",
    """SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY athlete_id ORDER BY created_at DESC, tip_id DESC) AS INT) AS rank,
  '[' || strftime(created_at, '%Y-%m-%d %H:%M') || '] ' || CASE WHEN author = 'coach' THEN 'Coach' ELSE 'Athlete' END
  || CASE WHEN tag IS NOT NULL THEN ' [' || tag || ']' ELSE '' END
  || CASE WHEN expect_taper THEN ' [TAPER EXPECTED — recovery row]' ELSE '' END || ': ' || tip_text AS line
FROM tips""",
)
_cte(
    "flags",
    """SELECT athlete_id, expect_taper AS taper_active FROM tips WHERE author = 'coach'
QUALIFY ROW_NUMBER() OVER (PARTITION BY athlete_id ORDER BY created_at DESC, tip_id DESC) = 1""",
)


def _block(k: int) -> str:
    return f"""SELECT athlete_id, string_agg(line, {NL} ORDER BY created_at, tip_id) AS context_block
FROM ranked_tips WHERE rank <= {k} GROUP BY athlete_id"""


for k in (3, 5, 10):
    _cte(f"block_{k}", _block(k))
q("recent_tips", "SELECT athlete_id, rank, tip_id, created_at, author, tag, session_type, expect_taper FROM ranked_tips WHERE rank <= 10", "ranked_tips")
q(
    "taper_flag",
    """SELECT a.athlete_id, coalesce(taper_active, FALSE) AS taper_active
FROM (SELECT DISTINCT user_id AS athlete_id FROM events) a LEFT JOIN flags f ON a.athlete_id = f.athlete_id""",
    "flags",
)
q("context_block", "SELECT * FROM block_5", "block_5")
q(
    "generated_note_tags",
    """SELECT m.athlete_id, CASE WHEN taper_active THEN 'recovery' WHEN delta < 0 THEN 'performance' ELSE 'caution' END
  AS tag FROM latest m LEFT JOIN flags f ON m.athlete_id = f.athlete_id""",
    "latest", "flags",
)
q(
    "tip_session_lookup",
    f"""SELECT tip_id, t.athlete_id, CASE WHEN d.distance_m IS NOT NULL
  THEN format('{{:,}}', d.distance_m) || ' m · ' || {fmt('d.avg_split_sec', '')} ELSE session_date END AS session_label
FROM tips t LEFT JOIN (SELECT *, strftime(workout_date, '%Y-%m-%d') AS day FROM metrics
  QUALIFY ROW_NUMBER() OVER (PARTITION BY athlete_id, CAST(workout_date AS DATE)
    ORDER BY workout_date DESC, workout_id DESC) = 1) d
ON t.athlete_id = d.athlete_id AND t.session_date = d.day""",
    "tips", "metrics",
)
q("note_append", "SELECT athlete_id, created_at, author, tip_text, tag, session_type, expect_taper FROM tips", "tips")
q(
    "brief_lookup",
    f"""SELECT athlete_id, CAST(created_at AS DATE) AS brief_date, regexp_replace(tip_text, '^{WHITESPACE}+|{WHITESPACE}+$', '', 'g') AS brief_text
FROM tips WHERE CAST(created_at AS DATE) <= DATE '2024-01-15'
QUALIFY ROW_NUMBER() OVER (PARTITION BY athlete_id ORDER BY created_at DESC, tip_id DESC) = 1""",
    "tips",
)
q(
    "staleness",
    """SELECT athlete_id, workout_date AS latest_session,
  CASE athlete_id % 4 WHEN 0 THEN workout_date WHEN 1 THEN workout_date - INTERVAL 1 DAY END AS summary_time,
  athlete_id % 4 <> 0 AS is_stale
FROM sessions QUALIFY ROW_NUMBER() OVER (PARTITION BY athlete_id ORDER BY workout_date DESC, workout_id DESC) = 1""",
    "sessions",
)

# ---- Weeks --------------------------------------------------------------------------------------
_cte(
    "weekly",
    f"""SELECT athlete_id, week_start, sessions_completed, total_volume_m,
  {r1('total_volume_m / CAST(1000 AS DOUBLE)')} AS total_volume_km, {r1('minutes')} AS total_duration_min,
  {r1('mean_split')} AS avg_split_sec, {fmt('mean_split')} AS avg_split_formatted, fatigue_days, flagged_rows
FROM (SELECT athlete_id, CAST(date_trunc('week', workout_date) AS DATE) AS week_start,
  COUNT(*) AS sessions_completed, CAST(SUM(distance_m) AS BIGINT) AS total_volume_m,
  CAST(SUM(duration_sec) AS DOUBLE) / 60 AS minutes, AVG(CAST(avg_split_sec AS DOUBLE)) AS mean_split,
  COUNT(*) FILTER (fatigue_flag = 'fatigue') AS fatigue_days, COUNT(*) AS flagged_rows
FROM metrics GROUP BY 1, 2) t""",
)
q("weekly_summary", "SELECT * FROM weekly", "weekly")


def _wow() -> str:
    columns = []
    for value, name, unit, lower in (
        ("total_volume_km", "volume", " km", False), ("sessions_completed", "sessions", "", False),
        ("avg_split_sec", "split", "s", True), ("total_duration_min", "duration", " min", False),
    ):
        now, then = f"CAST(w.{value} AS DOUBLE)", f"CAST(p.{value} AS DOUBLE)"
        change = f"(CASE WHEN {now} <> 0 AND {then} <> 0 AND abs({now} - {then}) >= 0.01 THEN {now} - {then} END)"
        columns += [
            f"{then} AS prev_{name}",
            f"{r1(change)} AS {name}_change",
            f"{change} {'<' if lower else '>'} 0 AS {name}_better",
            f"CASE WHEN {change} < 0 THEN '↓' ELSE '↑' END || {one(f'abs({change})')} || '{unit}' AS {name}_text",
        ]
    return f"""SELECT w.athlete_id, w.week_start, w.total_volume_km, w.sessions_completed, w.avg_split_sec,
  w.total_duration_min, {', '.join(columns)}, w.avg_split_formatted, w.fatigue_days
FROM weekly w LEFT JOIN weekly p ON w.athlete_id = p.athlete_id AND w.week_start = p.week_start + INTERVAL 7 DAY"""


_cte("compared", _wow())
q("week_over_week", "SELECT * EXCLUDE (avg_split_formatted, fatigue_days) FROM compared", "compared")
q(
    "x_weekly_review",
    """SELECT m.athlete_id, CAST(date_trunc('week', workout_date) AS DATE) AS week_start, COUNT(*) AS sessions,
  ROUND(MAX(CAST(avg_split_sec AS DOUBLE)) - MIN(CAST(avg_split_sec AS DOUBLE)), 4) AS split_spread,
  FIRST(workout_id ORDER BY avg_split_sec, workout_date, workout_id) AS best_workout,
  FIRST(workout_id ORDER BY avg_split_sec DESC, workout_date DESC, workout_id DESC) AS worst_workout,
  ROUND(CASE WHEN COUNT(DISTINCT avg_split_sec) > 1 AND COUNT(DISTINCT body_battery) > 1
    THEN corr(CAST(avg_split_sec AS DOUBLE), CAST(body_battery AS DOUBLE)) END, 4) AS battery_correlation
FROM metrics m LEFT JOIN recovery r ON m.athlete_id = r.athlete_id AND CAST(m.workout_date AS DATE) = r.record_date
GROUP BY 1, 2""",
    "metrics", "recovery",
)
q(
    "x_calendar_load",
    """SELECT athlete_id, day, sessions, seconds / CAST(60 AS DOUBLE) AS day_min, CAST(SUM(seconds) OVER (PARTITION BY athlete_id
  ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS BIGINT) / CAST(60 AS DOUBLE) AS load_7d_min
FROM (SELECT athlete_id, CAST(workout_date AS DATE) AS day, COUNT(*) AS sessions, CAST(SUM(duration_sec) AS BIGINT) AS seconds
  FROM metrics GROUP BY 1, 2)""",
    "metrics",
)
q(
    "iso_week_volume",
    """SELECT athlete_id, CAST(extract(isoyear FROM workout_date) AS INT) AS iso_year,
  CAST(extract(week FROM workout_date) AS INT) AS iso_week, CAST(SUM(distance_m) AS BIGINT) AS distance_m
FROM metrics GROUP BY 1, 2, 3""",
    "metrics",
)
q(
    "week_calendar",
    f"""SELECT athlete_id, day, strftime(day, '%-d %b') AS day_text, km,
  CASE WHEN km > 0 THEN {one('km')} || 'km' ELSE '' END AS km_text
FROM (SELECT a.athlete_id, d.day, coalesce(s.distance_m / CAST(1000 AS DOUBLE), 0) AS km
  FROM (SELECT DISTINCT athlete_id FROM metrics) a
  CROSS JOIN (SELECT CAST(DATE '2024-01-22' + CAST(i AS INT) AS DATE) AS day FROM range(7) r(i)) d
  LEFT JOIN (SELECT athlete_id, CAST(workout_date AS DATE) AS day, distance_m FROM metrics
    QUALIFY ROW_NUMBER() OVER (PARTITION BY athlete_id, CAST(workout_date AS DATE)
      ORDER BY workout_date DESC, workout_id DESC) = 1) s
  ON a.athlete_id = s.athlete_id AND d.day = s.day)""",
    "metrics",
)
q(
    "week_range_rows",
    """SELECT athlete_id, workout_id, workout_date, CAST(avg_split_sec AS DOUBLE) AS avg_split_sec, distance_m,
  CAST(duration_sec AS DOUBLE) AS duration_sec, session_type, fatigue_flag, ROUND(weekly_load_min, 4) AS weekly_load_min
FROM metrics WHERE CAST(workout_date AS DATE) BETWEEN DATE '2024-01-22' AND DATE '2024-01-24'""",
    "metrics",
)

# ---- Rows ---------------------------------------------------------------------------------------
MINUTES = r1("duration_sec / CAST(60 AS DOUBLE)")
q(
    "session_history",
    f"""SELECT athlete_id, workout_id, workout_date, distance_m,
  round_even(duration_sec / CAST(60 AS DOUBLE) * 10, 0) / 10 AS duration_min,
  {fmt('avg_split_sec', '')} AS split, {signed('delta')} AS delta_s, session_type, fatigue_flag AS fatigue,
  ROUND(weekly_load_min, 4) AS weekly_load_min FROM metrics""",
    "metrics",
)
q(
    "load_vs_performance",
    """SELECT athlete_id, workout_id, ROUND(weekly_load_min, 4) AS weekly_load_min, avg_split_sec, distance_m,
  session_type FROM metrics""",
    "metrics",
)
q(
    "category_attributes",
    """SELECT athlete_id, workout_id,
  CAST(CASE fatigue_flag WHEN 'caution' THEN 16096779 WHEN 'fatigue' THEN 15680580 ELSE 58804 END AS INT) AS fatigue_colour,
  CASE fatigue_flag WHEN 'caution' THEN '🟡' WHEN 'fatigue' THEN '🔴' ELSE '🟢' END AS fatigue_marker,
  CASE session_type WHEN 'steady' THEN '#3b82f6' WHEN 'threshold' THEN '#f59e0b' WHEN 'race' THEN '#ef4444'
    ELSE '#7a8ba8' END AS session_colour FROM metrics""",
    "metrics",
)
q(
    "training_phase",
    """SELECT athlete_id, workout_id, week AS training_week, name AS phase
FROM (SELECT *, CAST(datediff('day', DATE '2023-11-27', CAST(workout_date AS DATE)) // 7 + 1 AS INT) AS week FROM sessions) s
LEFT JOIN (VALUES (1, 6, 'Base Aerobic'), (7, 12, 'Aerobic Threshold'), (13, 18, 'VO₂max Development'),
  (19, 24, 'Race Specificity'), (25, 28, 'Peak & Taper'), (29, 30, 'Competition')) p(first, last, name)
ON week BETWEEN first AND last""",
    "sessions",
)
q(
    "countdown",
    """SELECT athlete_id, workout_id,
  CAST(greatest(datediff('day', CAST(workout_date AS DATE), DATE '2024-01-20'), 0) AS INT) AS days_left,
  CAST(datediff('day', DATE '2023-11-27', CAST(workout_date AS DATE)) AS INT) AS training_day FROM sessions""",
    "sessions",
)
q(
    "goal_progress",
    """SELECT athlete_id, label, current, target,
  CAST(least(trunc(CAST(current AS DOUBLE) / CAST(target AS DOUBLE) * 100), 100) AS INT) AS progress_pct
FROM (SELECT athlete_id, UNNEST(['volume', 'longest', 'shortest', 'sessions']) AS label,
    UNNEST([metres, longest, shortest, n + 10]) AS current,
    UNNEST([CAST(500000 AS BIGINT), 12000, 900, n]) AS target
  FROM (SELECT athlete_id, CAST(SUM(distance_m) AS BIGINT) AS metres, CAST(MAX(distance_m) AS BIGINT) AS longest,
    CAST(MIN(duration_sec) AS BIGINT) AS shortest, COUNT(*) AS n FROM sessions WHERE duration_sec > 0
    GROUP BY athlete_id))""",
    "sessions",
)
q(
    "text_functions",
    f"""SELECT athlete_id, workout_id, {fmt('avg_split_sec')} AS with_suffix,
  {fmt('prev_split', '', 'N/A')} AS without_suffix, {signed('delta')} AS history_delta,
  {signed('delta', '+')} AS message_delta, {MINUTES} AS minutes, format('{{:,}}', distance_m) AS metres_text,
  strftime(workout_date, '%b %d') AS best_day, strftime(workout_date, '%a %d %b') AS title_day,
  strftime(workout_date, '%-d %b') AS bar_day, upper(fatigue_flag[1]) || fatigue_flag[2:] AS fatigue_title,
  {DIRECTION} AS direction, {TREND} AS trend FROM metrics""",
    "metrics",
)


def first_words(x: str) -> str:
    stripped = f"regexp_replace({x}, '^{WHITESPACE}+|{WHITESPACE}+$', '', 'g')"
    words = f"string_split_regex({stripped}, '{WHITESPACE}+')"
    return (
        f"array_to_string(list_slice({words}, 1,"
        f" greatest(1, CAST(FLOOR(len({words}) * CAST(0.3 AS DOUBLE)) AS INT))), ' ')"
    )


q(
    "long_text_functions",
    f"""SELECT doc_id, CASE WHEN length(body) > 1000 THEN substr(body, 1, 1000) || '...' ELSE body END AS short,
  {first_words('text')} AS summary, NOT regexp_matches(text, '{NOT_WHITESPACE}') AS blank
FROM (SELECT *, replace('*' || text || '*', '*', '**') AS body FROM documents)""",
)
q(
    "parse_functions",
    """SELECT id, moment, CASE WHEN event_id % 7 <> 0 THEN CAST(time_ds AS DOUBLE) / 10 END AS number,
  '{"id":"' || id || '","distance":' || coalesce(CAST(distance AS VARCHAR), 'null') || '}' AS as_json,
  CAST(CASE WHEN event_id % 5 > 0 THEN 17 + event_id % 5 END AS INT) AS last_spm,
  CAST(CASE WHEN event_id % 5 > 0 THEN 18 END AS INT) AS first_spm, TRUE AS id_has_time FROM payloads""",
    "payloads",
)

# ---- Recovery -----------------------------------------------------------------------------------
q(
    "recovery_vs_performance",
    """SELECT m.athlete_id, record_date, workout_id, avg_split_sec, body_battery, sleep_score
FROM metrics m JOIN (SELECT * FROM recovery
  QUALIFY ROW_NUMBER() OVER (PARTITION BY athlete_id ORDER BY record_date DESC) <= 7) r
ON m.athlete_id = r.athlete_id AND CAST(m.workout_date AS DATE) = r.record_date""",
    "metrics", "recovery",
)
_cte(
    "newest_recovery",
    """SELECT * EXCLUDE (day_no), ROW_NUMBER() OVER (PARTITION BY athlete_id ORDER BY record_date DESC) AS rn
FROM recovery QUALIFY rn <= 7""",
)
q("newest_recovery_days", "SELECT * EXCLUDE (rn) FROM newest_recovery", "newest_recovery")
q(
    "recovery_bands",
    " UNION ALL ".join(
        f"""SELECT athlete_id, record_date, '{s}' AS signal, CAST({s} AS VARCHAR) AS value_text, """
        + ("'warn' AS band" if s == "hrv_status" else
           f"CASE WHEN {s} IS NULL THEN 'warn' WHEN {s} >= {high} THEN 'good' WHEN {s} >= {low} THEN 'warn' ELSE 'bad' END AS band")
        + " FROM recovery"
        for s, low, high in (
            ("body_battery", 70, 85), ("hrv_status", 0, 0), ("sleep_score", 65, 80), ("resting_hr", 0, 100),
            ("stress", 0, 100), ("readiness", 60, 75),
        )
    ),
    "recovery",
)
q(
    "recovery_adjusted_target",
    """SELECT m.athlete_id, workout_id,
  CASE WHEN body_battery >= 70 THEN 'teal' WHEN body_battery >= 50 THEN 'amber' ELSE 'red' END AS battery_colour,
  CASE WHEN body_battery <> 0 AND body_battery < 70 THEN CAST(avg_split_sec AS DOUBLE) + 4
    ELSE CAST(avg_split_sec AS DOUBLE) END AS target_split
FROM metrics m JOIN recovery r ON m.athlete_id = r.athlete_id AND CAST(m.workout_date AS DATE) = r.record_date""",
    "metrics", "recovery",
)

# ---- Context ------------------------------------------------------------------------------------
_cte(
    "entities",
    """SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS id,
  CASE WHEN bare THEN '' ELSE CAST(d.doc_id % 50 AS VARCHAR) END AS participant_id,
  CASE WHEN NOT bare THEN TIMESTAMP '2024-01-28 00:00:00' - (d.doc_id % 45) * INTERVAL 1 DAY
    - (d.doc_id % 7) * INTERVAL 1 HOUR END AS created_at,
  CASE WHEN l.toxic = 1 THEN 'bronze' WHEN l.quality = 1 THEN 'gold' ELSE 'silver' END AS tier,
  CASE WHEN d.doc_id % 11 = 0 OR bare THEN '' ELSE d.text END AS content,
  CAST(50 + (d.doc_id * 37) % 51 AS DOUBLE) / 100 AS confidence,
  CASE d.doc_id % 3 WHEN 0 THEN 'participant_profile' WHEN 1 THEN 'session_note' ELSE 'goal_record' END AS entity_type,
  CASE WHEN NOT bare THEN d.source END AS specific_1, CASE WHEN NOT bare THEN d.lang END AS specific_2,
  CASE WHEN NOT bare THEN TIMESTAMP '2024-01-01 06:00:00' + (d.doc_id % 28) * INTERVAL 1 DAY END AS noted_at
FROM (SELECT *, doc_id % 17 = 0 AS bare FROM documents) d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)


def _filled(*columns: str) -> str:
    tests = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in columns)
    return f"CAST({tests} AS DOUBLE) / {len(columns)}"


def _text(c: str) -> str:
    return f"regexp_matches(coalesce({c}, ''), '{NOT_WHITESPACE}')"


_BASE = [_text("id"), _text("participant_id"), "created_at IS NOT NULL", _text("tier"), _text("content")]
_cte(
    "scored",
    f"""SELECT *, coalesce(confidence * recency * completeness, 0) AS priority
FROM (SELECT *,
  CASE entity_type WHEN 'session_note' THEN {_filled(*_BASE, 'noted_at IS NOT NULL', _text('specific_2'))}
    ELSE {_filled(*_BASE, _text('specific_1'))} END AS completeness,
  CASE WHEN age <= 7 THEN 1 WHEN age >= 30 THEN 0.5
    ELSE 1 - (age - 7) / CAST(23 AS DOUBLE) * CAST(0.5 AS DOUBLE) END AS recency
FROM (SELECT *, CAST(epoch_us(TIMESTAMP '2024-01-28 00:00:00') - epoch_us(created_at) AS DOUBLE)
    / CAST(86400000000 AS DOUBLE) AS age FROM entities))""",
)
q(
    "entity_scores",
    """SELECT id, entity_type, completeness, CASE WHEN age IS NOT NULL THEN recency END AS recency, priority FROM scored""",
    "scored",
)
q(
    "entity_scores_steep",
    """SELECT id, CASE WHEN age IS NULL THEN NULL WHEN age <= 7 THEN 1 WHEN age >= 20 THEN CAST(0.2 AS DOUBLE)
  ELSE 1 - (age - 7) / CAST(13 AS DOUBLE) * (CAST(1 AS DOUBLE) - CAST(0.2 AS DOUBLE)) END AS recency FROM scored""",
    "scored",
)
_cte(
    "offered",
    """SELECT s.*, coach_no || '-' || mode AS request_id, doc_id AS ordinal, 'coach_' || coach_no AS coach_id, mode,
  CAST(CASE WHEN mode = 'exploration' THEN 4000 ELSE 200 * (coach_no + 2) END AS INT) AS token_budget,
  CASE WHEN participant_id = '' THEN coach_no < 2
    ELSE (CAST(participant_id AS INT) + coach_no) % 5 <> 0 END AS granted
FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 5 END AS coach_no,
  UNNEST(['exploration', 'execution']) AS mode FROM scored) s""",
)


def _payload(kind: str, fields: str) -> str:
    return f"""WHEN '{kind}' THEN CAST(to_json({{'id': id, 'participant_id': participant_id,
    'created_at': replace(CAST(created_at AS VARCHAR), ' ', 'T') || 'Z', 'tier': tier, 'confidence': confidence,
    'content': form, {fields}}}) AS VARCHAR)"""


_cte(
    "gated",
    """SELECT *, CASE WHEN NOT (tier = 'gold' OR (tier = 'silver' AND mode = 'exploration')) THEN 'pep_tier_gate'
  WHEN NOT granted THEN 'pep_access_denied' WHEN completeness < 0.5 THEN 'completeness_below_threshold' END AS gate
FROM offered""",
)
_cte(
    "sized",
    f"""SELECT *, CASE WHEN priority >= 0.85 THEN json ELSE json[:-2] || ',"_summarised":true}}' END AS payload
FROM (SELECT *, CASE entity_type
  {_payload('participant_profile', "'display_name': specific_1, 'goals_summary': CASE WHEN doc_id % 2 = 0 THEN specific_2 END, 'preferred_pronouns': NULL")}
  {_payload('session_note', "'session_date': replace(CAST(noted_at AS VARCHAR), ' ', 'T') || 'Z', 'coach_id': specific_2, 'summary': specific_1, 'action_items': CASE WHEN specific_1 IS NOT NULL THEN [specific_2, specific_1] END")}
  {_payload('goal_record', "'goal_text': specific_1, 'target_date': NULL, 'status': CASE WHEN doc_id % 2 = 1 THEN specific_2 END")}
  END AS json
FROM (SELECT *, CASE WHEN priority >= 0.85 THEN content ELSE {first_words('content')} END AS form
  FROM gated WHERE gate IS NULL))""",
)
_cte(
    "budgeted",
    """SELECT *, SUM(estimated_tokens) OVER (PARTITION BY request_id ORDER BY priority DESC, ordinal) AS used
FROM (SELECT *, CAST(greatest(1, length(payload) // 4) AS BIGINT) AS estimated_tokens FROM sized)""",
)
_cte(
    "decided",
    """SELECT g.*, b.estimated_tokens, b.payload,
  coalesce(g.gate, CASE WHEN b.used > g.token_budget THEN 'budget_truncation' END) AS reason_code
FROM gated g LEFT JOIN budgeted b ON g.request_id = b.request_id AND g.ordinal = b.ordinal""",
)
q(
    "policy_decisions",
    """SELECT request_id, coach_id, mode, id AS object_id, tier,
  coalesce(gate, '') NOT IN ('pep_tier_gate', 'pep_access_denied') AS allowed,
  CASE gate WHEN 'pep_tier_gate' THEN 'tier_gate' WHEN 'pep_access_denied' THEN 'rbac_denied' ELSE 'ok' END AS reason
FROM gated""",
    "gated",
)
_BROKEN = """(n % 31 = 0 OR n % 29 = 0 OR n % 23 = 0 OR (n % 37 = 0 AND n % 3 <> 2))"""
q(
    "request_rejects",
    f"""SELECT request_id, coach_id, mode, id AS object_id, CASE WHEN NOT {_BROKEN} THEN tier END AS tier,
  NOT {_BROKEN} AND coalesce(gate, '') NOT IN ('pep_tier_gate', 'pep_access_denied') AS allowed,
  CASE WHEN {_BROKEN} THEN 'unknown_record' WHEN gate = 'pep_tier_gate' THEN 'tier_gate'
    WHEN gate = 'pep_access_denied' THEN 'rbac_denied' ELSE 'ok' END AS reason
FROM (SELECT *, CAST(id AS BIGINT) AS n FROM gated)
UNION ALL SELECT 'nobody', NULL, NULL, id, CASE WHEN NOT {_BROKEN} THEN tier END, FALSE,
  CASE WHEN {_BROKEN} THEN 'unknown_record' ELSE 'unknown_request' END
FROM (SELECT *, doc_id AS n FROM entities WHERE doc_id % 13 = 0)""",
    "gated", "entities",
)
q("access_semi", "SELECT coach_id, participant_id, request_id, id FROM offered WHERE granted", "offered")
q("access_anti", "SELECT coach_id, participant_id, request_id, id FROM offered WHERE NOT granted", "offered")
q(
    "context_budget",
    """SELECT request_id, ordinal, id, priority, estimated_tokens, reason_code,
  CASE WHEN reason_code IS NULL THEN priority < 0.85 END AS summarised FROM decided""",
    "decided",
)
q(
    "completeness_quarantine",
    """SELECT TIMESTAMP '2024-02-01 00:00:00' AS timestamp, id AS object_id, entity_type, reason_code,
  priority AS priority_score, completeness AS ratio FROM decided WHERE reason_code = 'completeness_below_threshold'""",
    "decided",
)
_cte(
    "exclusions",
    """SELECT TIMESTAMP '2024-02-01 00:00:00' AS logged_at,
  CASE WHEN doc_id % 19 <> 0 THEN TIMESTAMP '2024-02-01 00:00:00' - (doc_id % 45) * INTERVAL 1 DAY END AS timestamp,
  id AS object_id, entity_type, reason_code, priority AS priority_score,
  CASE WHEN reason_code LIKE 'pep%' THEN mode END AS mode,
  CASE WHEN reason_code = 'budget_truncation' THEN CAST(token_budget AS VARCHAR) END AS token_budget
FROM decided WHERE reason_code IS NOT NULL""",
)
LOG = "timestamp, object_id, entity_type, reason_code, priority_score, mode, token_budget"
q(
    "quarantine_counts",
    """SELECT reason_code, entity_type, CAST(timestamp AS DATE) AS event_date, COUNT(*) AS n_records
FROM exclusions GROUP BY 1, 2, 3""",
    "exclusions",
)
q(
    "quarantine_query",
    f"""SELECT {LOG} FROM exclusions WHERE reason_code = 'budget_truncation' AND entity_type = 'session_note'
  AND timestamp >= TIMESTAMP '2024-01-15 00:00:00'""",
    "exclusions",
)
for name in ("quarantine_retention", "stream_quarantine"):
    q(name, f"SELECT {LOG} FROM exclusions WHERE timestamp IS NULL OR timestamp >= TIMESTAMP '2024-01-06 12:00:00'", "exclusions")
q("log_append", f"SELECT {LOG.replace('timestamp', 'logged_at AS timestamp', 1)} FROM exclusions", "exclusions")
q(
    "context_request",
    f"""SELECT request_id, '{SYSTEM_TEXT}' AS system, 'What should the next session be?' AS user,
  '[' || coalesce(string_agg(payload, ',' ORDER BY priority DESC, ordinal) FILTER (reason_code IS NULL), '') || ']' AS context,
  mode, CAST(COUNT(*) FILTER (reason_code IS NULL) AS INT) AS n_objects
FROM decided GROUP BY request_id, mode""",
    "decided",
)
q(
    "entity_validation",
    """SELECT id, CASE WHEN doc_id % 31 = 0 THEN 'unknown_kind' WHEN doc_id % 29 = 0 THEN 'unknown_tier'
  WHEN doc_id % 23 = 0 THEN 'confidence_out_of_range'
  WHEN doc_id % 37 = 0 AND entity_type <> 'goal_record' THEN 'foreign_field' END AS problem FROM entities""",
    "entities",
)
q(
    "entity_assembly",
    """SELECT id, entity_type, tier, CASE WHEN entity_type = 'participant_profile' THEN specific_1 END AS display_name,
  CASE WHEN entity_type = 'session_note' THEN specific_2 END AS coach_id,
  CASE WHEN entity_type = 'goal_record' THEN specific_1 END AS goal_text, content FROM entities""",
    "entities",
)
q(
    "null_violations",
    """SELECT tip_id, CASE WHEN session_type IS NULL THEN 'tag,tag_or_type' ELSE 'tag' END AS missing
FROM tips WHERE tag IS NULL""",
    "tips",
)
q("duplicate_keys", "SELECT l_orderkey, l_linenumber, COUNT(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")

# ---- Calibration --------------------------------------------------------------------------------
q(
    "initial_confidence",
    "SELECT id, ROUND(CASE WHEN doc_id % 2 = 0 THEN confidence ELSE completeness END, 8) AS confidence FROM scored",
    "scored",
)
q(
    "recalibrate_batch",
    """SELECT id, ROUND(CASE WHEN doc_id % 4 = 0 THEN confidence ELSE 0.7 * confidence + 0.3 * completeness
  * CASE WHEN doc_id % 2 = 1 THEN CAST(doc_id % 5 AS DOUBLE) / 4 ELSE 0 END END, 8) AS confidence FROM scored""",
    "scored",
)
q(
    "recalibrate_scorer",
    """SELECT id, ROUND(CASE WHEN doc_id % 4 = 0 THEN confidence
  ELSE greatest(0, least(1, confidence * 3 - CAST(doc_id % 5 AS DOUBLE) / 4)) END, 8) AS confidence FROM scored""",
    "scored",
)
_cte(
    "history",
    """SELECT CAST(CASE WHEN event_id % 3 = 0 THEN 1 ELSE event_id % 150 END AS VARCHAR) AS id, event_id AS seq,
  CASE WHEN event_id % 7 <> 3 THEN CAST(event_id % 5 + 1 AS DOUBLE) / 7 ELSE 0 END AS used FROM events""",
)
for name in ("recalibrate_fold", "recalibrate_fold_split", "stream_confidence", "stream_confidence_compacted", "x_keyed_confidence"):
    # The clamp never acts here (all values are in [0, 1]), so the fold is a weighted sum.
    q(
        name,
        """SELECT s.id, ROUND(coalesce(pow(CAST(0.7 AS DOUBLE), n) * confidence + CAST(0.3 AS DOUBLE) * completeness * total,
  confidence), 8) AS confidence
FROM scored s LEFT JOIN (SELECT id, COUNT(*) AS n, SUM(pow(CAST(0.7 AS DOUBLE), later) * used) AS total
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY seq DESC) - 1 AS later FROM history) GROUP BY id) h
ON s.id = h.id""",
        "scored", "history",
    )

# ---- Plans --------------------------------------------------------------------------------------
_cte(
    "labels_of_plans",
    """SELECT event_id, workout_id, athlete_id, CAST(workout_date AS DATE) AS day, distance_m,
  CASE event_id % 6 WHEN 0 THEN concat(1 + athlete_id % 5, 'x', 1 + distance_m % 3, 'km intervals')
    WHEN 1 THEN concat(distance_m % 20, 'km easy') WHEN 2 THEN concat(1 + athlete_id % 5, 'X', distance_m % 4, '.5 km')
    WHEN 3 THEN 'Rest' WHEN 4 THEN concat('warm ', 1 + athlete_id % 5, 'x', 1 + distance_m % 9, 'km') END AS label
FROM sessions""",
)
KM = """CASE event_id % 6 WHEN 0 THEN CAST((1 + athlete_id % 5) * (1 + distance_m % 3) AS DOUBLE)
  WHEN 1 THEN CAST(distance_m % 20 AS DOUBLE) WHEN 2 THEN (1 + athlete_id % 5) * (distance_m % 4 + CAST(0.5 AS DOUBLE))
  WHEN 3 THEN CAST(0 AS DOUBLE) WHEN 4 THEN CAST(1 + distance_m % 9 AS DOUBLE) ELSE CAST({0} AS DOUBLE) END"""
q("planned_km", f"SELECT workout_id, label, {KM.format(0)} AS planned_km FROM labels_of_plans", "labels_of_plans")
q(
    "plan_parse",
    """SELECT workout_id, 'week of ' || coalesce(label, '8km') AS insight, CAST(2 AS INT) AS n_days
FROM labels_of_plans WHERE event_id % 4 <> 3""",
    "labels_of_plans",
)
q("plan_rejects", "SELECT workout_id FROM labels_of_plans WHERE event_id % 4 = 3", "labels_of_plans")
q(
    "plan_days",
    f"""SELECT workout_id, athlete_id, CAST(0 AS INT) AS position, 'Mon' AS day, day AS date,
  strftime(day, '%-d %b') AS date_text, 'steady' AS session_type, coalesce(label, '8km') AS label,
  '2:20.0' AS target_split, CAST(distance_m % 90 AS INT) AS duration_min, {KM.format(8)} AS planned_km,
  day = DATE '2024-01-24' AS is_today FROM labels_of_plans WHERE event_id % 4 <> 3
UNION ALL
SELECT workout_id, athlete_id, 1, 'Tue', day + 1, strftime(day + 1, '%-d %b'), 'rest', 'Rest', NULL, NULL, 0,
  day + 1 = DATE '2024-01-24' FROM labels_of_plans WHERE event_id % 4 <> 3""",
    "labels_of_plans",
)
q(
    "next_week_dates",
    """SELECT athlete_id, CAST(i AS INT) AS position, CAST(DATE '2024-01-29' + CAST(i AS INT) AS DATE) AS date,
  strftime(DATE '2024-01-29' + CAST(i AS INT), '%a') AS day
FROM (SELECT DISTINCT user_id AS athlete_id FROM events) a CROSS JOIN range(7) r(i)""",
)

# ---- Prompts ------------------------------------------------------------------------------------
_cte("today", "SELECT *, TRUE AS known FROM newest_recovery WHERE rn = 1 AND athlete_id % 4 <> 0")
TAPER = "CASE WHEN taper_active THEN 'The last coach note planned this as a recovery session: a slower split is intended.' END"
GOAL = "a first indoor race"


def _signals(missing: str, *signals: tuple[str, str, str]) -> str:
    lines = ", ".join(f"'{label}: ' || {or_text(name, missing)} || '{unit}'" for name, label, unit in signals)
    return f"concat_ws({NL}, {lines})"


_SIX = [
    ("body_battery", "Body battery", " / 100"), ("hrv_status", "HRV status", ""), ("sleep_score", "Sleep score", ""),
    ("resting_hr", "Resting heart rate", " bpm"), ("stress", "Stress", ""), ("readiness", "Readiness", "%"),
]
_JSON = ", ".join(
    f"'{c}': " + ("strftime(session_time, '%Y-%m-%d %H:%M:%S')" if c == "session_time" else c)
    for c in (
        "session_time", "split_formatted", "prev_split_formatted", "delta_sec", "delta_direction",
        "rolling_split_formatted", "duration_min", "distance_m", "fatigue", "weekly_load_min", "session_type", "trend",
        "personal_best_split", "consistency_stddev",
    )
)
q(
    "coaching_prompt",
    f"""SELECT s.athlete_id, coalesce(taper_active, FALSE) AS taper_active, concat_ws({NL},
  'Coach an indoor rower whose goal is: {GOAL}. Give splits as m:SS.t per 500 m.', {TAPER}, 'Notes so far:',
  coalesce(context_block, '(No previous coaching context available)'), 'Latest session:',
  CAST(to_json({{{_JSON}}}) AS VARCHAR), CASE WHEN known THEN {_signals('N/A', *_SIX)} ELSE '' END,
  'Personal best: ' || personal_best_split) AS prompt
FROM summaries s LEFT JOIN block_10 b ON s.athlete_id = b.athlete_id LEFT JOIN flags f ON s.athlete_id = f.athlete_id
LEFT JOIN today r ON s.athlete_id = r.athlete_id""",
    "summaries", "block_10", "flags", "today",
)
_FOUR = [
    ("body_battery", "Body battery", "/100"), ("hrv_status", "HRV", ""), ("sleep_score", "Sleep", ""),
    ("resting_hr", "Resting heart rate", " bpm"),
]
q(
    "brief_prompt",
    f"""SELECT s.athlete_id, concat_ws({NL},
  'Write a short morning message for an indoor rower whose goal is: {GOAL}.', {TAPER}, 'Notes so far:',
  coalesce(context_block, '(No previous coaching context available)'),
  'Split ' || {fmt('split', '', 'N/A')} || ' /500m, change ' || {signed('delta', '+')},
  'Distance ' || {or_text('distance_m', '?')} || ' m in ' || {or_text('duration_min', '?')} || ' min',
  'Type ' || {or_text('session_type', '?')} || ', fatigue ' || {or_text('fatigue_flag', '?')},
  'Load ' || {or_text('weekly_load_min', '?')} || ' min, trend ' || {or_text('trend', '?')},
  CASE WHEN known THEN {_signals('?', *_FOUR)} ELSE '' END) AS prompt
FROM briefs s LEFT JOIN block_5 b ON s.athlete_id = b.athlete_id LEFT JOIN flags f ON s.athlete_id = f.athlete_id
LEFT JOIN today r ON s.athlete_id = r.athlete_id""",
    "briefs", "block_5", "flags", "today",
)
_DAYS = ",".join(
    f'{{"day":"{day}","date":"2024-{date}"}}'
    for day, date in zip(
        ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"),
        ("01-29", "01-30", "01-31", "02-01", "02-02", "02-03", "02-04"),
    )
)
q(
    "weekly_prompt",
    f"""SELECT w.athlete_id, week_start, concat_ws({NL},
  'Plan the next training week of an indoor rower. Answer with JSON only.', 'Notes so far:',
  coalesce(context_block, '(No previous coaching context available)'), 'Sessions: ' || sessions_completed,
  'Volume: ' || total_volume_km || ' km', 'Mean split: ' || avg_split_formatted,
  'Duration: ' || total_duration_min || ' min', 'Fatigue days: ' || fatigue_days,
  CASE WHEN prev_sessions IS NOT NULL THEN concat_ws({NL}, 'Week before:', 'Volume: ' || prev_volume || ' km',
    'Sessions: ' || CAST(prev_sessions AS BIGINT), 'Mean split: ' || {fmt('prev_split')},
    'Duration: ' || prev_duration || ' min') END,
  'Days: [{_DAYS}]') AS prompt
FROM compared w LEFT JOIN block_3 b ON w.athlete_id = b.athlete_id WHERE week_start = DATE '2024-01-22'""",
    "compared", "block_3",
)
_PAYLOAD_SIGNALS = [
    ("body_battery", "Body battery", "/100"), ("hrv_status", "HRV status", ""), ("sleep_score", "Sleep score", ""),
    ("resting_hr", "Resting heart rate", " bpm"), ("stress", "Stress level", ""), ("readiness", "Readiness", "%"),
]
q(
    "notification_payload",
    f"""SELECT s.athlete_id, CAST(to_json({{'title': 'Morning brief Sun 28 Jan',
  'color': CASE fatigue WHEN 'caution' THEN 16096779 WHEN 'fatigue' THEN 15680580 ELSE 58804 END,
  'fields': [
   {{'name': 'Last session', 'value': concat_ws({NL}, 'Split: ' || split_formatted, 'Change: ' ||
     CASE WHEN delta_sec IS NULL THEN '—' ELSE {signed('delta_sec', '+')} || ' — ' || delta_direction END,
     'Distance: ' || distance_m || ' m', 'Duration: ' || duration_min || ' min'), 'inline': TRUE}},
   {{'name': CASE fatigue WHEN 'caution' THEN '🟡' WHEN 'fatigue' THEN '🔴' ELSE '🟢' END || ' Readiness',
     'value': concat_ws({NL}, 'Fatigue: ' || upper(fatigue[1]) || fatigue[2:],
     'Load: ' || weekly_load_min || ' min', 'Trend: ' || coalesce(trend, '—')), 'inline': TRUE}},
   {{'name': 'Recovery', 'value': CASE WHEN known THEN {_signals('—', *_PAYLOAD_SIGNALS)}
     ELSE 'No recovery data yet' END, 'inline': FALSE}},
   {{'name': 'Brief', 'value': coalesce(CASE WHEN length(body) > 1000 THEN substr(body, 1, 1000) || '...' ELSE body END, ''),
     'inline': FALSE}},
   {{'name': 'Countdown', 'value': '154 days until 2024-06-30', 'inline': FALSE}}]}}) AS VARCHAR) AS payload
FROM summaries s LEFT JOIN (SELECT athlete_id, replace(tip_text, '*', '**') AS body FROM ranked_tips WHERE rank = 1) b
  ON s.athlete_id = b.athlete_id LEFT JOIN today r ON s.athlete_id = r.athlete_id""",
    "summaries", "ranked_tips", "today",
)

# ---- Files --------------------------------------------------------------------------------------
q("scan_tables", "SELECT * EXCLUDE (event_id) FROM sessions", "sessions")
q("missing_source", "SELECT athlete_id, record_date, stress, FALSE AS is_in_both FROM recovery", "recovery")
q("raw_json_scan", _normal("distance", "event_id % 7 <> 0"), "payloads")
q(
    "snapshot_roundtrip",
    """SELECT w.athlete_id, TIMESTAMP '2024-02-01 00:00:00' AS generated_at, w.week_start,
  CAST(w.week_start + INTERVAL 6 DAY AS DATE) AS week_end, w.total_volume_m AS volume, p.total_volume_m AS prev_volume,
  CASE WHEN w.athlete_id % 3 <> 0 THEN 'volume ' || w.total_volume_km ELSE '' END AS insight,
  CAST(CASE WHEN w.athlete_id % 3 <> 0 THEN 2 ELSE -1 END AS INT) AS n_days
FROM weekly w LEFT JOIN weekly p ON w.athlete_id = p.athlete_id AND w.week_start = p.week_start + INTERVAL 7 DAY""",
    "weekly",
)
q(
    "snapshot_two_writes",
    """SELECT athlete_id, week_start, total_volume_m AS volume,
  CASE WHEN athlete_id % 3 <> 0 THEN 'volume ' || total_volume_km ELSE '' END AS insight,
  CASE WHEN athlete_id % 2 = 0 THEN 'second' ELSE 'first' END AS model FROM weekly""",
    "weekly",
)
q(
    "brief_two_writes",
    f"""SELECT athlete_id, CAST(created_at AS DATE) AS brief_date,
  CASE WHEN athlete_id % 2 = 0 THEN 'Again: ' || regexp_replace(tip_text, '{WHITESPACE}+$', '', 'g')
  ELSE regexp_replace(tip_text, '^{WHITESPACE}+|{WHITESPACE}+$', '', 'g') END AS brief_text
FROM tips WHERE CAST(created_at AS DATE) <= DATE '2024-01-15'
QUALIFY ROW_NUMBER() OVER (PARTITION BY athlete_id ORDER BY created_at DESC, tip_id DESC) = 1""",
    "tips",
)
q(
    "recovery_snapshot",
    """SELECT athlete_id, record_date, body_battery, hrv_status, sleep_score, resting_hr, stress, readiness FROM recovery
QUALIFY ROW_NUMBER() OVER (PARTITION BY athlete_id ORDER BY record_date DESC) = 1""",
    "recovery",
)
q(
    "refresh_rejects",
    """SELECT id, 'stored' AS state, CAST(distance AS INT) AS distance_m FROM payloads WHERE time_ds IS NOT NULL
UNION ALL SELECT id, 'set aside', CAST(distance AS INT) FROM payloads WHERE time_ds IS NULL
UNION ALL SELECT id, 'set aside', CAST(distance AS INT) FROM payloads WHERE event_id % 5 = 0""",
    "payloads",
)
q(
    "coaching_output",
    """SELECT s.athlete_id, split_formatted, delta_sec, 'trend ' || trend AS coaching, body_battery,
  TIMESTAMP '2024-02-01 00:00:00' AS generated_at, 'a-model' AS model
FROM summaries s LEFT JOIN today r ON s.athlete_id = r.athlete_id""",
    "summaries", "today",
)
q(
    "malformed_log_scan",
    """SELECT CASE WHEN event_id % 17 <> 0 THEN ts END AS timestamp, CAST(event_id AS VARCHAR) AS object_id,
  event_type AS reason_code, value AS priority_score, CAST(user_id AS VARCHAR) AS token_budget FROM events
WHERE event_id % 11 <> 0 AND event_id % 13 <> 0""",
)

# ---- Streams ------------------------------------------------------------------------------------
AGAIN = "CASE WHEN event_id % 10 = 0 THEN distance + 100 ELSE distance END"
_cte("streamed", _normal(f"({AGAIN})"))
q("stream_sessions", "SELECT * FROM streamed", "streamed")
q("stream_sessions_compacted", "SELECT * FROM streamed", "streamed")
q(
    "stream_rejects",
    """SELECT id, athlete_id, (CASE WHEN event_id % 4 = 0 OR event_id % 6 = 0 THEN 2 ELSE 1 END)
  * (CASE WHEN event_id % 10 = 0 THEN 2 ELSE 1 END)::BIGINT AS times FROM payloads WHERE time_ds IS NULL""",
    "payloads",
)
q(
    "stream_intervals",
    """SELECT id || '_' || i AS interval_id, id AS workout_id, CAST(i AS INT) AS interval_index,
  CAST(seconds AS FLOAT) AS work_duration_sec, metres AS distance_m,
  CAST(seconds / (CAST(metres AS DOUBLE) / CAST(500 AS DOUBLE)) AS FLOAT) AS split_sec, CAST(18 + i AS INT) AS spm
FROM intervals""",
    "intervals",
)
_cte("streamed_metrics", _metrics_sql("streamed"))
q("stream_metrics", f"SELECT {ROUNDED} FROM streamed_metrics", "streamed_metrics")
_cte(
    "arrived",
    """SELECT *, event_id % 2 = 0 OR moment >= first_mark - INTERVAL 3 DAY AS taken,
  event_id % 10 = 0 AND moment >= greatest(first_mark, coalesce(second_mark, first_mark)) - INTERVAL 3 DAY AS retaken
FROM payloads, (SELECT MAX(moment) FILTER (event_id % 2 = 0) AS first_mark,
  MAX(moment) FILTER (event_id % 2 <> 0) AS second_mark FROM payloads WHERE time_ds IS NOT NULL)
WHERE time_ds IS NOT NULL""",
)
q(
    "stream_sessions_replay",
    _normal("(CASE WHEN retaken THEN distance + 100 ELSE distance END)", "taken").replace("FROM payloads", "FROM arrived"),
    "arrived",
)
q(
    "stream_sessions_late",
    """SELECT id, athlete_id, CASE
  WHEN event_id % 2 <> 0 AND mark IS NOT NULL AND told IS NULL THEN 'no_date'
  WHEN event_id % 2 <> 0 AND told < mark - INTERVAL 3 DAY THEN 'before_limit'
  WHEN time_ds IS NULL THEN 'rejected' ELSE 'stored' END AS outcome
FROM (SELECT *, CASE WHEN event_id % 101 = 0 THEN TIMESTAMP '2199-05-05' ELSE moment END AS told,
  MAX(moment) FILTER (event_id % 2 = 0 AND event_id % 101 <> 0 AND time_ds IS NOT NULL) OVER (PARTITION BY athlete_id) AS mark
FROM payloads)""",
    "payloads",
)
q(
    "raw_corrupt_pages",
    """SELECT CASE WHEN event_id % 31 <> 0 THEN id END AS id, CASE WHEN event_id % 31 <> 0 THEN athlete_id END AS athlete_id,
  CAST(CASE WHEN event_id % 31 <> 0 THEN distance END AS INT) AS distance,
  CASE WHEN event_id % 31 = 0 THEN '{"data": [{"id": "' || id END AS corrupt FROM payloads""",
    "payloads",
)
q(
    "refresh_two_landings",
    """SELECT id, CASE WHEN event_id % 31 = 0 THEN 'corrupt'
  WHEN event_id % 2 <> 0 AND moment IS NULL THEN 'no_date'
  WHEN event_id % 2 <> 0 AND moment < TIMESTAMP '2024-01-12 00:00:00' THEN 'before_limit'
  WHEN time_ds IS NULL THEN 'rejected' ELSE 'stored' END AS outcome, CAST(1 AS BIGINT) AS times
FROM payloads""",
    "payloads",
)
q(
    "stream_quarantine_future",
    """SELECT CASE WHEN number % 23 = 0 THEN TIMESTAMP '2199-05-05' ELSE timestamp END AS timestamp, object_id, entity_type, reason_code,
  priority_score, mode, token_budget, number % 23 = 0 AS set_aside
FROM (SELECT *, CAST(object_id AS BIGINT) AS number FROM exclusions)""",
    "exclusions",
)
