"""SQL over the original tables for every registered query.

The SQL never renders or parses text, so it checks the parsers independently.
"""

from __future__ import annotations

SENSORS = """
  SELECT event_id AS id, 's' || user_id AS sensor_id, event_type AS sensor_type,
         CASE WHEN event_type <> 'error' THEN value
              WHEN event_id % 2 = 0 THEN -1.0 END AS measurement,
         ts AS "timestamp"
  FROM events"""

STUDENTS = """
  SELECT o_orderkey AS id, o_orderpriority AS admission, o_orderstatus AS sex,
         'CURSO_' || (o_custkey % 25) AS course, o_orderdate AS intake_date,
         CAST(year(o_orderdate) - 17 - o_custkey % 30 AS BIGINT) AS birth_year
  FROM orders"""

_SALARY_NAME = "'\"' || c_name || ', X' || c_custkey || '\"'"
_INVALID = "measurement IS NULL OR measurement = -1"
_VALID = "measurement IS NOT NULL AND measurement <> -1"
_IN_1997 = "intake_date >= TIMESTAMP '1997-01-01' AND intake_date < TIMESTAMP '1998-01-01'"


def _round(value: str) -> str:
    """Six digits, in two steps as the queries do it."""
    return f"round(round({value}, 9), 6)"


def _metrics(source: str, measurement: str = "measurement") -> str:
    return f"""
      SELECT {_round('avg(measurement)')} AS average_measurement,
             count(*) FILTER (WHERE {_INVALID}) AS count_invalid_measurements,
             {_round(f'avg(measurement) FILTER (WHERE {_VALID})')} AS average_valid
      FROM (SELECT {measurement} AS measurement FROM ({source}))"""


_FLOAT = "CAST(CAST(measurement AS FLOAT) AS DOUBLE)"

_CLASS = f"""
  CASE WHEN {_INVALID} THEN 'invalid'
       WHEN measurement BETWEEN 80 AND 100 THEN 'normal'
       WHEN measurement BETWEEN 20 AND 45 THEN 'outlier'
       ELSE 'unexpected' END"""


_NEWEST = "(SELECT max(ts) FROM events)"
_AS_OF = "TIMESTAMP '2024-01-15 12:30:00'"


def _health(keys: str, now: str = _NEWEST) -> str:
    return f"""
      SELECT *, {_round('n_normal / n')} AS valid_ratio,
             CASE WHEN last_seen < {now} - INTERVAL 1 HOUR THEN 'offline'
                  WHEN n_normal / n < 0.5 THEN 'faulty' ELSE 'ok' END AS status
      FROM (
        SELECT {keys}, count(*) AS n,
               count(*) FILTER (WHERE kind = 'invalid') AS n_invalid,
               count(*) FILTER (WHERE kind = 'normal') AS n_normal,
               count(*) FILTER (WHERE kind = 'outlier') AS n_outlier,
               count(*) FILTER (WHERE kind = 'unexpected') AS n_unexpected,
               {_round("avg(measurement) FILTER (WHERE kind <> 'invalid')")} AS average_valid,
               max("timestamp") AS last_seen
        FROM (SELECT *, {_CLASS} AS kind FROM ({SENSORS}) WHERE "timestamp" <= {now})
        GROUP BY ALL)"""


_BUCKETS = f"""
  SELECT sensor_type, time_bucket(INTERVAL 1 HOUR, "timestamp") AS bucket, count(*) AS n,
         count(*) FILTER (WHERE {_VALID}) AS n_valid,
         avg(measurement) AS average_measurement,
         avg(measurement) FILTER (WHERE {_VALID}) AS average_valid
  FROM ({SENSORS}) GROUP BY ALL"""

# A bucket closes once its end is ten minutes older than the newest reading.
_CLOSED = "bucket + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


def _rounded_buckets(where: str = "true") -> str:
    return f"""
      SELECT * REPLACE ({_round('average_measurement')} AS average_measurement,
                        {_round('average_valid')} AS average_valid)
      FROM ({_BUCKETS}) WHERE {where}"""


def _smoothed(where: str = "true") -> str:
    trailing = "avg(average_valid) OVER (PARTITION BY sensor_type ORDER BY bucket ROWS 4 PRECEDING)"
    return f"""
      SELECT sensor_type, bucket, {_round(trailing)} AS smoothed
      FROM ({_BUCKETS}) WHERE n_valid > 0 AND {where}"""


def _online(key: str, now: str = _NEWEST) -> str:
    return f"""
      SELECT {key}, max("timestamp") AS last_seen,
             arg_max_null(measurement, "timestamp") AS last_measurement
      FROM ({SENSORS}) WHERE "timestamp" <= {now} GROUP BY {key}
      HAVING max("timestamp") >= {now} - INTERVAL 1 HOUR"""


_OUTAGES = f"""
  SELECT *, date_sub('second', silent_since, coalesce(back_at, {_NEWEST})) AS seconds FROM (
    SELECT sensor_id, "timestamp" AS silent_since,
           lead("timestamp") OVER (PARTITION BY sensor_id ORDER BY "timestamp") AS back_at
    FROM ({SENSORS}) WHERE "timestamp" IS NOT NULL)
  WHERE coalesce(back_at, {_NEWEST}) > silent_since + INTERVAL 1 HOUR"""

# A result saved to both stores and read back from each.
_BOTH = "SELECT *, unnest(['documents', 'table']) AS target FROM ({})"

_LOGINS = f"""
  SELECT 'u' || user_id AS username, count(*) AS n FROM events
  WHERE event_type = 'click' GROUP BY 1 HAVING count(*) > 15"""

_SALARIES = f"SELECT c_acctbal AS salary, {_SALARY_NAME} AS name FROM customer"

# The payroll without its rule line, which is a title of its own if it stays.
_TITLES = """
  SELECT o_orderpriority AS title, count(*) AS n
  FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) GROUP BY 1"""

_READINGS = f'SELECT sensor_type, measurement, "timestamp" FROM ({SENSORS})'


def _whole(column: str) -> str:
    return f"CASE WHEN max({column}) > 2147483647 THEN 'bigint' ELSE 'int' END"


def _top5(where: str = "true") -> str:
    return f"""
      SELECT course, count(*) AS count FROM ({STUDENTS}) WHERE {where}
      GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""


# Readings as the mixed messages carry them: signups deleted, purchases tombstones or damaged.
_MIXED = f"""
  SELECT CASE WHEN sensor_type = 'signup' THEN 'd' WHEN sensor_type = 'view' THEN 'r'
              WHEN sensor_type <> 'purchase' THEN 'c' END AS op,
         sensor_type NOT IN ('signup', 'purchase') AS has_row,
         CASE WHEN sensor_type NOT IN ('signup', 'purchase')
              THEN {_FLOAT} END AS measurement
  FROM ({SENSORS})"""

# Documents keep their time to the second.
_DOCUMENTS = f"""
  SELECT id, sensor_id, sensor_type, measurement,
         date_trunc('second', "timestamp") AS "timestamp", 'c' AS op, true AS has_row
  FROM ({SENSORS})"""

def _current(where: str = "true") -> str:
    """The last change of each sensor, unless it deleted the row."""
    return f"""
      SELECT last.* FROM (SELECT arg_max(s, id) AS last FROM ({SENSORS}) s WHERE {where} GROUP BY sensor_id)
      WHERE last.sensor_type <> 'signup'"""


ORACLE: dict[str, str] = {
    "login_events": "SELECT 'u' || user_id AS username FROM events WHERE event_type = 'click'",
    "login_rejects": """
      SELECT 'Jun ' || lpad(CAST(day(ts) % 20 + 10 AS VARCHAR), 2, '0') || strftime(ts, ' %H:%M:%S')
             || ' mailhost dovecot: imap-login: Login: user=<>, method=PLAIN' AS value
      FROM events WHERE event_type = 'view'""",
    "login_counts": _LOGINS,
    "login_counts_tsv": _LOGINS,
    "salary_parse": _SALARIES,
    "salary_rejects": """
      SELECT '"' || c_name || ',X' || c_custkey || '",' || c_mktsegment
             || ',$(' || abs(c_acctbal) || '),$0.00' AS value
      FROM customer WHERE c_acctbal < 0""",
    "salary_top6": f"{_SALARIES} ORDER BY 1 DESC, 2 LIMIT 6",
    "line_scan": _SALARIES,
    "title_counts": f"{_TITLES} UNION ALL SELECT '-----', 1 FROM (SELECT 1 FROM orders LIMIT 1)",
    "title_counts_skip": _TITLES,
    "title_counts_file": _TITLES,
    "enrol_by_admission": f"SELECT * FROM ({STUDENTS}) WHERE admission = '1-URGENT'",
    "enrol_by_admission_sex": f"""
      SELECT * FROM ({STUDENTS}) WHERE admission = '1-URGENT' AND sex = 'F'""",
    "enrol_sex_counts": f"SELECT sex, count(*) AS count FROM ({STUDENTS}) GROUP BY 1",
    "enrol_top5_courses": _top5(),
    "enrol_count_in_period": f"""
      SELECT count(*) AS n FROM ({STUDENTS}) WHERE admission = '1-URGENT' AND {_IN_1997}""",
    "enrol_age_distribution": f"""
      SELECT CAST(year(intake_date) - birth_year AS BIGINT) AS age, count(*) AS count
      FROM ({STUDENTS}) WHERE admission = '1-URGENT' GROUP BY 1""",
    "enrol_count_in_course": f"""
      SELECT count(*) AS n FROM ({STUDENTS})
      WHERE admission = '1-URGENT' AND course = 'CURSO_7'""",
    "enrol_sex_by_admission": f"""
      SELECT sex, count(*) AS count FROM ({STUDENTS}) WHERE admission = '1-URGENT' GROUP BY 1""",
    "enrol_top5_by_admission": _top5("admission = '1-URGENT'"),
    "enrol_top5_in_period": _top5(f"admission = '1-URGENT' AND {_IN_1997}"),
    "enrol_job": f"""
      WITH s AS ({STUDENTS}), a AS (SELECT * FROM s WHERE admission = '1-URGENT')
      SELECT 'students' AS collection, concat_ws('|', id, admission, sex, course) AS row FROM s
      UNION ALL SELECT 'sisu', concat_ws('|', id, admission, sex, course) FROM a
      UNION ALL SELECT 'sisu_masculino', concat_ws('|', id, admission, sex, course) FROM a WHERE sex = 'F'
      UNION ALL SELECT 'sexo', concat_ws('|', sex, count(*)) FROM s GROUP BY sex
      UNION ALL SELECT 'cursos', concat_ws('|', course, count) FROM ({_top5()})
      UNION ALL SELECT 'ages', concat_ws('|', CAST(year(intake_date) - birth_year AS BIGINT), count(*))
                FROM a GROUP BY year(intake_date) - birth_year
      UNION ALL SELECT 'sexes_by_admission', concat_ws('|', sex, count(*)) FROM a GROUP BY sex
      UNION ALL SELECT 'top_courses_by_admission', concat_ws('|', course, count)
                FROM ({_top5("admission = '1-URGENT'")})
      UNION ALL SELECT 'top_courses_in_period', concat_ws('|', course, count)
                FROM ({_top5(f"admission = '1-URGENT' AND {_IN_1997}")})
      UNION ALL SELECT 'count_in_period', CAST(count(*) AS VARCHAR) FROM a WHERE {_IN_1997}
      UNION ALL SELECT 'count_in_course', CAST(count(*) AS VARCHAR) FROM a
                WHERE course = 'CURSO_7'""",
    "cdc_decode": f"""
      SELECT id, sensor_id, sensor_type, CAST(measurement AS FLOAT) AS measurement,
             date_trunc('second', "timestamp") AS "timestamp", 'c' AS op, true AS has_row
      FROM ({SENSORS})""",
    "cdc_decode_micros": SENSORS,
    "cdc_metrics": _metrics(SENSORS, _FLOAT),
    "cdc_changes": f"SELECT op, has_row, count(*) AS n FROM ({_MIXED}) GROUP BY ALL",
    "cdc_changes_metrics": _metrics(_MIXED),
    "cdc_docs_decode": _DOCUMENTS,
    "cdc_docs_changes": f"""
      SELECT op, has_row, count(*) AS n, count(*) FILTER (WHERE has_row) AS n_id,
             count(measurement) FILTER (WHERE has_row) AS n_measured
      FROM (SELECT CASE WHEN sensor_type = 'signup' THEN 'd'
                        WHEN sensor_type <> 'purchase' THEN 'c' END AS op,
                   sensor_type NOT IN ('signup', 'purchase', 'view', 'error') AS has_row, measurement
            FROM ({SENSORS})) GROUP BY ALL""",
    "cdc_fold": _current(),
    "cdc_rows_at": _current("id <= (SELECT max(event_id) // 2 FROM events)"),
    "cdc_current_table": _current(),
    "sensor_metrics": _metrics(SENSORS),
    "sensor_classes": f"""
      SELECT {_CLASS} AS class, count(*) AS n FROM ({SENSORS}) GROUP BY 1""",
    "sensor_health": _health("sensor_id, sensor_type"),
    "sensor_buckets": _rounded_buckets(),
    "sensor_smoothing": _smoothed(),
    "sensor_online": _online("sensor_id"),
    "sensor_online_as_of": _online("sensor_id", _AS_OF),
    "sensor_outages": _OUTAGES,
    "sensor_outages_merged": _OUTAGES,
    "ingest_csv": _READINGS,
    "ingest_csv_inferred": f"""
      SELECT id, admission, sex, course, birth_year FROM ({STUDENTS})""",
    "ingest_csv_types": f"""
      SELECT "column", type, "values", blanks, before, changed_in FROM (
        SELECT 'o_orderkey' AS "column", {_whole("o_orderkey")} AS type, count(*) AS "values",
          0::BIGINT AS blanks, NULL::VARCHAR AS before, NULL::INTEGER AS changed_in FROM orders
        UNION ALL SELECT 'customer', 'string', count(*), 0, {_whole("o_custkey")}, 1998 FROM orders
        UNION ALL SELECT 'price', 'double', count(*) FILTER (o_orderstatus <> 'P'),
          count(*) FILTER (o_orderstatus = 'P'), NULL, NULL FROM orders
        UNION ALL SELECT 'placed', 'date', count(*), 0, NULL, NULL FROM orders
        UNION ALL SELECT 'o_orderstatus', 'string', count(*), 0, NULL, NULL FROM orders)""",
    "ingest_csv_by_profile": """
      SELECT o_orderkey,
        CASE WHEN year(o_orderdate) = 1998 THEN 'C-' ELSE '' END || o_custkey AS customer,
        CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice::DOUBLE, 2) END AS price,
        o_orderdate::DATE AS placed, o_orderstatus
      FROM orders""",
    "lake_compacted": _READINGS,
    "ingest_json": _READINGS,
    "ingest_json_arrays": _READINGS,
    "ingest_lake": _READINGS,
    "lake_metrics": _BOTH.format(_metrics(SENSORS)),
    "lake_health": _BOTH.format(_health("sensor_type")),
    "lake_buckets": _BOTH.format(_rounded_buckets()),
    "lake_smoothing": _BOTH.format(_smoothed()),
    "lake_online": _BOTH.format(_online("sensor_type")),
    "lake_online_as_of": _BOTH.format(_online("sensor_type", _AS_OF)),
    "lake_health_as_of": _BOTH.format(_health("sensor_type", _AS_OF)),
    "lake_sensor_health": _health("sensor_id, sensor_type"),
    "lake_sensor_online": _online("sensor_id, sensor_type"),
    "lake_rejects": f"""
      SELECT sensor_type, kind, count(*) AS n FROM (
        SELECT sensor_type, CASE WHEN sensor_type = 'purchase' THEN 'reject' ELSE 'reading' END AS kind
        FROM ({SENSORS})
        UNION ALL
        SELECT sensor_type, CASE WHEN sensor_type = 'signup' THEN 'reject' ELSE 'reading' END
        FROM ({SENSORS})) GROUP BY ALL""",
    "docs_roundtrip": SENSORS,
    "docs_append": SENSORS,
    "table_roundtrip": SENSORS,
    "migrate_table_to_docs": SENSORS,
    "migrate_docs_to_table": SENSORS,
    "migrate_metrics": _BOTH.format(_metrics(SENSORS)),
    "migrate_verify": """
      SELECT min(event_id) AS id, 'lost' AS status, 1 AS n_source, 0 AS n_target FROM events
      UNION ALL SELECT max(event_id), 'doubled', 1, 2 FROM events
      UNION ALL SELECT max(event_id), 'changed', 1, 1 FROM events
                WHERE event_id * 2 <= (SELECT max(event_id) FROM events)""",
    "migrate_resumed": SENSORS,
    "metrics_dual_sink": _BOTH.format(_metrics(SENSORS)),
    "stream_cdc_metrics": _metrics(SENSORS, _FLOAT),
    "stream_lake_metrics": _BOTH.format(_metrics(SENSORS)),
    "stream_lake_health": _BOTH.format(_health("sensor_type")),
    "stream_lake_buckets": _BOTH.format(_rounded_buckets()),
    "stream_lake_smoothing": _BOTH.format(_smoothed()),
    "stream_lake_online": _BOTH.format(_online("sensor_type")),
    "stream_late_rows": f"""
      WITH r AS (SELECT sensor_type, id % 7 = 0 AS last, "timestamp" AS seen,
                        time_bucket(INTERVAL 1 HOUR, "timestamp") AS bucket FROM ({SENSORS})),
      m AS (SELECT max(seen) FILTER (NOT last) - INTERVAL 10 MINUTE AS before,
                   max(seen) - INTERVAL 10 MINUTE AS after FROM r),
      k AS (SELECT sensor_type, bucket,
                   CASE WHEN last AND bucket + INTERVAL 1 HOUR <= before THEN 'late'
                        WHEN bucket + INTERVAL 1 HOUR <= after THEN 'closed' ELSE 'open' END AS kind
            FROM r, m)
      SELECT sensor_type, bucket, count(*) AS n, kind FROM k GROUP BY ALL""",
    "live_metrics": _BOTH.format(_metrics(SENSORS)),
    "live_health": _BOTH.format(_health("sensor_type")),
    "live_buckets": _BOTH.format(_rounded_buckets()),
    "live_smoothing": _BOTH.format(_smoothed()),
    "live_online": _BOTH.format(_online("sensor_type")),
    "stream_json_sink": SENSORS,
    "stream_docs_decode": _DOCUMENTS,
    "stream_buckets": _rounded_buckets(_CLOSED),
    "stream_smoothing": _smoothed(_CLOSED),
    "stream_online": _online("sensor_id"),
    "stream_health": _health("sensor_id, sensor_type"),
}
