"""The same results in DuckDB SQL, written from the definitions and not from the plans."""

from __future__ import annotations

from datetime import datetime, timedelta

from emberlog.plans.queries import (
    CUT,
    FIRST,
    LAST,
    LIVE_NOW,
    LIVE_SINCE,
    LIVE_UNTIL,
    NOON,
    PAGE,
    SINCE,
    UNTIL,
)
from emberlog.schema import BUCKET_SECONDS, DEFAULT_LOOKBACK


def ts(value: datetime) -> str:
    return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S}'"


def iso(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%dT%H:%M:%S.%gZ')"


LOGS = """
logs AS (
  SELECT event_id,
         lpad(CAST(event_id AS VARCHAR), 12, '0') AS id,
         date_trunc('milliseconds', ts) AS timestamp,
         CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn'
                         WHEN 'view' THEN 'debug' ELSE 'info' END AS level,
         (['signals', 'switches', 'ticketing', 'platforms', 'rolling-stock', 'power',
           'timetable'])[user_id % 7 + 1] AS service,
         CASE WHEN event_id % 3 = 0 THEN upper(text) ELSE text END AS message,
         lower(text) AS message_lower,
         CAST(user_id AS VARCHAR) AS user_id,
         (['north', 'coast', 'valley', 'summit'])[user_id % 4 + 1] AS region,
         CAST(event_id % 5 AS VARCHAR) AS retries,
         json_extract_string(props, '$.k') AS k
  FROM (SELECT *, (['train departed', 'door sensor stuck', 'fare gate closed',
                    'axle counter reset', 'platform display stale', 'brake test passed',
                    'signal lamp replaced', 'timetable reloaded',
                    'overhead line voltage low'])[event_id % 9 + 1] AS text
        FROM events)
)"""

LOG_ROW = f"id, {iso('timestamp')} AS timestamp, level, service, message, user_id, region, retries, k"

IN_RANGE = f"timestamp >= {ts(SINCE)} AND timestamp < {ts(UNTIL)}"

CLOCK = "TIMESTAMP '2024-01-31 00:00:00'"
OLDEST = f"({CLOCK} - INTERVAL 20 DAY)"


def _reason(check_age: bool) -> str:
    age = (
        f"WHEN timestamp < {OLDEST} THEN "
        "'timestamp is older than the retention window (20 days)'"
        if check_age
        else ""
    )
    return f"""
      CASE WHEN event_id % 12 = 0 THEN 'entry must be an object'
           WHEN event_id % 12 IN (1, 3) THEN 'invalid timestamp'
           WHEN event_id % 12 = 10 THEN 'timestamp is more than 5 minutes in the future'
           {age}
           WHEN event_id % 12 = 2 THEN 'Invalid level: x' || level
           WHEN event_id % 12 = 4 THEN 'service should be a notNull string'
           WHEN event_id % 12 = 9 THEN 'message should be a notNull string'
           WHEN event_id % 12 IN (5, 6) THEN 'attributes must be a flat object'
      END"""


CHECKED = f"""{LOGS}, checked AS (
  SELECT *, event_id // 100 AS number, CAST(event_id // 100 AS VARCHAR) AS envelope,
         CAST(event_id % 100 AS INTEGER) AS index, {_reason(True)} AS reason
  FROM logs
), accepted AS (SELECT * FROM checked WHERE reason IS NULL)"""

STALE_OK = f"""{LOGS}, checked AS (
  SELECT *, {_reason(False)} AS reason FROM logs
)"""

#: The odd envelope put next to every good one, by number % 4.
ODD = """odd AS (
  SELECT number, 'odd-' || number AS envelope,
         CASE WHEN number % 4 IN (0, 2) THEN 'request body must be { logs: [...] }'
              WHEN number % 4 = 1 THEN 'Malformed JSON' END AS error
  FROM (SELECT DISTINCT event_id // 100 AS number FROM events)
)"""


def q(body: str, base: str = LOGS) -> str:
    return f"WITH {base} {body}"


ENTRY_ROWS = f"""
SELECT CAST(event_id % 100 AS INTEGER) AS index,
       CASE event_id % 12 WHEN 0 THEN 'STRING' WHEN 1 THEN 'ARRAY' ELSE 'OBJECT' END AS kind,
       CASE WHEN event_id % 12 = 3 THEN 'bad' || substr({iso('timestamp')}, 5)
            WHEN event_id % 12 = 10 THEN '2031' || substr({iso('timestamp')}, 5)
            WHEN event_id % 12 > 1 THEN {iso('timestamp')} END AS timestamp,
       CASE WHEN event_id % 12 = 2 THEN 'x' || level
            WHEN event_id % 12 > 1 THEN level END AS level,
       CASE WHEN event_id % 12 = 4 THEN '  '
            WHEN event_id % 12 > 1 THEN service END AS service,
       CASE WHEN event_id % 12 = 9 THEN ''
            WHEN event_id % 12 > 1 THEN message END AS message,
       CAST(CASE event_id % 12 WHEN 5 THEN 5 WHEN 8 THEN 6
            WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 6 THEN NULL WHEN 7 THEN NULL
            ELSE 4 END AS BIGINT) AS n_attributes
FROM logs"""


def rollup(grain: str, where: str = "true", table: str = "logs") -> str:
    return f"""
    SELECT {iso(f"date_trunc('{grain}', timestamp)")} AS bucket, service, level,
           count(*) AS count
    FROM {table} WHERE {where} GROUP BY ALL"""


def both_rollups(where_hour: str = "true", where_minute: str = "true") -> str:
    hour, minute = rollup("hour", where_hour), rollup("minute", where_minute)
    return f"SELECT *, 'hour' AS grain FROM ({hour}) UNION ALL SELECT *, 'minute' FROM ({minute})"


def start_of(bucket: str, column: str = "timestamp") -> str:
    width = {"1m": "1 minute", "5m": "5 minutes", "1h": "1 hour", "1d": "1 day"}[bucket]
    return f"time_bucket(INTERVAL '{width}', {column}, TIMESTAMP '2000-01-01')"


def counts(bucket: str, group: str | None = None, where: str = IN_RANGE) -> str:
    key = group or "CAST(NULL AS VARCHAR)"
    return f"""
    SELECT {iso(start_of(bucket))} AS start, {key} AS "group", count(*) AS count
    FROM logs WHERE {where} GROUP BY 1, 2"""


def rolled(grain: str, bucket: str, group: str | None = None, extra: str = "true") -> str:
    start = f"date_trunc('{grain}', timestamp)"
    return counts(bucket, group, f"{start} >= {ts(SINCE)} AND {start} < {ts(UNTIL)} AND {extra}")


def _ms(value: datetime) -> int:
    return int((value - datetime(1970, 1, 1)).total_seconds() * 1000)


def dense(bucket: str, group: str | None, since: datetime, until: datetime) -> str:
    step = BUCKET_SECONDS[bucket] * 1000
    slots = int((_ms(until) - _ms(since)) / step + 0.5)
    where = f"timestamp >= {ts(since)} AND timestamp < {ts(until)}"
    found = counts(bucket, group, where).replace(iso(start_of(bucket)), start_of(bucket))
    groups = {
        None: "SELECT 'all' AS name",
        "level": "SELECT unnest(['debug', 'info', 'warn', 'error']) AS name",
        "service": 'SELECT DISTINCT "group" AS name FROM found',
    }[group]
    key = '"group"' if group else "'all'"
    return f"""
    , found AS ({found})
    , grid AS (SELECT name, slot FROM ({groups}), range({slots}) AS r(slot))
    , placed AS (SELECT {key} AS name,
                        CAST(floor((epoch_ms(start) - {_ms(since)}) / {step} + 0.5) AS BIGINT)
                          AS slot, count FROM found)
    SELECT grid.name AS "group", CAST(grid.slot AS BIGINT) AS slot,
           {iso(f"{ts(since)} + INTERVAL (grid.slot * {step // 1000}) SECOND")} AS start,
           CAST(coalesce(sum(placed.count), 0) AS BIGINT) AS count
    FROM grid LEFT JOIN placed ON grid.name = placed.name AND grid.slot = placed.slot
    GROUP BY 1, 2, 3"""


def _default_ranges() -> str:
    parts = []
    for bucket, lookback in DEFAULT_LOOKBACK.items():
        since = NOON - timedelta(seconds=lookback * BUCKET_SECONDS[bucket])
        inner = f"WITH {LOGS} {dense(bucket, 'level', since, NOON)}"
        parts.append(f"SELECT *, '{bucket}' AS bucket FROM ({inner})")
    return " UNION ALL ".join(parts)


def share(key: str, names: str, where: str) -> str:
    return f"""
    , c AS (SELECT names.name, count(logs.id) AS count
            FROM ({names}) AS names LEFT JOIN (SELECT * FROM logs WHERE {where}) AS logs
              ON logs.{key} = names.name GROUP BY 1)
    SELECT name, count,
           CAST(floor(count / (SELECT greatest(max(count), 1) FROM c) * 100 + 0.5) AS BIGINT)
             AS pct
    FROM c"""


CUTOFF = CUT - timedelta(days=20)
CUT_DAY = f"DATE '{CUTOFF:%Y-%m-%d}'"
DAY = "CAST(timestamp AS DATE)"
PARKED = f"""{LOGS}, parked AS (SELECT * FROM logs WHERE event_id % 50 = 0),
stored AS (SELECT * FROM logs WHERE event_id % 50 <> 0),
moved AS (SELECT * FROM parked WHERE CAST({DAY} AS TIMESTAMP) >= {ts(CUTOFF)})"""

PARTITION = f"'logs_' || strftime({DAY}, '%Y_%m_%d')"

DEAD = f"""{LOGS}, dead AS (
  SELECT event_id // 100 AS number, count(*) AS entries,
         max(CASE WHEN (event_id // 100) % 3 = 0 AND event_id % 100 = 7 THEN 1 ELSE 0 END)
           AS spoiled
  FROM logs GROUP BY 1
)"""

DRIFT = """
SELECT {bucket} AS bucket, service, level, count(*) AS raw,
       count(*) FILTER (event_id % 3 <> 2) AS rollup
FROM logs GROUP BY 1, 2, 3 HAVING count(*) FILTER (event_id % 3 = 2) > 0"""

REPORT = f"""
SELECT 'by_level' AS section, level AS name, count(*) AS rows, CAST(NULL AS VARCHAR) AS text
FROM logs GROUP BY level
UNION ALL SELECT 'by_service', service, count(*), NULL FROM logs GROUP BY service
UNION ALL SELECT 'totals', 'rows', count(*), NULL FROM logs
UNION ALL SELECT 'time_range', 'oldest', NULL, {iso('min(timestamp)')} FROM logs
UNION ALL SELECT 'time_range', 'newest', NULL, {iso('max(timestamp)')} FROM logs
UNION ALL SELECT 'ingestion_rate', 'last_1m',
                 count(*) FILTER (timestamp >= {ts(NOON)} - INTERVAL 1 MINUTE), NULL FROM logs
UNION ALL SELECT 'ingestion_rate', 'last_5m',
                 count(*) FILTER (timestamp >= {ts(NOON)} - INTERVAL 5 MINUTE), NULL FROM logs
UNION ALL SELECT 'ingestion_rate', 'per_second_1m', NULL,
                 printf('%.2f', round(count(*) FILTER (
                   timestamp >= {ts(NOON)} - INTERVAL 1 MINUTE) / 60, 2)) FROM logs
UNION ALL SELECT 'partitions', {PARTITION}, count(*), NULL FROM logs GROUP BY {DAY}
UNION ALL SELECT 'store', 'bytes', NULL, NULL
UNION ALL SELECT 'retention_config', 'retention_days', 20, NULL
UNION ALL SELECT 'retention_config', 'partition_lookahead_days', 7, NULL"""


def newest(where: str, limit: int, offset: int = 0) -> str:
    return f"""SELECT {LOG_ROW} FROM (
      SELECT * FROM logs WHERE {where}
      ORDER BY timestamp DESC, id DESC LIMIT {limit} OFFSET {offset})"""


MINUTES = "TIMESTAMP '2024-01-01' + INTERVAL ({number}) MINUTE"

ORACLE: dict[str, str] = {
    "s1_read_batches": q(ENTRY_ROWS),
    "s1_refused_envelopes": q(
        "SELECT error, count(*) AS count FROM odd WHERE error IS NOT NULL GROUP BY error", ODD
    ),
    "s2_scan_logs": q(f"SELECT {LOG_ROW} FROM logs WHERE {IN_RANGE}"),
    "s3_scan_rollup_hour": q(
        rollup("hour", IN_RANGE.replace("timestamp", "date_trunc('hour', timestamp)"))
    ),
    "s3_scan_rollup_minute": q(
        rollup("minute", IN_RANGE.replace("timestamp", "date_trunc('minute', timestamp)"))
    ),
    "s4_stream_batches": q(ENTRY_ROWS),
    "v1_validate_entries": q("SELECT event_id, reason FROM checked", CHECKED),
    "v1_validate_allow_stale": q("SELECT event_id, reason FROM checked", STALE_OK),
    "v2_accepted": q(
        f"SELECT envelope, index, {iso('timestamp')} AS timestamp, level, service, message "
        "FROM accepted",
        CHECKED,
    ),
    "v2_rejected": q(
        "SELECT envelope, index, reason FROM checked WHERE reason IS NOT NULL", CHECKED
    ),
    "v3_batch_report": q(
        """
        SELECT envelope, count(*) FILTER (reason IS NULL) AS accepted,
               count(*) FILTER (reason IS NOT NULL) AS n_rejected,
               CAST(NULL AS VARCHAR) AS error,
               CAST(CASE WHEN count(*) FILTER (reason IS NULL) > 0 THEN 200 ELSE 400 END AS BIGINT)
                 AS status
        FROM checked GROUP BY envelope
        UNION ALL SELECT envelope, 0, 0, error, 400 FROM odd""",
        f"{CHECKED}, {ODD}",
    ),
    "v4_normalize_attributes": q(
        """
        SELECT event_id,
               CAST(CASE event_id % 12 WHEN 7 THEN 0 WHEN 8 THEN 6 ELSE 4 END AS BIGINT) AS n_keys,
               CASE WHEN event_id % 12 <> 7 THEN user_id END AS user_id,
               CASE WHEN event_id % 12 <> 7 THEN region END AS region,
               CASE WHEN event_id % 12 <> 7 THEN retries END AS retries,
               CASE WHEN event_id % 12 <> 7 THEN k END AS k,
               CASE WHEN event_id % 12 = 8 THEN '3' END AS f,
               CASE WHEN event_id % 12 = 8 THEN 'false' END AS b
        FROM accepted""",
        CHECKED,
    ),
    "v5_stale_filter": q(
        f"SELECT id, timestamp < {ts(NOON)} - INTERVAL 168 HOUR AS stale FROM logs"
    ),
    "v6_backfill_report": q(
        f"""
        SELECT count(*) FILTER (reason IS NULL AND timestamp >= {OLDEST}) AS accepted,
               count(*) FILTER (reason IS NULL AND timestamp < {OLDEST}) AS discarded,
               count(*) FILTER (reason IS NOT NULL) AS rejected,
               CAST(200 AS BIGINT) AS status
        FROM checked""",
        STALE_OK,
    ),
    "v6_backfill_dates": q(f"SELECT DISTINCT CAST({DAY} AS VARCHAR) AS dt FROM accepted", CHECKED),
    "v6_backfill": q(
        'SELECT count(*) AS "rows", count(*) AS hour_count, count(*) AS minute_count, '
        "count(*) AS ids FROM accepted",
        CHECKED,
    ),
    "v6_backfill_rejected": q(
        """
        SELECT CAST(event_id // 100 AS VARCHAR) AS envelope,
               CAST(event_id % 100 AS INTEGER) AS index, reason
        FROM checked WHERE reason IS NOT NULL""",
        STALE_OK,
    ),
    "v7_derive_columns": q(
        f"""
        SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' ||
               substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id,
               {iso('timestamp')} AS timestamp, message_lower, CAST({DAY} AS VARCHAR) AS dt
        FROM (SELECT *, md5(envelope || '/' || CAST(index AS VARCHAR)) AS h FROM accepted)""",
        CHECKED,
    ),
    "w1_append_logs": q(f"SELECT {LOG_ROW} FROM logs"),
    "w2_rollup_increment_hour": q(rollup("hour")),
    "w3_rollup_increment_minute": q(rollup("minute")),
    "w4_rollup_rebuild": q(both_rollups()),
    "w5_dead_letter_write": q(
        "SELECT 'dead-1' AS dead_id, 'simulated failure' AS reason, level, service, "
        "count(*) AS count FROM logs GROUP BY ALL"
    ),
    "w6_dead_letter_list": q(
        f"""
        SELECT 'dead-' || lpad(CAST(number AS VARCHAR), 8, '0') AS id,
               {iso(f"{CLOCK} - INTERVAL (number) MINUTE")} AS failed_at,
               'simulated failure' AS reason, entries AS n_entries
        FROM dead""",
        DEAD,
    ),
    "w6_dead_letter_entries": q(
        f"""
        SELECT 'dead-' || lpad(CAST(event_id // 100 AS VARCHAR), 8, '0') AS id, id AS entry_id,
               {iso('timestamp')} AS timestamp,
               CASE WHEN (event_id // 100) % 3 = 0 AND event_id % 100 = 7 THEN 'not-a-real-level'
                    ELSE level END AS level, service, message
        FROM logs"""
    ),
    "w7_dead_letter_replay": q(
        """
        SELECT count(*) FILTER (spoiled = 0) AS replayed,
               count(*) FILTER (spoiled = 1) AS still_failed,
               (SELECT count(*) FROM dead) - count(*) FILTER (spoiled = 0) AS waiting,
               CAST(coalesce(sum(entries) FILTER (spoiled = 0), 0) AS BIGINT) AS "rows",
               CAST(coalesce(sum(entries) FILTER (spoiled = 0), 0) AS BIGINT) AS hour_count,
               CAST(coalesce(sum(entries) FILTER (spoiled = 0), 0) AS BIGINT) AS minute_count,
               CAST(coalesce(sum(entries) FILTER (spoiled = 0), 0) AS BIGINT) AS ids
        FROM dead""",
        DEAD,
    ),
    "w8_flush_batch": q(
        """SELECT 2 * count(*) AS "rows", 2 * count(*) AS hour_count,
                  2 * count(*) AS minute_count, 2 * count(*) AS ids FROM accepted""",
        CHECKED,
    ),
    "w9_compact_day": q(
        f"""
        SELECT id, {iso('timestamp')} AS timestamp, level, service,
               CAST(NULL AS VARCHAR) AS grain, CAST(1 AS BIGINT) AS count FROM logs
        UNION ALL SELECT NULL, bucket, level, service, 'hour', count FROM ({rollup('hour')})"""
    ),
    "f1_by_service": q(f"SELECT {LOG_ROW} FROM logs WHERE service = 'signals'"),
    "f2_by_level": q(f"SELECT {LOG_ROW} FROM logs WHERE level = 'error'"),
    "f3_by_time": q(f"SELECT {LOG_ROW} FROM logs WHERE {IN_RANGE}"),
    "f4_by_message": q(f"SELECT {LOG_ROW} FROM logs WHERE message ILIKE '%si%ced%'"),
    "f5_by_attribute": q(
        f"SELECT {LOG_ROW} FROM logs WHERE region = 'valley' AND retries = '3'"
    ),
    "f6_all_filters": q(
        f"SELECT {LOG_ROW} FROM logs WHERE service = 'platforms' AND level = 'info' "
        f"AND {IN_RANGE} AND message ILIKE '%re%' AND retries = '2'"
    ),
    "f6_no_filters": q(f"SELECT {LOG_ROW} FROM logs"),
    "f4_by_message_documents": """
        SELECT CAST(doc_id AS VARCHAR) AS id, source AS service,
               (['debug', 'info', 'warn', 'error'])[doc_id % 4 + 1] AS level,
               CAST(length(text) AS INTEGER) AS n_chars
        FROM documents WHERE lower(text) LIKE '%the_%'""",
    "f4_by_message_conversations": """
        SELECT conv_id || '-' || turn AS id, role AS service,
               CAST(length(text) AS INTEGER) AS n_chars
        FROM conversations WHERE lower(text) LIKE '%que %'""",
    "f4_by_message_summary": q(
        " UNION ALL ".join(
            f"SELECT {LOG_ROW}, '{text}' AS q FROM logs WHERE message ILIKE '%{text}%'"
            for text in ("timetable", "Si%Ced", "c_")
        )
    ),
    "f7_project_log": q(f"SELECT {LOG_ROW} FROM logs"),
    "q1_search_logs": q(newest("true", 100)),
    "q1_search_service_level": q(
        newest(f"service = 'switches' AND level = 'error' AND {IN_RANGE}", 40)
    ),
    "q1_search_message_attribute": q(
        newest(
            f"message ILIKE '%sensor%' AND region = 'coast' AND timestamp < {ts(UNTIL)}", 50
        )
    ),
    "q1_search_documents": f"""
        SELECT CAST(doc_id AS VARCHAR) AS id, {iso(MINUTES.format(number='doc_id'))} AS timestamp,
               source AS service
        FROM (SELECT * FROM documents WHERE lower(text) LIKE '%ation%' AND doc_id % 4 = 2
              ORDER BY doc_id DESC LIMIT 25)""",
    "q2_search_page": q(newest("service = 'timetable'", PAGE, 2 * PAGE)),
    "q2_walk_pages": q(
        f"""SELECT {LOG_ROW}, CAST((place - 1) // 1000 AS INTEGER) AS page FROM (
          SELECT *, row_number() OVER (ORDER BY timestamp DESC, id DESC) AS place FROM logs
          WHERE service = 'signals' AND level = 'error' AND {IN_RANGE})"""
    ),
    "q3_next_cursor": q(
        f"""
        SELECT timestamp, id,
               to_base64(encode('{{"timestamp":"' || timestamp || '","id":"' || id || '"}}'))
                 AS cursor
        FROM ({newest("level = 'warn'", 1, PAGE - 1)})"""
    ),
    "q4_first_rows": q(
        f'SELECT * FROM ({counts("1h", "service")}) ORDER BY start, "group" LIMIT 50'
    ),
    "q5_tail_last": q(
        f"""
        SELECT {iso('timestamp')} AS timestamp, level, service, message
        FROM (SELECT * FROM logs WHERE service = 'rolling-stock' AND level = 'warn'
              ORDER BY timestamp DESC, message DESC LIMIT 120)"""
    ),
    "a1_time_bucket": q(
        f"""
        SELECT id, {iso(start_of('1m'))} AS minute, {iso(start_of('5m'))} AS five_minutes,
               {iso(start_of('1h'))} AS hour, {iso(start_of('1d'))} AS day
        FROM logs"""
    ),
    "a2_bucket_counts_1m": q(counts("1m")),
    "a2_bucket_counts_5m": q(counts("5m", None, f"{IN_RANGE} AND service = 'ticketing'")),
    "a2_bucket_counts_1h": q(counts("1h", None, f"{IN_RANGE} AND message ILIKE '%closed%'")),
    "a2_bucket_counts_1d": q(counts("1d", None, f"{IN_RANGE} AND region = 'summit'")),
    "a3_bucket_counts_by_service": q(counts("1h", "service")),
    "a3_bucket_counts_by_level": q(
        counts("5m", "level", f"{IN_RANGE} AND message ILIKE '%stale%'")
    ),
    "a4_hourly_rollup_1h": q(rolled("hour", "1h", "service")),
    "a4_hourly_rollup_1h_level": q(rolled("hour", "1h", None, "level = 'error'")),
    "a5_hourly_rollup_1d": q(rolled("hour", "1d", "level")),
    "a6_minute_rollup_1m": q(rolled("minute", "1m", "level", "service = 'switches'")),
    "a7_minute_rollup_5m": q(rolled("minute", "5m", "service")),
    "a8_aggregate_1m": q(counts("1m", "level")),
    "a8_aggregate_5m": q(counts("5m", None, f"{IN_RANGE} AND service = 'power'")),
    "a8_aggregate_1h": q(counts("1h", "service")),
    "a8_aggregate_1d": q(counts("1d", None, f"{IN_RANGE} AND level = 'warn'")),
    "a8_aggregate_1d_by_service": q(counts("1d", "service")),
    "a8_aggregate_message": q(
        counts("1d", "service", f"{IN_RANGE} AND message ILIKE '%sensor_%'")
    ),
    "a8_aggregate_attribute": q(counts("1h", None, f"{IN_RANGE} AND retries = '4'")),
    "a9_live_window": q(
        counts(
            "1m",
            "service",
            f"date_trunc('minute', timestamp) >= {ts(LIVE_NOW - timedelta(minutes=13, seconds=30))}"
            f" AND date_trunc('minute', timestamp) < {ts(LIVE_NOW)}",
        )
    ),
    "a8_aggregate_live": q(
        counts("1m", "service", f"timestamp >= {ts(LIVE_SINCE)} AND timestamp < {ts(LIVE_UNTIL)}")
    ),
    "t1_count_by_level": q("SELECT level, count(*) AS count FROM logs GROUP BY level"),
    "t2_count_by_service": q("SELECT service, count(*) AS count FROM logs GROUP BY service"),
    "t3_total_rows": q('SELECT count(*) AS "rows" FROM logs'),
    "t4_time_range": q(
        f"SELECT {iso('min(timestamp)')} AS oldest, {iso('max(timestamp)')} AS newest FROM logs"
    ),
    "t5_ingestion_rate": q(
        f"""
        SELECT last_1m, last_5m, round(last_1m / 60, 2) AS per_second_1m FROM (
          SELECT count(*) FILTER (timestamp >= {ts(NOON)} - INTERVAL 1 MINUTE) AS last_1m,
                 count(*) FILTER (timestamp >= {ts(NOON)} - INTERVAL 5 MINUTE) AS last_5m
          FROM logs)"""
    ),
    "t6_partition_stats": q(
        f"""
        SELECT {PARTITION} AS name, CAST({DAY} AS VARCHAR) AS "from",
               CAST({DAY} + 1 AS VARCHAR) AS "to", count(*) AS "rows", true AS has_bytes
        FROM logs GROUP BY {DAY}"""
    ),
    "t7_store_bytes": "SELECT true AS agrees",
    "t8_store_report": q(REPORT),
    "r1_drop_expired": q(
        f"""
        SELECT {PARTITION} AS name,
               CASE WHEN {DAY} >= {CUT_DAY} THEN count(*) END AS "rows", {DAY} < {CUT_DAY} AS dropped
        FROM logs GROUP BY {DAY}"""
    ),
    "r2_prune_rollups": q(
        both_rollups(
            f"date_trunc('hour', timestamp) >= {ts(CUTOFF)}",
            f"date_trunc('minute', timestamp) >= {ts(CUTOFF)}",
        )
    ),
    "r3_stray_days": q(f"SELECT DISTINCT CAST({DAY} AS VARCHAR) AS day FROM parked", PARKED),
    "r4_backfill_day": q(
        f"""
        SELECT n AS moved, CAST(0 AS BIGINT) AS moved_again, n + s AS "rows", n + s AS hour_count,
               n + s AS minute_count
        FROM (SELECT count(*) AS n FROM parked WHERE {DAY} = DATE '2024-01-12'),
             (SELECT count(*) AS s FROM stored)""",
        PARKED,
    ),
    "r5_reconcile_stray": q(
        f"""
        SELECT p - m AS deleted, days AS backfilled, m + s AS "rows", m + s AS hour_count,
               m + s AS minute_count
        FROM (SELECT count(*) AS p FROM parked), (SELECT count(*) AS m FROM moved),
             (SELECT count(*) AS s FROM stored),
             (SELECT string_agg(name, ',' ORDER BY name) AS days
              FROM (SELECT DISTINCT {PARTITION} AS name FROM moved))""",
        PARKED,
    ),
    "r6_retain": q(
        f"""
        SELECT (SELECT count(DISTINCT {DAY}) FROM stored WHERE {DAY} < {CUT_DAY}) AS dropped,
               (SELECT count(*) FROM parked) - m AS deleted,
               (SELECT count(DISTINCT {DAY}) FROM moved) AS backfilled,
               m + (SELECT count(*) FROM stored WHERE {DAY} >= {CUT_DAY}) AS "rows",
               m + (SELECT count(*) FROM stored
                    WHERE date_trunc('hour', timestamp) >= {ts(CUTOFF)}) AS hour_count,
               m + (SELECT count(*) FROM stored
                    WHERE date_trunc('minute', timestamp) >= {ts(CUTOFF)}) AS minute_count
        FROM (SELECT count(*) AS m FROM moved)""",
        PARKED,
    ),
    "st1_ingest_stream": q(
        f"""
        SELECT *, 'hour' AS part, CAST(NULL AS VARCHAR) AS reason
        FROM ({rollup('hour', 'true', 'accepted')})
        UNION ALL SELECT *, 'raw', NULL FROM ({rollup('hour', 'true', 'accepted')})
        UNION ALL SELECT NULL, NULL, NULL, count(*), 'rejected', reason
        FROM checked WHERE reason IS NOT NULL GROUP BY reason""",
        CHECKED,
    ),
    "st2_live_counts_stream": q(rollup("minute")),
    "st2_live_counts_window": q(
        rollup("minute", f"timestamp >= {ts(LIVE_NOW - timedelta(minutes=14, seconds=30))}")
    ),
    "st2_live_state_stream": q(
        rollup(
            "minute",
            "date_trunc('minute', timestamp) > "
            "(SELECT date_trunc('minute', max(timestamp)) FROM logs) - INTERVAL 15 MINUTE",
        )
    ),
    "st3_live_tail": q(
        f"""
        SELECT {iso('timestamp')} AS timestamp, level, service, message, user_id
        FROM logs WHERE service = 'rolling-stock' AND level = 'warn'"""
    ),
    "d1_dense_series": q(dense("1h", None, SINCE, UNTIL)),
    "d1_dense_series_by_level": q(dense("1h", "level", SINCE, UNTIL)),
    "d1_dense_series_by_service": q(dense("1h", "service", SINCE, UNTIL)),
    "d1_dense_series_many_slots": q(dense("5m", "level", FIRST, LAST)),
    "d2_group_ranking": q(
        f'SELECT service AS "group", count(*) AS count FROM logs WHERE {IN_RANGE} GROUP BY 1'
    ),
    "d3_peak": (
        f"SELECT greatest(max(count), 1) AS peak FROM (WITH {LOGS} "
        f"{dense('1h', 'level', SINCE, UNTIL)})"
    ),
    "d4_share_of_max_level": q(
        share("level", "SELECT unnest(['debug', 'info', 'warn', 'error']) AS name", "true")
    ),
    "d4_share_of_max_service": q(
        share("service", "SELECT DISTINCT service AS name FROM logs", "true")
    ),
    "d5_default_range": _default_ranges(),
    "c1_rollup_drift_hour": q(DRIFT.format(bucket=iso("date_trunc('hour', timestamp)"))),
    "c1_rollup_drift_minute": q(DRIFT.format(bucket=iso("date_trunc('minute', timestamp)"))),
    "c1_rollup_drift_day": q(DRIFT.format(bucket=iso("date_trunc('day', timestamp)"))),
    "c1_no_drift": "SELECT CAST(0 AS BIGINT) AS differences",
    "c2_run_visibility": q(
        f"SELECT count(*) AS visible FROM logs WHERE event_id % 4 = 2 AND {IN_RANGE}"
    ),
    "flagship": q(counts("1h", "service", "true")),
}
ORACLE["w3_rollup_increment_day"] = q(rollup("day"))
ORACLE["a9_live_counts"] = ORACLE["a9_live_window"]
