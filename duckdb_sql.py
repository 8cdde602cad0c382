"""DuckDB SQL for every registered query: the same rules, stated a second time in SQL.

Each text is a chain of CTEs over the given tables, ending in the query. Money and
ratios leave both engines as DOUBLE. Means are rounded half up in whole cents, so
that ties cannot fall differently.
"""

from __future__ import annotations

from gantry.schemas import CLASS_SEED, PLAZA_SEED, seed_rows
from gantry.sources.testdata import PLATE_LETTERS, STATE_CODES

AS_OF = "DATE '2024-01-30'"
DAY_KEY = 20240130
NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def _id(prefix: str, number: str, width: int) -> str:
    text = f"CAST({number} AS VARCHAR)"
    return f"'{prefix}' || lpad({text}, CAST(greatest({width}, length({text})) AS INTEGER), '0')"


def _mean(amount: str) -> str:
    """Mean of a non-negative money column, half up to cents."""
    cents, n = f"SUM(CAST({amount} * 100 AS BIGINT))", f"COUNT({amount})"
    return f"CAST((2 * CAST({cents} AS HUGEINT) + {n}) // (2 * {n}) AS DOUBLE) / 100"


def _total(amount: str) -> str:
    return f"CAST(SUM({amount}) AS DOUBLE)"


def _list(values) -> str:
    return f"[{', '.join(repr(v) for v in values)}]"


def _from_spark(array: str) -> str:
    """The adapter's array literal as a list."""
    return f"[{array.removeprefix('array(').removesuffix(')')}]"


_PLAZAS, _CLASSES = seed_rows(PLAZA_SEED), seed_rows(CLASS_SEED)
_LISTED = "('TAG-00042', 'TAG-00099', 'TAG-00315')"
_DATE_ID = "CAST(year({0}) * 10000 + month({0}) * 100 + day({0}) AS INTEGER)"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "copies": ((), """
        SELECT *, unnest(CASE WHEN event_id % 50 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM events"""),
    "shaped": (("copies",), f"""
        SELECT event_id,
            CASE WHEN copy = 0 AND event_id % 97 = 1 THEN NULL ELSE {_id('TX-', 'event_id', 8)} END AS transaction_id,
            CASE WHEN copy = 0 AND event_id % 83 = 1 THEN NULL ELSE ts END AS event_ts,
            {_id('PL', '(user_id % 6 + 1)', 3)} AS plaza_id,
            CASE WHEN event_id % 10 <> 3 THEN {_list(r[1] for r in _PLAZAS)}[user_id % 6 + 1] END AS plaza_name,
            CASE WHEN event_id % 10 <> 3 THEN {_list(r[2] for r in _PLAZAS)}[user_id % 6 + 1] END AS highway,
            CASE WHEN copy = 0 AND event_id % 89 = 1 THEN NULL ELSE {_id('TAG-', 'user_id', 5)} END AS tag_id,
            CASE WHEN event_id % 10 <> 3 THEN
                {_from_spark(STATE_CODES)}[user_id % 10 + 1]
                || lpad(CAST(user_id % 99 + 1 AS VARCHAR), 2, '0')
                || {_from_spark(PLATE_LETTERS)}[(user_id + CASE WHEN day(ts) > 15 THEN 1 ELSE 0 END) % 8 + 1]
                || CAST(user_id % 9000 + 1000 AS VARCHAR) END AS vehicle_no,
            'C' || CAST(event_id % 6 + 1 AS VARCHAR) AS class_id,
            CASE WHEN event_id % 10 <> 3 THEN {_list(r[1] for r in _CLASSES)}[event_id % 6 + 1] END AS class_name,
            CAST(CAST(value AS DECIMAL(10,2)) * 12 - 5 AS DECIMAL(10,2)) AS amount,
            CAST(CAST(event_id * 3701 % 200000 AS DECIMAL(10,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(10,2))
                AS balance_before,
            CAST(event_id % 6 + 1 AS INTEGER) AS lane, copy,
            CASE WHEN copy = 0 AND event_id % 83 = 1 THEN NULL WHEN event_type = 'error' THEN NULL
                ELSE ts + to_seconds(CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER)) END AS exit_time,
            ts + CASE WHEN event_id % 61 = 1 THEN INTERVAL 36 HOURS ELSE INTERVAL 5 SECONDS END
               + CASE WHEN copy = 0 THEN INTERVAL 0 SECONDS ELSE INTERVAL 60 SECONDS END AS ingested_at
        FROM copies"""),
    "raw": (("shaped",), f"""
        SELECT *,
            CASE WHEN balance_before < amount THEN CAST(0 AS DECIMAL(10,2))
                ELSE CAST(balance_before - amount AS DECIMAL(10,2)) END AS balance_after,
            CASE WHEN tag_id IN {_LISTED} THEN 'FLAGGED'
                 WHEN balance_before < amount THEN 'LOW_BALANCE' ELSE 'SUCCESS' END AS ruled,
            CASE WHEN event_id % 71 = 1 THEN 'FAILED' WHEN event_id % 73 = 1 AND copy = 0 THEN NULL ELSE ruled END AS status
        FROM shaped"""),
    "valid": (("raw",), f"""
        SELECT * REPLACE (CASE WHEN tag_id IN {_LISTED} THEN 'FLAGGED' ELSE status END AS status),
            {_DATE_ID.format('event_ts')} AS date_id, CAST(hour(event_ts) AS INTEGER) AS hour
        FROM raw
        WHERE transaction_id IS NOT NULL AND tag_id IS NOT NULL AND event_ts IS NOT NULL AND status IS NOT NULL
            AND amount BETWEEN 0 AND 5000"""),
    "clean": (("valid",), """
        SELECT * FROM valid
        QUALIFY row_number() OVER (PARTITION BY date_id, transaction_id ORDER BY event_ts, ingested_at, amount,
            status, plaza_id, tag_id, class_id, lane, exit_time) = 1"""),
    "dim_payment": ((), """
        SELECT * FROM (VALUES (1, 'FASTAG', 'SUCCESS'), (2, 'FASTAG', 'LOW_BALANCE'), (3, 'FASTAG', 'FLAGGED'),
            (4, 'CASH', 'SUCCESS'), (5, 'CARD', 'SUCCESS'), (6, 'CARD', 'FAILED')) AS t(payment_id, method, status)"""),
    "dim_class": ((), f"""
        SELECT * FROM (VALUES {", ".join(f"('{i}', '{n}', CAST({rate} AS DECIMAL(8,2)))" for i, n, _, rate in _CLASSES)})
            AS t(class_id, name, base_rate)"""),
    "dim_plaza": ((), f"""
        SELECT *, CAST(1 AS SMALLINT) AS active
        FROM (VALUES {", ".join(f"('{i}', '{n}', '{h}', '{st}', '{op}')" for i, n, h, st, _, _, op, _ in _PLAZAS)})
            AS t(plaza_id, name, highway, state, operator)"""),
    "all_plazas": (("dim_plaza", "valid"), """
        SELECT plaza_id, name, highway, state, operator, active FROM dim_plaza
        UNION ALL
        SELECT plaza_id, 'Plaza ' || plaza_id, max(highway), NULL, NULL, CAST(0 AS SMALLINT) FROM valid
        WHERE plaza_id NOT IN (SELECT plaza_id FROM dim_plaza) GROUP BY plaza_id"""),
    "facts": (("clean", "dim_payment"), """
        SELECT c.transaction_id, c.plaza_id, c.tag_id AS vehicle, c.date_id, c.class_id, p.payment_id, c.amount,
            c.event_ts AS entry_time, c.exit_time, CAST(c.lane AS SMALLINT) AS lane
        FROM clean c LEFT JOIN dim_payment p ON p.status = c.status AND p.method = 'FASTAG'"""),
    "revenue": (("facts",), "SELECT * FROM facts WHERE payment_id IS DISTINCT FROM 2"),
    # Everything that is known of a trip beside its own columns; null where a dimension lacks it.
    "trips": (("facts", "dim_payment", "all_plazas", "dim_plaza", "dim_class", "dim_vehicle"), """
        SELECT facts.*, CAST(entry_time AS DATE) AS on_day, payment_id IS DISTINCT FROM 2 AS earned,
            (SELECT any_value(status) FROM dim_payment d WHERE d.payment_id = facts.payment_id) AS paid,
            spot.name AS spot, spot.highway AS road, plaza_id IN (SELECT plaza_id FROM dim_plaza) AS seeded,
            kind.name AS kind, car.vehicle_no, car.owner_name, car.registered_state
        FROM facts LEFT JOIN all_plazas spot USING (plaza_id) LEFT JOIN dim_class kind USING (class_id)
            LEFT JOIN dim_vehicle car USING (vehicle)"""),
    "plates": (("valid",), """
        SELECT tag_id, vehicle_no, MAX(event_ts) AS seen FROM valid GROUP BY tag_id, vehicle_no"""),
    "dim_vehicle": (("plates",), """
        SELECT tag_id AS vehicle, tag_id, coalesce(vehicle_no, 'UNKNOWN') AS vehicle_no,
            CAST(NULL AS VARCHAR) AS owner_name, substr(vehicle_no, 1, 2) AS registered_state
        FROM plates
        QUALIFY row_number() OVER (PARTITION BY tag_id
            ORDER BY vehicle_no IS NOT NULL DESC, seen DESC, vehicle_no DESC) = 1"""),
    "messages": (("raw",), """
        SELECT * EXCLUDE (whole), unnest(CASE WHEN event_id % 101 = 1 THEN [whole, '{' || whole, NULL] ELSE [whole] END) AS text
        FROM (SELECT *, '{' || concat_ws(',',
            '"transaction_id":"' || transaction_id || '"',
            '"timestamp":"' || coalesce(strftime(event_ts, '%Y-%m-%dT%H:%M:%S.%fZ'), 'not a time') || '"',
            '"plaza_id":"' || plaza_id || '"',
            '"plaza_name":"' || plaza_name || '"',
            '"highway":"' || highway || '"',
            '"tag_id":"' || tag_id || '"',
            '"vehicle_no":"' || vehicle_no || '"',
            '"class_id":"' || class_id || '"',
            '"class_name":"' || class_name || '"',
            '"amount":' || CAST(amount AS VARCHAR),
            '"balance_before":' || CAST(balance_before AS VARCHAR),
            '"balance_after":' || CAST(balance_after AS VARCHAR),
            '"status":"' || status || '"',
            '"lane":' || CAST(lane AS VARCHAR)) || '}' AS whole FROM raw)"""),
}

_EVENT = """transaction_id, plaza_id, plaza_name, highway, tag_id, vehicle_no, class_id, class_name,
    CAST(amount AS DOUBLE) AS amount, CAST(balance_before AS DOUBLE) AS balance_before,
    CAST(balance_after AS DOUBLE) AS balance_after, status, lane, event_ts"""
_RAW_HOUR = """CAST(year(event_ts) AS INTEGER) AS year, CAST(month(event_ts) AS INTEGER) AS month,
    CAST(day(event_ts) AS INTEGER) AS day, CAST(hour(event_ts) AS INTEGER) AS hour"""


def _needed(names: list[str]) -> list[str]:
    seen: list[str] = []
    for name in names:
        for cte in (*_needed(list(CTES[name][0])), name):
            if cte not in seen:
                seen.append(cte)
    return seen


def _query(ctes: str, body: str) -> str:
    names = _needed(ctes.split())
    chain = ",\n".join(f"{name} AS ({CTES[name][1]})" for name in names)
    body = body.strip()
    if chain and body.startswith("WITH "):
        return f"WITH {chain},\n{body.removeprefix('WITH ')}"
    return f"WITH {chain}\n{body}" if chain else body


def _hourly(source: str, ts: str, vehicle: str, flagged: str) -> str:
    return f"""
        SELECT plaza_id, date_id, CAST(hour({ts}) AS SMALLINT) AS hour, CAST(COUNT(transaction_id) AS INTEGER) AS tx_count,
            {_total('amount')} AS total_revenue, CAST(COUNT(DISTINCT {vehicle}) AS INTEGER) AS unique_vehicles,
            {_mean('amount')} AS avg_toll, CAST(COUNT(*) FILTER (WHERE {flagged}) AS INTEGER) AS flagged_count
        FROM {source} GROUP BY plaza_id, date_id, hour({ts})"""


def _trend(source: str) -> str:
    """Months of a source of (date_id, amount), each with the running total of its year and the month before."""
    return f"""
        SELECT year, month, CAST(earned AS DOUBLE) AS monthly_revenue, CAST(so_far AS DOUBLE) AS cumulative_revenue,
            CAST(before AS DOUBLE) AS prev_month_revenue,
            ROUND(100.0 * CAST(earned - before AS DOUBLE) / NULLIF(CAST(before AS DOUBLE), 0), 2) AS mom_growth_pct
        FROM (
            SELECT year, month, earned, lag(earned) OVER (ORDER BY year, month) AS before,
                sum(earned) OVER (PARTITION BY year ORDER BY month) AS so_far
            FROM (SELECT CAST(date_id // 10000 AS SMALLINT) AS year, CAST(date_id // 100 % 100 AS SMALLINT) AS month,
                      sum(amount) AS earned FROM {source} GROUP BY ALL)
        )"""


_DAY_RAW = f"SELECT *, {_DATE_ID.format('event_ts')} AS date_id FROM raw WHERE CAST(event_ts AS DATE) = {AS_OF}"


def _check(name: str, expected: str, observed: str, passed: str = "observed = 0") -> str:
    return f"""SELECT '{name}' AS "check", '{expected}' AS expected, observed, {passed} AS passed,
        CAST(NULL AS VARCHAR) AS error FROM (SELECT CAST({observed} AS BIGINT) AS observed)"""


CHECKS = {
    "dq_row_count": _check("row_count_gt", ">= 1", f"(SELECT COUNT(*) FROM ({_DAY_RAW}))", "observed >= 1"),
    "dq_null_ids": _check(
        "no_null_transaction_ids", "0", f"(SELECT COUNT(*) FROM ({_DAY_RAW}) WHERE transaction_id IS NULL)"),
    "dq_amount_range": _check(
        "amount_in_range", "all amounts in [0, 5000]",
        f"(SELECT COUNT(*) FROM ({_DAY_RAW}) WHERE amount < 0 OR amount > 5000)"),
    "dq_duplicates": _check(
        "no_duplicate_transactions", "0",
        f"(SELECT COUNT(*) FROM (SELECT transaction_id FROM ({_DAY_RAW}) GROUP BY transaction_id HAVING COUNT(*) > 1))"),
    "dq_orphan_plazas": _check(
        "valid_plaza_ids", "all plaza_ids in dim_plaza",
        f"(SELECT COUNT(*) FROM ({_DAY_RAW}) f LEFT JOIN dim_plaza p ON f.plaza_id = p.plaza_id WHERE p.plaza_id IS NULL)"),
}


def _summary(source: str) -> str:
    return f"""
        SELECT plaza_id, highway, {_RAW_HOUR}, COUNT(transaction_id) AS tx_count, {_total('amount')} AS total_revenue,
            COUNT(DISTINCT tag_id) AS unique_vehicles, COUNT(*) FILTER (WHERE status = 'FLAGGED') AS flagged_count
        FROM {source}
        GROUP BY plaza_id, highway, year(event_ts), month(event_ts), day(event_ts), hour(event_ts)"""


_REASON = """CASE WHEN transaction_id IS NULL THEN 'missing transaction_id' WHEN tag_id IS NULL THEN 'missing tag_id'
    WHEN amount IS NULL THEN 'missing amount' WHEN amount NOT BETWEEN 0 AND 5000 THEN 'amount out of range'
    WHEN event_ts IS NULL THEN 'unreadable event time' WHEN status IS NULL THEN 'missing status' END"""

#: How the sorted queries are sorted.
ORDER = {
    "kpi_plaza_revenue_7d": "total_revenue DESC, plaza_name",
    "kpi_hourly_heatmap": "date, hour, plaza_id",
    "kpi_class_share": "revenue DESC, vehicle_class",
    "kpi_top_vehicles": "total_trips DESC, tag_id, vehicle_no",
    "top_vehicles_colocated": "total_trips DESC, tag_id, vehicle_no",
    "kpi_flagged_report": "entry_time DESC, transaction_id",
    "kpi_monthly_trend": "year, month",
    "kpi_monthly_trend_lineitem": "year, month",
    "kpi_low_balance_24h": "last_seen DESC, tag_id",
    "kpi_highway_sla": "avg_processing_sec DESC, highway NULLS FIRST",
    "sla_from_histogram": "avg_processing_sec DESC, highway NULLS FIRST",
    "api_active_plazas": "plaza_id",
    "api_vehicle_history": "entry_time DESC, transaction_id",
}


def all_sql() -> dict[str, str]:
    sql = {
        "kpi_revenue_today": _query("trips", f"""
            SELECT CAST(coalesce(sum(amount), 0) AS DOUBLE) AS total_revenue_today, count(*) AS total_transactions
            FROM trips WHERE earned AND on_day = {AS_OF}"""),
        "kpi_plaza_revenue_7d": _query("trips", f"""
            SELECT spot AS plaza_name, road AS highway, {_total('amount')} AS total_revenue, count(*) AS tx_count,
                {_mean('amount')} AS avg_toll
            FROM trips WHERE earned AND spot IS NOT NULL AND on_day >= {AS_OF} - 7 GROUP BY ALL"""),
        "kpi_hourly_heatmap": _query("trips", f"""
            SELECT on_day AS date, CAST(hour(entry_time) AS SMALLINT) AS hour, plaza_id, spot AS plaza_name,
                CAST(count(transaction_id) AS INTEGER) AS tx_count, {_total('amount')} AS total_revenue,
                CAST(count(*) FILTER (payment_id = 3) AS INTEGER) AS flagged_count
            FROM trips WHERE earned AND seeded AND on_day >= {AS_OF} - 1 GROUP BY ALL"""),
        "kpi_class_share": _query("trips", f"""
            WITH per_kind AS (
                SELECT kind, count(*) AS n, {_total('amount')} AS revenue FROM trips
                WHERE earned AND kind IS NOT NULL AND date_trunc('month', on_day) = date_trunc('month', {AS_OF}) GROUP BY kind
            )
            SELECT kind AS vehicle_class, n AS tx_count, revenue,
                ROUND(100.0 * n / CAST((SELECT sum(n) FROM per_kind) AS DOUBLE), 2) AS pct_share FROM per_kind"""),
        **{name: _query("trips", f"""
            WITH per_car AS (
                SELECT vehicle AS tag_id, vehicle_no, registered_state, count(*) AS total_trips, {_total('amount')} AS total_paid
                FROM trips WHERE earned AND vehicle_no IS NOT NULL GROUP BY ALL
            )
            SELECT * FROM per_car QUALIFY row_number() OVER (ORDER BY total_trips DESC, tag_id, vehicle_no) <= 10""") for name in ("kpi_top_vehicles", "top_vehicles_colocated")},
        "kpi_flagged_report": _query("trips", """
            SELECT transaction_id, entry_time, vehicle AS tag_id, vehicle_no, spot AS plaza,
                CAST(amount AS DOUBLE) AS amount, paid AS status
            FROM trips WHERE earned AND paid = 'FLAGGED' AND spot IS NOT NULL AND vehicle_no IS NOT NULL
            QUALIFY row_number() OVER (ORDER BY entry_time DESC, transaction_id) <= 100"""),
        "kpi_weekend_weekday": _query("trips", f"""
            SELECT if(isodow(on_day) >= 6, 'Weekend', 'Weekday') AS day_type, count(*) AS tx_count,
                {_total('amount')} AS total_revenue, {_mean('amount')} AS avg_toll
            FROM trips WHERE earned AND on_day >= {AS_OF} - 30 GROUP BY ALL"""),
        "kpi_monthly_trend": _query("revenue", _trend("revenue")),
        "kpi_monthly_trend_lineitem": _query("", _trend(
            f"(SELECT {_DATE_ID.format('l_shipdate')} AS date_id, CAST(l_extendedprice AS DECIMAL(14,2)) AS amount"
            " FROM lineitem)")),
        "kpi_low_balance_24h": _query("trips", f"""
            SELECT vehicle AS tag_id, vehicle_no, owner_name, registered_state, max(entry_time) AS last_seen,
                CAST(min(amount) AS DOUBLE) AS last_toll_amount
            FROM trips WHERE paid = 'LOW_BALANCE' AND vehicle_no IS NOT NULL AND entry_time >= {NOW} - INTERVAL 24 HOURS
            GROUP BY ALL"""),
        **{name: _query("trips", f"""
            SELECT road AS highway, count(*) AS tx_count, ROUND(avg(took), 6) AS avg_processing_sec,
                ROUND(CAST(quantile_cont(took, 0.95) AS DOUBLE), 6) AS p95_processing_sec
            FROM (SELECT *, date_diff('second', entry_time, exit_time) AS took FROM trips
                  WHERE earned AND spot IS NOT NULL AND entry_time >= {AS_OF} - 7)
            WHERE took IS NOT NULL GROUP BY road""") for name in ("kpi_highway_sla", "sla_from_histogram")},
        "distinct_vehicles": _query("trips", """
            WITH earning AS (SELECT * FROM trips WHERE earned AND spot IS NOT NULL)
            SELECT 'day' AS level, CAST(on_day AS VARCHAR) AS item, count(DISTINCT vehicle) AS vehicles FROM earning GROUP BY on_day
            UNION ALL
            SELECT 'week', CAST(CAST(date_trunc('week', on_day) AS DATE) AS VARCHAR), count(DISTINCT vehicle) FROM earning
            GROUP BY date_trunc('week', on_day)
            UNION ALL
            SELECT 'highway', road, count(DISTINCT vehicle) FROM earning GROUP BY road"""),
        "api_active_plazas": _query("all_plazas", """
            SELECT plaza_id, name, highway, state, CAST(NULL AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude,
                operator, active
            FROM all_plazas WHERE active = 1"""),
        "api_day_summary": _query("trips", f"""
            SELECT strftime({AS_OF}, '%Y-%m-%d') AS date, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS total_revenue,
                count(*) AS tx_count, count(DISTINCT vehicle) AS unique_vehicles,
                count(*) FILTER (paid = 'FLAGGED') AS flagged_count
            FROM trips WHERE earned AND paid IS NOT NULL AND date_id = {DAY_KEY}"""),
        "api_vehicle_history": _query("trips", """
            SELECT transaction_id, entry_time, spot AS plaza, road AS highway, kind AS vehicle_class,
                CAST(amount AS DOUBLE) AS amount, paid AS status
            FROM trips
            WHERE vehicle = 'TAG-00042' AND earned AND vehicle_no IS NOT NULL AND spot IS NOT NULL AND kind IS NOT NULL
                AND paid IS NOT NULL
            QUALIFY row_number() OVER (ORDER BY entry_time DESC, transaction_id) <= 20"""),
        "fact_transactions": _query("valid", f"""
            SELECT transaction_id, plaza_id, tag_id, class_id, CAST(event_ts AS DATE) AS date, date_id,
                CAST(amount AS DOUBLE) AS amount, status, event_ts
            FROM valid WHERE status <> 'LOW_BALANCE'
            QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY event_ts, ingested_at, amount, status,
                plaza_id, tag_id, class_id) = 1"""),
        "hourly_revenue": _query("revenue", _hourly("revenue", "entry_time", "vehicle", "payment_id = 3")),
        "nightly_load": _query("revenue", _hourly("revenue", "entry_time", "vehicle", "payment_id = 3")),
        "hourly_revenue_raw": _query("valid", _hourly("valid", "event_ts", "tag_id", "status = 'FLAGGED'")),
        "parse_events": _query("messages raw", f"""
            SELECT {_EVENT} FROM raw
            UNION ALL
            SELECT {', '.join(['NULL'] * 14)} FROM messages WHERE text IS NULL OR text LIKE '{{{{%'"""),
        "quarantine_messages": _query("messages", f"""
            SELECT text AS payload, {", ".join(f"CASE WHEN readable THEN {c} END AS {c}" for c in ("transaction_id", "tag_id"))},
                CASE WHEN readable THEN CAST(amount AS DOUBLE) END AS amount, CASE WHEN readable THEN status END AS status,
                CASE WHEN readable THEN event_ts END AS event_ts, reason
            FROM (SELECT *, text IS NOT NULL AND text NOT LIKE '{{{{%' AS readable,
                    CASE WHEN NOT readable THEN 'unreadable message' ELSE {_REASON} END AS reason FROM messages)
            WHERE reason IS NOT NULL"""),
        "validate_enrich": _query("valid", f"SELECT {_EVENT}, {_RAW_HOUR} FROM valid"),
        "quarantine": _query("raw", f"""
            SELECT event_id, transaction_id, tag_id, CAST(amount AS DOUBLE) AS amount, event_ts, {_REASON} AS reason
            FROM raw WHERE reason IS NOT NULL"""),
        "flag_from_table": _query("raw", """
            SELECT event_id, transaction_id, tag_id, CASE WHEN tag_id IN (
                SELECT tag_id FROM raw WHERE amount < 0) THEN 'FLAGGED' ELSE status END AS status
            FROM raw"""),
        "encode_events": _query("messages", "SELECT text AS value FROM messages"),
        "stream_raw_landing": _query("valid", f"SELECT {_EVENT}, {_RAW_HOUR} FROM valid"),
        "stream_live_summary": _query("valid", _summary("valid")),
        "stream_dedup": _query("clean", f"SELECT {_EVENT} FROM clean"),
        "dq_report": _query("raw dim_plaza", "\nUNION ALL\n".join(CHECKS.values())),
        **{name: _query("raw dim_plaza", text) for name, text in CHECKS.items()},
        "dim_date": _query("valid", f"""
            SELECT {_DATE_ID.format('date')} AS date_id, date, CAST(year(date) AS SMALLINT) AS year,
                CAST(month(date) AS SMALLINT) AS month, CAST(day(date) AS SMALLINT) AS day, dayname(date) AS day_of_week,
                CAST(CASE WHEN dayofweek(date) IN (0, 6) THEN 1 ELSE 0 END AS SMALLINT) AS is_weekend
            FROM (SELECT DISTINCT CAST(event_ts AS DATE) AS date FROM valid)"""),
        "dim_date_absent": _query("valid", f"""
            SELECT DISTINCT date_id, CAST(event_ts AS DATE) AS date FROM valid
            WHERE date_id NOT IN (SELECT date_id FROM valid WHERE day(event_ts) <= 15)"""),
        "dim_vehicle": _query("dim_vehicle", """
            SELECT tag_id, vehicle_no, owner_name, registered_state, CAST(1 AS SMALLINT) AS active FROM dim_vehicle"""),
        "dim_vehicle_merge": _query("dim_vehicle", """
            SELECT tag_id, vehicle_no, owner_name, registered_state, CAST(1 AS SMALLINT) AS active FROM dim_vehicle"""),
        "plaza_upsert": _query("dim_plaza valid", """
            SELECT plaza_id, name, highway FROM dim_plaza
            WHERE plaza_id NOT IN (SELECT plaza_id FROM valid WHERE plaza_name IS NULL)
            UNION ALL
            SELECT plaza_id, 'Plaza ' || plaza_id, max(highway) FROM valid
            WHERE plaza_id IN (SELECT plaza_id FROM valid WHERE plaza_name IS NULL) GROUP BY plaza_id"""),
        "fact_conformed": _query("facts", """
            SELECT transaction_id, plaza_id, vehicle AS tag_id, date_id, class_id, CAST(payment_id AS SMALLINT) AS payment_id,
                CAST(amount AS DOUBLE) AS amount, entry_time, exit_time, lane
            FROM facts WHERE vehicle IN (SELECT vehicle FROM facts)"""),
        "enrich_class_rate": _query("valid dim_class", """
            SELECT v.event_id, v.transaction_id, v.class_id, CAST(v.amount AS DOUBLE) AS amount,
                CAST(c.base_rate AS DOUBLE) AS expected_amount,
                ROUND(CAST(v.amount AS DOUBLE) / CAST(c.base_rate AS DOUBLE), 4) AS trips
            FROM valid v LEFT JOIN dim_class c ON v.class_id = c.class_id"""),
        "classify_status": _query("raw", """
            SELECT event_id, transaction_id, tag_id, CAST(balance_before AS DOUBLE) AS balance_before,
                CAST(amount AS DOUBLE) AS amount, ruled AS status FROM raw"""),
        "charge_rule": _query("valid dim_class", """
            SELECT v.event_id, v.transaction_id, v.class_id, v.lane, CAST(c.base_rate * v.lane AS DOUBLE) AS charge
            FROM valid v JOIN dim_class c ON v.class_id = c.class_id"""),
        "fact_all_statuses": _query("facts dim_payment", f"""
            SELECT py.status, f.date_id, COUNT(*) AS tx_count, {_total('f.amount')} AS amount
            FROM facts f LEFT JOIN dim_payment py ON f.payment_id = py.payment_id GROUP BY py.status, f.date_id"""),
        "fact_unique": _query("valid dim_payment", f"""
            WITH sent AS (
                SELECT * FROM valid
                UNION ALL
                SELECT * REPLACE (event_ts + INTERVAL 7 DAYS AS event_ts, ingested_at + INTERVAL 7 DAYS AS ingested_at)
                FROM valid WHERE event_id % 37 = 5 AND day(event_ts) <= 22
            )
            SELECT transaction_id, {_DATE_ID.format('event_ts')} AS date_id, plaza_id, class_id,
                CAST(payment_id AS SMALLINT) AS payment_id, CAST(amount AS DOUBLE) AS amount, event_ts AS entry_time
            FROM (SELECT * FROM sent QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY event_ts, ingested_at) = 1) s
            LEFT JOIN dim_payment p ON p.status = s.status AND p.method = 'FASTAG'"""),
        "offset_audit": """
            WITH sent AS (
                SELECT CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 + (event_id // 3) % 4 END AS INTEGER) AS part,
                    CASE WHEN event_id % 3 = 0 THEN event_id // 3 ELSE 2 * (event_id // 12) + event_id % 3 - 1 END AS o
                FROM events
            ), came AS (
                SELECT part, o, SUM(CASE WHEN o % 37 < 2 THEN 2 ELSE 1 END) AS n FROM sent WHERE o % 41 NOT IN (7, 8, 9) GROUP BY part, o
            ), wanted AS (
                SELECT part, unnest(range(min(o), max(o) + 1)) AS o FROM came GROUP BY part
            ), every AS (
                SELECT w.part, w.o, COALESCE(c.n, 0) AS n FROM wanted w LEFT JOIN came c ON c.part = w.part AND c.o = w.o
            ), islands AS (
                SELECT *, o - row_number() OVER (PARTITION BY part, n ORDER BY o) AS island FROM every WHERE n <> 1
            )
            SELECT 'reads' AS topic, part AS partition, CAST(min(o) AS BIGINT) AS "first", CAST(max(o) AS BIGINT) AS "last",
                COUNT(*) AS n_offsets, CAST(n AS BIGINT) AS copies, CASE WHEN n = 0 THEN 'missing' ELSE 'repeated' END AS problem
            FROM islands GROUP BY part, n, island""",
        "stream_one_read": _query("valid", _summary("valid")),
        "ingest_balance": _query("messages valid", """
            SELECT messages, landed, messages - landed AS rejected, landed AS raw_rows, messages - landed AS rejected_rows,
                CAST(0 AS BIGINT) AS unbalanced
            FROM (SELECT COUNT(*) AS messages FROM messages), (SELECT COUNT(*) AS landed FROM valid)"""),
        "schema_drift": _query("raw", """
            WITH said AS (
                SELECT 'axles_seen' AS field, false AS known, 0 AS lost, 'BIGINT' AS type FROM raw WHERE event_id % 29 = 5
                UNION ALL
                SELECT 'booth', false, 0, 'OBJECT<id: BIGINT, open: BOOLEAN>' FROM raw WHERE event_id % 31 = 7
                UNION ALL
                SELECT 'note', false, 0, CASE WHEN event_id % 2 = 0 THEN 'STRING' ELSE 'BIGINT' END FROM raw WHERE event_id % 23 = 11
                UNION ALL
                SELECT 'lane', true, CASE WHEN event_id % 43 = 2 THEN 1 ELSE 0 END, CASE WHEN event_id % 43 = 2 THEN 'STRING' ELSE 'BIGINT' END
                FROM raw
                UNION ALL
                SELECT 'timestamp', true, CASE WHEN event_ts IS NULL THEN 1 ELSE 0 END, 'STRING' FROM raw
            )
            SELECT field, known, COUNT(*) AS n, CAST(0 AS BIGINT) AS n_null, CAST(SUM(lost) AS BIGINT) AS n_lost,
                CASE WHEN COUNT(DISTINCT type) > 1 THEN 'VARIANT' ELSE min(type) END AS type
            FROM said GROUP BY field, known HAVING NOT known OR SUM(lost) > 0"""),
        "extra_fields_landed": _query("valid", """
            SELECT transaction_id, event_ts, CASE WHEN event_id % 43 <> 2 THEN lane END AS lane, '{' || extra || '}' AS extra
            FROM (SELECT *, concat_ws(',',
                CASE WHEN event_id % 29 = 5 THEN '"axles_seen":' || CAST(event_id % 5 + 2 AS VARCHAR) END,
                CASE WHEN event_id % 31 = 7 THEN '"booth":{"id":' || CAST(event_id % 9 AS VARCHAR) || ',"open":true}' END,
                CASE WHEN event_id % 23 = 11 THEN '"note":' ||
                    CASE WHEN event_id % 2 = 0 THEN '"late"' ELSE CAST(event_id % 7 AS VARCHAR) END END) AS extra FROM valid)
            WHERE extra <> ''"""),
        "late_repair": _query("valid", """
            WITH timed AS (
                SELECT date_id, ingested_at, ingested_at > CAST(event_ts AS DATE) + INTERVAL 25 HOURS AS late FROM valid
            )
            SELECT date_id, COUNT(*) AS late_rows, MAX(ingested_at) AS last_arrival FROM timed
            WHERE late OR date_id = (SELECT max(date_id) FROM timed WHERE NOT late) GROUP BY date_id"""),
    }
    return {name: text.strip() for name, text in sql.items()}
