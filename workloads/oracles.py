"""The expected result of every query, as SQL over the given tables.

The SQL never touches a payload: it computes from the base rows what must come out
after packing, storing, choosing, decoding and cutting.
"""

from __future__ import annotations

from snapfolio.catalog import CATALOG, DAILY_LIMIT, NESTED_MAP, NESTED_OBJECT, spec_for
from workloads.fixtures import (
    BLOCK,
    BODY,
    DATA_TYPE_OF_EVENT,
    EMPTY_PERIOD,
    FIELDS,
    KEPT_BODY,
    ODD_PERIOD,
    ODD_VALUE,
    PAYLOAD_ORDER,
    RAW_KEY,
    STATUS,
    TEXT_BLOCK,
)

BASE = {
    "events": f"""
        SELECT event_type || '-' || CAST(event_id // {BLOCK} AS VARCHAR) AS symbol,
               strftime(ts, '%Y-%m-%dT%H:%M:%S') AS day_time, event_id, event_type, user_id, value
        FROM events""",
    "orders": f"""
        SELECT left(o_orderpriority, 1) || '-' || CAST(o_orderkey // {BLOCK} AS VARCHAR) AS symbol,
               strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey, o_custkey, o_orderstatus,
               o_totalprice, o_orderpriority
        FROM orders""",
    "months": """
        SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS symbol,
               strftime(l_shipdate, '%Y-%m-01') AS "month",
               CAST(SUM(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100 AS price,
               CAST(SUM(CAST(floor(l_quantity * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100 AS quantity,
               CAST(SUM(CAST(floor(l_discount * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100 AS discount,
               CAST(SUM(CAST(floor(l_tax * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100 AS tax
        FROM lineitem GROUP BY 1, 2""",
    "documents": f"""
        SELECT upper(source) || '-' || CAST(doc_id // {TEXT_BLOCK} AS VARCHAR) AS symbol,
               strftime(DATE '2020-01-01' + CAST(n_chars % 365 AS INTEGER), '%Y-%m-%d') AS day,
               doc_id, text, lang
        FROM documents""",
    "customers": """
        SELECT 'C' || CAST(c_custkey AS VARCHAR) AS symbol, c_custkey, c_name, c_mktsegment,
               c_acctbal, c_nationkey, r_name
        FROM customer JOIN nation ON c_nationkey = n_nationkey
                      JOIN region ON n_regionkey = r_regionkey""",
}

BREAKDOWN = """
    SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS symbol, strftime(l_shipdate, '%Y') AS period,
           l_returnflag AS segment,
           CASE WHEN strftime(l_shipdate, '%Y') <> '1999'
                THEN CAST(SUM(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100
           END AS value
    FROM lineitem GROUP BY 1, 2, 3"""


def records_sql(data_type: str) -> str:
    """All records of a data type: symbol, pos, the displayed keys."""
    spec = spec_for(data_type)
    family, fields = FIELDS[data_type]
    fold = "lower" if spec.key_case == "lower" else "upper"
    order = ", ".join(f'"{c}"' for c in PAYLOAD_ORDER[family])
    keys = ", ".join(
        f'CAST({fields.get(f.key, "NULL")} AS {"VARCHAR" if f.sql_type == "STRING" else f.sql_type})'
        f' AS "{f.key}"'
        for f in spec.fields
    )
    where = "WHERE c_mktsegment <> 'MACHINERY'" if spec.shape == NESTED_OBJECT else ""
    return f"""
        SELECT {fold}(symbol) AS symbol,
               ROW_NUMBER() OVER (PARTITION BY {fold}(symbol) ORDER BY {order}) - 1 AS pos, {keys}
        FROM ({BASE[family]}) AS base {where}"""


def ranked_sql(data_type: str) -> str:
    """All records with their place in display order."""
    spec = spec_for(data_type)
    if spec.shape == NESTED_MAP:
        return f"""
            SELECT *, ROW_NUMBER() OVER (
                       PARTITION BY symbol ORDER BY period DESC, segment) AS "rank"
            FROM ({BREAKDOWN}) AS rec"""
    newest = f'"{spec.sort_key}" DESC NULLS LAST, ' if spec.sort_key else ""
    return f"""
        SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY {newest}pos) AS "rank"
        FROM ({records_sql(data_type)}) AS rec"""


def view_sql(data_type: str) -> str:
    spec = spec_for(data_type)
    labels = ", ".join(f'"{f.key}" AS "{f.label}"' for f in spec.fields)
    pos = "" if spec.shape == NESTED_MAP else "pos, "
    where = f'WHERE "rank" <= {spec.top_n}' if spec.top_n else ""
    return f'SELECT symbol, "rank", {pos}{labels} FROM ({ranked_sql(data_type)}) AS ranked {where}'


def _keys(data_type: str) -> str:
    return ", ".join(f'"{f.key}"' for f in spec_for(data_type).fields)


LATEST = """
    SELECT event_id, event_type, user_id, ts, props, value,
           ROW_NUMBER() OVER (PARTITION BY event_type, user_id
                              ORDER BY ts DESC, event_id DESC) AS rn
    FROM events"""

DAILY = "SELECT CAST(ts AS DATE) AS date, COUNT(*) AS total FROM events GROUP BY 1"

# What must become of a landed response, told from the hour that chose its body.
LISTS = "data_type IN ('price', 'income', 'economic')"
LANDED = f"""
    SELECT event_id, ts, value, event_type, user_id, hour(ts) AS h, {DATA_TYPE_OF_EVENT} AS data_type,
           {STATUS} AS status, {RAW_KEY} AS raw_key, {BODY} AS body, {KEPT_BODY} AS kept
    FROM events"""

OUTCOME = """
    CASE WHEN status <> 200 THEN 'http_error'
         WHEN h IN (3, 5, 8) THEN 'parse_error'
         WHEN h IN (0, 1, 2, 9) THEN 'empty'
         WHEN data_type = 'price' AND h IN (4, 7, 10, 11, 12) THEN 'empty'
         WHEN data_type = 'revenue' AND h IN (4, 6, 10, 11) THEN 'empty'
         ELSE 'accepted' END"""

PROBLEM_OF_BODY = f"""
    CASE WHEN h IN (3, 5, 8) THEN 'malformed'
         WHEN h IN (0, 1, 2, 9) THEN NULL
         WHEN {LISTS} AND h IN (4, 6, 7, 10, 12) THEN 'not_an_array'
         WHEN {LISTS} AND h = 11 THEN 'not_records'
         WHEN data_type = 'price' AND h > 12 THEN 'not_an_array'
         WHEN NOT ({LISTS}) AND h IN (10, 11) THEN 'not_an_object'
         WHEN data_type = 'revenue' AND h IN (4, 6, 12) THEN 'breakdown_not_an_object' END"""

# The same for what is kept of accepted bodies: the inner array of price envelopes.
PROBLEM_OF_KEPT = f"""
    CASE WHEN o <> 'accepted' OR data_type = 'price' THEN NULL
         WHEN {LISTS} AND h IN (4, 6, 7, 10, 12) THEN 'not_an_array'
         WHEN {LISTS} AND h = 11 THEN 'not_records'
         WHEN data_type = 'outlook' AND h IN (10, 11) THEN 'not_an_object'
         WHEN data_type = 'revenue' AND h = 12 THEN 'breakdown_not_an_object' END"""

PROCESSED = f"""
    SELECT event_id AS id, data_type, ts, event_type AS endpoint, status, value, h,
           CASE WHEN value > 200 THEN NULL
                WHEN data_type = 'economic' THEN 'u' || CAST(user_id AS VARCHAR)
                ELSE 'U' || CAST(user_id AS VARCHAR) END AS symbol,
           CASE WHEN value > 200 THEN 'no_key' WHEN problem IS NOT NULL THEN 'quarantined'
                ELSE o END AS outcome,
           problem,
           CASE WHEN o = 'accepted' AND data_type = 'price' AND h = 6 THEN '[]'
                WHEN o = 'accepted' AND data_type = 'price' THEN kept ELSE body END AS raw_data
    FROM (SELECT *, {PROBLEM_OF_KEPT} AS problem
          FROM (SELECT *, {OUTCOME} AS o FROM ({LANDED}) AS l) AS c) AS p"""

INGESTED = f"""
    SELECT id, data_type, symbol, ts AS last_updated, endpoint, CAST(status AS INTEGER) AS status,
           outcome, problem, raw_data,
           outcome = 'accepted' AND raw_data <> '[]' AS usable
    FROM ({PROCESSED}) AS processed"""

REQUESTS = """
    SELECT CASE o_orderstatus WHEN 'O' THEN 'view' WHEN 'P' THEN 'click' ELSE 'purchase' END
               AS data_type,
           CAST(o_custkey AS VARCHAR) AS symbol, MIN(o_orderkey) AS request_id,
           CAST(date_trunc('year', o_orderdate) AS TIMESTAMP) AS ts,
           bool_or(o_orderpriority = '1-URGENT') AS refresh
    FROM orders GROUP BY 1, 2, 4"""

EVERY_REQUEST = """
    SELECT CASE o_orderstatus WHEN 'O' THEN 'view' WHEN 'P' THEN 'click' ELSE 'purchase' END
               AS data_type,
           CAST(o_custkey AS VARCHAR) AS symbol, o_orderkey AS request_id,
           CAST(date_trunc('year', o_orderdate) AS TIMESTAMP) AS ts,
           o_orderpriority = '1-URGENT' AS refresh
    FROM orders"""


def plan_sql(requests: str) -> str:
    """Day by day: ``got`` has the keys that the days before have fetched."""
    return f"""
    WITH RECURSIVE known AS MATERIALIZED (
        SELECT r.*, c.event_type IS NOT NULL AS cached, data_type || ' ' || symbol AS key,
               dense_rank() OVER (ORDER BY ts) AS k,
               row_number() OVER (PARTITION BY ts, data_type, symbol ORDER BY request_id) AS nth
        FROM ({requests}) AS r
        LEFT JOIN (SELECT DISTINCT event_type, CAST(user_id AS VARCHAR) AS user_key
                   FROM events) AS c
          ON r.data_type = c.event_type AND r.symbol = c.user_key),
    candidates AS MATERIALIZED (
        SELECT k, list({{'key': key, 'refresh': refresh, 'id': request_id}} ORDER BY request_id) AS c
        FROM known WHERE refresh OR (NOT cached AND nth = 1) GROUP BY k),
    steps(k, got, now) AS (
        SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]),
               CAST([] AS STRUCT(key VARCHAR, refresh BOOLEAN, id BIGINT)[])
        UNION ALL
        SELECT s.k + 1, list_concat(s.got, list_transform(n.now, lambda x: x.key)), n.now
        FROM steps AS s
        JOIN (SELECT DISTINCT k FROM known) AS d ON d.k = s.k + 1
        LEFT JOIN candidates AS c ON c.k = s.k + 1,
        LATERAL (SELECT list_filter(coalesce(c.c, []), lambda x: x.refresh OR NOT list_contains(s.got, x.key))
                        [1:{DAILY_LIMIT}] AS now) AS n),
    fetched AS (SELECT k, unnest(now, recursive := true) FROM steps),
    since AS (SELECT key, min(k * 1000000000 + id) AS since FROM fetched GROUP BY key),
    spent AS (SELECT k, count(*) AS n, max(id) AS last FROM fetched GROUP BY k),
    seen AS (
        SELECT known.*, cached OR coalesce(since < known.k * 1000000000 + request_id, false) AS usable,
               coalesce(n, 0) < {DAILY_LIMIT} OR request_id <= last AS room
        FROM known LEFT JOIN since USING (key) LEFT JOIN spent USING (k))
    SELECT request_id, ts, data_type, symbol, refresh,
           CASE WHEN usable AND NOT refresh THEN 'serve_cache' WHEN room THEN 'fetch'
                WHEN usable THEN 'fallback_cache' ELSE 'unavailable' END AS decision
    FROM seen"""


PATH = """
    SELECT o_orderkey AS request_id,
           CASE left(o_orderpriority, 1) WHEN '1' THEN 'price' WHEN '2' THEN 'income'
                WHEN '3' THEN 'estimates' WHEN '4' THEN 'economic' ELSE 'news' END AS data_type,
           CASE left(o_orderpriority, 1) WHEN '4' THEN 'c' ELSE 'C' END
               || CAST(o_custkey AS VARCHAR) AS symbol
    FROM orders"""


def _paths() -> str:
    endpoint = "CASE data_type " + " ".join(
        f"WHEN '{s.data_type}' THEN '{s.path}'" for s in CATALOG
    ) + " END"
    form = "CASE data_type " + " ".join(
        f"WHEN '{s.data_type}' THEN '{s.request}'" for s in CATALOG
    ) + " END"
    return f"""SELECT *, {endpoint} AS endpoint,
                      {endpoint} || replace({form}, '{{key}}', symbol) AS path
               FROM ({PATH}) AS r"""


def oracle_sql() -> dict[str, str]:
    sql = {
        # Store
        "latest_snapshot": f"""
            SELECT event_id AS id, event_type AS data_type, CAST(user_id AS VARCHAR) AS symbol,
                   ts AS last_updated, props AS raw_data
            FROM ({LATEST}) AS l WHERE rn = 1""",
        "cache_summary": """
            SELECT event_type AS data_type, CAST(user_id AS VARCHAR) AS symbol,
                   MAX(ts) AS last_updated, COUNT(*) AS data_points
            FROM events GROUP BY event_type, user_id""",
        "type_summary": """
            SELECT CAST(user_id AS VARCHAR) AS symbol, MAX(ts) AS last_updated,
                   COUNT(*) AS data_points
            FROM events WHERE event_type = 'purchase' GROUP BY user_id""",
        "type_summary_indicator": """
            SELECT event_type AS indicator, MAX(ts) AS last_updated, COUNT(*) AS data_points
            FROM events GROUP BY event_type""",
        "cached_keys": """
            SELECT DISTINCT CAST(user_id AS VARCHAR) AS symbol
            FROM events WHERE event_type = 'click'""",
        "nonempty_latest": f"""
            SELECT event_id AS id, event_type AS data_type, CAST(user_id AS VARCHAR) AS symbol,
                   ts AS last_updated, props AS raw_data
            FROM ({LATEST}) AS l WHERE rn = 1 AND value >= 20""",
        "decode_payload": """
            SELECT event_id AS id, k, '{"k":' || CAST(k AS VARCHAR) || '}' AS encoded
            FROM (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
                  FROM events) AS e""",
        "append_snapshot": """
            SELECT event_id AS id, event_type AS data_type, CAST(user_id AS VARCHAR) AS symbol,
                   ts AS last_updated, props AS raw_data, TRUE AS usable
            FROM events""",
        # Ledger
        "request_counts": """
            SELECT event_type AS endpoint, CAST(ts AS DATE) AS date, COUNT(*) AS count
            FROM events GROUP BY 1, 2""",
        "merge_counts": """
            SELECT event_type AS endpoint, CAST(ts AS DATE) AS date, 2 * COUNT(*) AS count
            FROM events GROUP BY 1, 2""",
        "daily_request_total": DAILY,
        "request_total_on": """
            SELECT CAST(COUNT(*) AS BIGINT) AS total FROM events
            WHERE CAST(ts AS DATE) = DATE '2024-01-15'
            UNION ALL
            SELECT COUNT(*) FROM events WHERE CAST(ts AS DATE) = DATE '1999-01-01'""",
        "limit_reached": f"""
            SELECT date, total, total >= {DAILY_LIMIT} AS limit_reached,
                   greatest({DAILY_LIMIT} - total, 0) AS remaining
            FROM ({DAILY}) AS d""",
        "admit_within_budget": f"""
            SELECT event_id AS request_id, ts,
                   ROW_NUMBER() OVER (PARTITION BY CAST(ts AS DATE)
                                      ORDER BY ts, event_id) <= {DAILY_LIMIT} AS admitted
            FROM events""",
        "admit_after_spending": f"""
            SELECT event_id AS request_id, e.ts,
                   ROW_NUMBER() OVER (PARTITION BY CAST(e.ts AS DATE) ORDER BY e.ts, event_id)
                       + coalesce(used, 0) <= {DAILY_LIMIT} AS admitted
            FROM events AS e
            LEFT JOIN (SELECT CAST(ts AS DATE) AS date, COUNT(*) AS used
                       FROM events WHERE event_type = 'purchase' GROUP BY 1) AS u
              ON CAST(e.ts AS DATE) = u.date""",
        # Requests and responses
        "plan_requests": plan_sql(REQUESTS),
        "plan_every_request": plan_sql(EVERY_REQUEST),
        "request_path": _paths(),
        "classify_response": f"""
            SELECT event_id AS seq, data_type, {OUTCOME} AS outcome FROM ({LANDED}) AS l""",
        "normalize_key": """
            SELECT c_custkey,
                   CASE WHEN c_acctbal < 0 THEN NULL
                        WHEN c_mktsegment = 'BUILDING' THEN lower(c_name)
                        ELSE upper(c_name) END AS symbol
            FROM customer""",
        "quarantine_bad_payloads": f"""
            SELECT event_id AS id, data_type, {PROBLEM_OF_BODY} AS problem
            FROM ({LANDED}) AS l""",
        "ingest_landed_payloads": INGESTED,
        "ingested_requests": f"""
            SELECT endpoint, CAST(ts AS DATE) AS date, COUNT(*) AS count
            FROM ({PROCESSED}) AS p WHERE outcome IN ('accepted', 'quarantined')
            GROUP BY 1, 2""",
        "ingest_odd_lines": f"""
            SELECT CASE WHEN id % 10 <> 7 THEN id END AS id, CASE WHEN id % 10 <> 7 THEN data_type END AS data_type,
                   CASE WHEN id % 10 <> 7 THEN last_updated END AS last_updated,
                   CASE WHEN id % 10 = 7 THEN 'corrupt_line' ELSE outcome END AS outcome,
                   CASE WHEN id % 10 = 7 THEN '{{"seq":' || CAST(id AS VARCHAR) ELSE raw_data END AS raw_data
            FROM ({INGESTED}) AS i""",
        "folded_log": INGESTED,
        "latest_of_log": f"""
            SELECT id, data_type, symbol, last_updated, raw_data, usable
            FROM ({INGESTED}) AS i WHERE outcome = 'accepted'
            QUALIFY ROW_NUMBER() OVER (PARTITION BY data_type, symbol ORDER BY last_updated DESC, id DESC) = 1""",
        # Shaping
        "explode_records": f"SELECT symbol, pos, {_keys('balance')} FROM ({records_sql('balance')}) AS r",
        "unwrap_envelope": f"""
            SELECT symbol, pos, {_keys('dividends')} FROM ({records_sql('dividends')}) AS r
            WHERE label <> '5-LOW'""",
        "extract_nested_object": f"""
            SELECT symbol, {_keys('outlook')} FROM ({records_sql('outlook')}) AS r""",
        "flatten_nested_map": f"SELECT symbol, period, segment, value FROM ({BREAKDOWN}) AS b",
        "odd_members": f"""
            SELECT symbol, period, segment, CASE WHEN NOT odd THEN value END AS value,
                   CAST(NULL AS VARCHAR) AS raw, 'shown' AS problem
            FROM (SELECT *, period = '{ODD_VALUE[0]}' AND segment = '{ODD_VALUE[1]}' AS odd FROM ({BREAKDOWN}) AS b)
            WHERE period NOT IN ('{ODD_PERIOD}', '{EMPTY_PERIOD}')
            UNION ALL
            SELECT symbol, period, segment, NULL, 'n/a', 'value_not_a_number' FROM ({BREAKDOWN}) AS b
            WHERE period = '{ODD_VALUE[0]}' AND segment = '{ODD_VALUE[1]}'
            UNION ALL
            SELECT DISTINCT symbol, period, NULL, NULL, CASE period WHEN '{ODD_PERIOD}' THEN '5' ELSE '{{}}' END,
                   CASE period WHEN '{ODD_PERIOD}' THEN 'period_not_an_object' ELSE 'period_without_segments' END
            FROM ({BREAKDOWN}) AS b WHERE period IN ('{ODD_PERIOD}', '{EMPTY_PERIOD}')""",
        "project_known_columns": f"SELECT symbol, pos, {_keys('metrics')} FROM ({records_sql('metrics')}) AS r",
        "rename_columns": "SELECT symbol, pos, "
        + ", ".join(f'"{f.key}" AS "{f.label}"' for f in spec_for("ratios").fields)
        + f" FROM ({records_sql('ratios')}) AS r",
        "sort_newest_first": f"""
            SELECT symbol, "rank", pos, {_keys('targets')} FROM ({ranked_sql('targets')}) AS r""",
        "top_n_per_key": """
            SELECT symbol, "rank", pos, "transactionDate", price
            FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol
                             ORDER BY "transactionDate" DESC NULLS LAST, pos) AS "rank"
                  FROM (SELECT CAST(user_id AS VARCHAR) AS symbol, event_id AS pos,
                               strftime(ts, '%Y-%m-%dT%H:%M:%S') AS "transactionDate",
                               value AS price
                        FROM events) AS e) AS r
            WHERE "rank" <= 10""",
        "record_totals": """
            SELECT CAST(o_custkey AS VARCHAR) AS symbol, COUNT(*) AS total, COUNT(*) > 10 AS truncated
            FROM orders GROUP BY o_custkey""",
        "payload_position": f'SELECT symbol, pos, "dateReported" FROM ({records_sql("holders")}) AS r',
        "view_totals": f"""
            SELECT symbol, COUNT(*) AS total, COUNT(*) > 10 AS truncated
            FROM ({records_sql('targets')}) AS r GROUP BY symbol""",
        # Exports
        "export_csv": f"SELECT symbol, pos, {_keys('grades')} FROM ({records_sql('grades')}) AS r",
        "export_all_keys": f"SELECT symbol, pos, {_keys('cashflow')} FROM ({records_sql('cashflow')}) AS r",
        "export_named_files": f"""
            SELECT symbol || '_{spec_for("marketcap").export_suffix}_20240601_120000.csv' AS file, pos,
                   {_keys('marketcap')}
            FROM ({records_sql('marketcap')}) AS r""",
        "export_path": """
            SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS symbol,
                   'S' || CAST(l_suppkey AS VARCHAR) || '_balance_sheet_20240601_120000' AS file_base,
                   'exports/balance/run=20240601_120000/symbol=S' || CAST(l_suppkey AS VARCHAR)
                       AS target
            FROM lineitem GROUP BY l_suppkey""",
        "export_records": f"SELECT symbol, pos, {_keys('holders')} FROM ({records_sql('holders')}) AS r",
        "export_records_all_payload_keys": f"""
            SELECT symbol, pos, {_keys('metrics')}, 'USD' AS currency
            FROM ({records_sql('metrics')}) AS r""",
        "export_whole_records": f"""
            SELECT symbol, pos, {_keys('metrics')}, 'USD' AS currency
            FROM ({records_sql('metrics')}) AS r""",
        "export_breakdown": f"SELECT symbol, period, segment, value FROM ({BREAKDOWN}) AS b",
        "select_export_keys": f"""
            SELECT symbol, pos, {_keys('growth')} FROM ({records_sql('growth')}) AS r
            WHERE symbol IN (SELECT 'S' || CAST(s_suppkey AS VARCHAR) FROM supplier
                             WHERE s_acctbal > 5000)""",
        "view_price_from_store": view_sql("price"),
        "export_csv_from_store": f"SELECT symbol, pos, {_keys('splits')} FROM ({records_sql('splits')}) AS r",
        # Streams
        "stream_ingest": INGESTED,
        "stream_request_counts": """
            SELECT event_type AS endpoint, CAST(ts AS DATE) AS date, COUNT(*) AS count
            FROM events GROUP BY 1, 2""",
        "stream_closed_counts": """
            SELECT event_type AS endpoint, CAST(ts AS DATE) AS date, COUNT(*) AS count,
                   CAST(0 AS BIGINT) AS late
            FROM events GROUP BY 1, 2
            HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT MAX(ts) FROM events) - INTERVAL 1 DAY""",
        "stream_admissions": f"""
            SELECT event_id AS request_id, ts,
                   ROW_NUMBER() OVER (PARTITION BY CAST(ts AS DATE)
                                      ORDER BY ts, event_id) <= {DAILY_LIMIT} AS admitted
            FROM events""",
        "stream_latest_snapshot": f"""
            SELECT event_id AS id, event_type AS data_type, CAST(user_id AS VARCHAR) AS symbol,
                   ts AS last_updated, props AS raw_data, TRUE AS usable
            FROM ({LATEST}) AS l WHERE rn = 1""",
    }
    sql.update({f"view_{s.data_type}": view_sql(s.data_type) for s in CATALOG})
    return sql
