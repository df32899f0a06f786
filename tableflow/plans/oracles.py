"""DuckDB SQL for the registered queries, written independently of the Spark code."""

from __future__ import annotations

AS_OF = "TIMESTAMP '2026-01-01 12:30:00'"
STAMP = f"{AS_OF} AS ingest_ts, DATE '2026-01-01' AS ingest_date"


def _indicators(extra: str = "", where: str = "") -> str:
    return f"""
WITH t AS (SELECT event_type AS symbol, ts AS event_time, value AS close FROM events),
d AS (
  SELECT *,
    avg(close) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS ma,
    avg(close) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS fast,
    avg(close) OVER (w ROWS BETWEEN 25 PRECEDING AND CURRENT ROW) AS slow,
    close - lag(close) OVER w AS diff
  FROM t WINDOW w AS (PARTITION BY symbol ORDER BY event_time)
),
g AS (
  SELECT *,
    avg(CASE WHEN diff > 0 THEN diff ELSE 0.0::DOUBLE END)
      OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS gain,
    avg(CASE WHEN diff < 0 THEN -diff ELSE 0.0::DOUBLE END)
      OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS loss,
    avg(fast - slow) OVER (w ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS signal
  FROM d WINDOW w AS (PARTITION BY symbol ORDER BY event_time)
)
SELECT symbol, event_time, close, round(ma, 6) AS moving_avg_14,
  round(CASE WHEN loss = 0 THEN 100.0::DOUBLE ELSE 100 - 100 / (1 + gain / loss) END, 6) AS rsi_14,
  round(fast, 6) AS ema_fast_12, round(slow, 6) AS ema_slow_26, round(fast - slow, 6) AS macd,
  round(signal, 6) AS macd_signal_9{extra}
FROM g {where}
"""


_BROKEN_PRICE = """
  CASE WHEN event_id % 97 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 31 <> 0 THEN value END"""


def _no_nan(value: str, name: str) -> str:
    return f"round(CASE WHEN isnan({value}) THEN -1.0::DOUBLE ELSE {value} END, 6) AS {name}"


_INDICATORS_NAN = f"""
SELECT symbol, event_time, {", ".join(_no_nan(c, c) for c in (
    "close", "moving_avg_14", "rsi_14", "ema_fast_12", "ema_slow_26", "macd", "macd_signal_9"))}
FROM ({_indicators().replace("value AS close", _BROKEN_PRICE + " AS close")})
"""

_DELTA_NAN = f"""
WITH t AS (SELECT event_type AS symbol, ts AS event_time, {_BROKEN_PRICE} AS close FROM events),
d AS (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY event_time) AS diff FROM t)
SELECT symbol, event_time, {_no_nan("close", "close")}, {_no_nan("diff", "price_diff")},
  {_no_nan("(CASE WHEN diff > 0 THEN diff ELSE 0.0::DOUBLE END)", "gain")},
  {_no_nan("(CASE WHEN diff < 0 THEN -diff ELSE 0.0::DOUBLE END)", "loss")}
FROM d
"""

_BARS_TIEBREAK = """
SELECT event_type AS symbol, date_trunc('day', ts) AS event_time,
  arg_min(value, (date_trunc('hour', ts), event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, (date_trunc('hour', ts), event_id)) AS close, count(*) AS ticks
FROM events GROUP BY 1, 2
"""

_LANDED = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, 'csv' AS read_from
FROM orders WHERE o_orderkey % 20 <> 0
UNION ALL SELECT o_orderkey, NULL, NULL, NULL, 'broken csv' FROM orders WHERE o_orderkey % 20 = 0
UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, 'json'
FROM orders WHERE o_orderkey % 25 <> 0
UNION ALL SELECT o_orderkey, NULL, NULL, NULL, 'broken json' FROM orders WHERE o_orderkey % 25 = 0
"""

_UPSERT_HOT = """
WITH s AS (SELECT o_custkey AS user_id, max(o_totalprice) AS most FROM orders GROUP BY 1)
SELECT event_id, ts, e.user_id, event_type, coalesce(most, value) AS value, props
FROM events e LEFT JOIN s ON e.user_id = s.user_id
UNION ALL
SELECT NULL, NULL, user_id, NULL, most, NULL FROM s WHERE user_id NOT IN (SELECT user_id FROM events)
"""

_NULL_KEYS = """
WITH e AS (SELECT * REPLACE (CASE WHEN event_id % 10 <> 0 THEN user_id END AS user_id) FROM events)
SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (
    PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id DESC) AS rn
  FROM e WHERE user_id IS NOT NULL
) WHERE rn = 1
UNION ALL SELECT event_id, ts, user_id, event_type, value, props FROM e WHERE user_id IS NULL
"""

_USER_TICKS = "t AS (SELECT user_id AS symbol, ts AS event_time, value AS close FROM events)"


def _bollinger(key: str) -> str:
    return f"""
WITH t AS (SELECT {key} AS symbol, ts AS event_time, value AS close FROM events),
b AS (
  SELECT *, count(close) OVER w AS n, avg(close) OVER w AS mid, stddev_pop(close) OVER w AS sd
  FROM t WINDOW w AS (PARTITION BY symbol ORDER BY event_time
                      ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
)
SELECT symbol, event_time, close,
  CASE WHEN n = 20 THEN round(mid - 2.0 * sd, 6) END AS bb_lower,
  CASE WHEN n = 20 THEN round(mid, 6) END AS bb_mid,
  CASE WHEN n = 20 THEN round(mid + 2.0 * sd, 6) END AS bb_upper
FROM b
"""


_CURATE = f"""
WITH raw AS (
  SELECT trim(' ' || user_id || '-' || event_type || '  ', ' ') AS id,
    CASE WHEN event_id % 50 = 0 THEN NULL ELSE ts END AS updated_at, value, event_id
  FROM events
),
r AS (
  SELECT *, row_number() OVER (
    PARTITION BY id ORDER BY updated_at DESC NULLS LAST, event_id DESC NULLS LAST) AS rn
  FROM raw
)
SELECT id, updated_at, value, event_id, {STAMP} FROM r WHERE rn = 1
"""

_BARS = """
SELECT event_type AS symbol, date_trunc('hour', ts) AS event_time, arg_min(value, ts) AS open,
  max(value) AS high, min(value) AS low, arg_max(value, ts) AS close,
  round(sum(value), 6) AS volume, count(*) AS ticks
FROM events GROUP BY 1, 2
"""

ORACLES: dict[str, str] = {
    "indicators": _indicators(),
    "indicators_segmented": _indicators(),
    "indicators_since": _indicators(where="WHERE event_time >= TIMESTAMP '2024-01-15 00:00:00'"),
    "market_job": _indicators(extra=f", {STAMP}"),
    "moving_avg_strict": f"""
WITH {_USER_TICKS}
SELECT symbol, event_time, close,
  CASE WHEN count(close) OVER w = 14 THEN round(avg(close) OVER w, 6) END AS moving_avg
FROM t WINDOW w AS (PARTITION BY symbol ORDER BY event_time
                    ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)
""",
    "rsi_strict": f"""
WITH {_USER_TICKS},
d AS (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY event_time) AS diff FROM t),
g AS (
  SELECT *, count(diff) OVER w AS n,
    avg(CASE WHEN diff >= 0 THEN diff ELSE 0.0::DOUBLE END) OVER w AS gain,
    avg(CASE WHEN diff < 0 THEN -diff ELSE 0.0::DOUBLE END) OVER w AS loss
  FROM d WINDOW w AS (PARTITION BY symbol ORDER BY event_time
                      ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)
)
SELECT symbol, event_time, close,
  CASE WHEN n = 14 THEN round(
    CASE WHEN loss = 0 THEN 100.0::DOUBLE ELSE 100 - 100 / (1 + gain / loss) END, 6) END AS rsi
FROM g
""",
    "macd_strict": f"""
WITH {_USER_TICKS},
m AS (
  SELECT *,
    avg(close) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS short_mean,
    avg(close) OVER (w ROWS BETWEEN 25 PRECEDING AND CURRENT ROW) AS long_mean,
    count(close) OVER (w ROWS BETWEEN 25 PRECEDING AND CURRENT ROW) AS n
  FROM t WINDOW w AS (PARTITION BY symbol ORDER BY event_time)
)
SELECT symbol, event_time, close,
  CASE WHEN n = 26 THEN round(short_mean - long_mean, 6) END AS macd
FROM m
""",
    "bollinger": _bollinger("user_id"),
    "bollinger_segmented": _bollinger("event_type"),
    "bollinger_latest": f"""
WITH b AS ({_bollinger("user_id")}),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY event_time DESC) AS rn FROM b)
SELECT symbol, event_time, bb_lower, bb_mid, bb_upper FROM r WHERE rn = 1
""",
    "price_delta": """
WITH d AS (
  SELECT event_type AS symbol, ts AS event_time, value AS close,
    value - lag(value) OVER (PARTITION BY event_type ORDER BY ts) AS diff
  FROM events
)
SELECT symbol, event_time, close, round(diff, 6) AS price_diff,
  round(CASE WHEN diff > 0 THEN diff ELSE 0.0::DOUBLE END, 6) AS gain,
  round(CASE WHEN diff < 0 THEN -diff ELSE 0.0::DOUBLE END, 6) AS loss
FROM d
""",
    "latest_per_key": """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (
    PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate DESC NULLS LAST, l_partkey DESC NULLS LAST, l_suppkey DESC NULLS LAST,
      l_quantity DESC NULLS LAST, l_extendedprice DESC NULLS LAST, l_discount DESC NULLS LAST,
      l_tax DESC NULLS LAST, l_returnflag DESC NULLS LAST, l_linestatus DESC NULLS LAST) AS rn
  FROM lineitem
) WHERE rn = 1
""",
    "clean_distinct": """
SELECT DISTINCT trim(text, ' ') AS text, trim(lang, ' ') AS lang, trim(source, ' ') AS source
FROM documents
""",
    "curate": _CURATE,
    "curate_job": _CURATE,
    "ingest_stamp": f"SELECT *, {STAMP} FROM orders",
    "contract_report": """
WITH c AS (
  SELECT count(*) FILTER (c_acctbal IS NULL OR isnan(c_acctbal) OR c_acctbal <= 0) AS bad_price,
    count(*) FILTER (c_custkey IS NULL OR c_name IS NULL OR c_acctbal IS NULL) AS incomplete,
    count(*) FILTER (isnan(c_acctbal)) AS nans
  FROM customer
)
SELECT v.* FROM c, LATERAL (VALUES
  ('required', 'c_custkey', 'present', 'present', 0::BIGINT),
  ('required', 'c_name', 'present', 'present', 0::BIGINT),
  ('required', 'c_phone', 'present', 'missing', 1::BIGINT),
  ('type', 'c_custkey', 'bigint', 'bigint', 0::BIGINT),
  ('type', 'c_nationkey', 'bigint', 'int', 1::BIGINT),
  ('type', 'c_phone', 'string', NULL, 1::BIGINT),
  ('valid_price', 'c_acctbal', '> 0', NULL, c.bad_price),
  ('complete', 'c_custkey,c_name,c_acctbal', 'no nulls', NULL, c.incomplete),
  ('nan', 'c_acctbal', 'no NaN', NULL, c.nans)
) AS v("check", "column", expected, actual, violations)
""",
    "null_nan_profile": """
WITH e AS (
  SELECT * REPLACE (CASE WHEN event_id % 7 = 0 THEN NULL
                         WHEN event_id % 11 = 0 THEN 'nan'::DOUBLE ELSE value END AS value)
  FROM events
)
SELECT 'event_id' AS "column", count(*) AS rows, count(*) FILTER (event_id IS NULL) AS nulls,
  0::BIGINT AS nans FROM e
UNION ALL SELECT 'ts', count(*), count(*) FILTER (ts IS NULL), 0 FROM e
UNION ALL SELECT 'user_id', count(*), count(*) FILTER (user_id IS NULL), 0 FROM e
UNION ALL SELECT 'event_type', count(*), count(*) FILTER (event_type IS NULL), 0 FROM e
UNION ALL SELECT 'value', count(*), count(*) FILTER (value IS NULL),
  count(*) FILTER (isnan(value)) FROM e
UNION ALL SELECT 'props', count(*), count(*) FILTER (props IS NULL), 0 FROM e
""",
    "price_split": """
SELECT *, CASE WHEN c_acctbal IS NOT NULL AND NOT isnan(c_acctbal) AND c_acctbal > 0
               THEN 'good' ELSE 'quarantined' END AS outcome
FROM customer
""",
    "complete_rows": "SELECT * FROM events WHERE event_id % 7 <> 0 AND event_id % 5 <> 0",
    "standardize": """
SELECT c_custkey, c_nationkey, c_acctbal,
  CASE WHEN c_nationkey IN (0, 1) THEN 'UNKNOWN' ELSE upper(c_mktsegment) END AS segment,
  CASE WHEN c_nationkey = 2 THEN 'nobody' ELSE ' ' || c_name END AS name,
  CASE WHEN c_nationkey = 0 THEN -1.0::DOUBLE
       ELSE round(c_acctbal / c_nationkey::DOUBLE, 6) END AS ratio
FROM customer
""",
    "date_rules": """
WITH r AS (
  SELECT o_orderkey, o_orderdate, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS s,
    strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderkey * 86399500 - 1000 AS millis
  FROM orders
),
p AS (
  SELECT *,
    CASE o_orderkey % 4 WHEN 0 THEN s || 'Z' WHEN 1 THEN s || '+02:00' WHEN 2 THEN s ELSE d END
      AS instant_text,
    CASE o_orderkey % 3 WHEN 0 THEN d WHEN 1 THEN d[1:8] || '31'
      ELSE replace(d, '-0', '-') END AS day_text,
    make_timestamp(millis * 1000) AS m
  FROM r
)
SELECT o_orderkey, instant_text, day_text, millis,
  CASE o_orderkey % 4 WHEN 0 THEN epoch_ms(o_orderdate)
                      WHEN 1 THEN epoch_ms(o_orderdate) - 7200000 END AS instant_millis,
  CASE WHEN length(day_text) = 10 AND try_cast(day_text AS DATE) IS NOT NULL THEN day_text END
    AS day,
  CASE WHEN millis % 60000 = 0 THEN strftime(m, '%Y-%m-%dT%H:%MZ')
       WHEN millis % 1000 = 0 THEN strftime(m, '%Y-%m-%dT%H:%M:%SZ')
       ELSE strftime(m, '%Y-%m-%dT%H:%M:%S.%gZ') END AS millis_text
FROM p
""",
    "upsert_equi": """
SELECT e.event_id, e.ts, e.user_id,
  CASE WHEN o.o_orderkey IS NOT NULL THEN o.o_orderstatus ELSE e.event_type END AS event_type,
  CASE WHEN o.o_orderkey IS NOT NULL THEN o.o_totalprice ELSE e.value END AS value, e.props
FROM events e LEFT JOIN orders o ON e.event_id = o.o_orderkey * 2
UNION ALL
SELECT o.o_orderkey * 2, o.o_orderdate, o.o_custkey, o.o_orderstatus, o.o_totalprice, NULL
FROM orders o WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id = o.o_orderkey * 2)
""",
    "upsert_theta": """
WITH s AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (
      PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS rn
    FROM orders
  ) WHERE rn = 1
)
SELECT e.event_id, e.ts, e.user_id,
  CASE WHEN s.o_orderkey IS NOT NULL THEN 'matched' ELSE e.event_type END AS event_type,
  CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_totalprice ELSE e.value END AS value, e.props
FROM events e
LEFT JOIN s ON e.user_id = s.o_custkey AND e.value > s.o_totalprice / 5000.0::DOUBLE
UNION ALL
SELECT -1 - s.o_orderkey, s.o_orderdate, s.o_custkey, 'inserted', s.o_totalprice, NULL
FROM s WHERE NOT EXISTS (
  SELECT 1 FROM events e
  WHERE e.user_id = s.o_custkey AND e.value > s.o_totalprice / 5000.0::DOUBLE)
""",
    "bars_hourly": _BARS,
    "text_sources": """
SELECT *, 'csv' AS read_from FROM orders UNION ALL SELECT *, 'json' FROM orders
""",
    "bronze_roundtrip": """
SELECT o_orderstatus, count(*) AS rows_sent, count(*) AS rows_read, true AS ok
FROM orders GROUP BY 1
""",
    "stream_project": """
SELECT ts AS event_time, CASE WHEN event_id % 2 = 0 THEN 'BTC' ELSE 'ETH' END AS symbol,
  event_id % 200 + 10000.0::DOUBLE AS close, event_id AS value
FROM events
""",
    "stream_bars": f"""
SELECT symbol, event_time, open, high, low, close, ticks FROM ({_BARS})
WHERE event_time + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
""",
    "stream_upsert": """
SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (
    PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id DESC) AS rn
  FROM events
) WHERE rn = 1
""",
}
_SPANS = """
SELECT *, TIMESTAMP '2024-01-01' + to_seconds(o_orderkey * 20) AS low,
  TIMESTAMP '2024-01-01' + to_seconds(o_orderkey * 20 + 15) AS high FROM orders"""

ORACLES |= {
    "upsert_range": f"""
WITH s AS ({_SPANS})
SELECT e.event_id, e.ts, e.user_id, coalesce(s.o_orderstatus, e.event_type) AS event_type,
  coalesce(s.o_totalprice, e.value) AS value, e.props
FROM events e LEFT JOIN s ON e.ts >= s.low AND e.ts < s.high
UNION ALL
SELECT -1 - s.o_orderkey, s.low, s.o_custkey, 'inserted', s.o_totalprice, NULL
FROM s WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.ts >= s.low AND e.ts < s.high)
""",
    "interval_join": """
WITH s AS (
  SELECT hour, TIMESTAMP '2024-01-01' + to_hours(hour) AS low, TIMESTAMP '2024-01-01' + to_hours(hour + hours) AS high
  FROM (SELECT o_orderkey % 720 AS hour, max(o_custkey % 40 + 1) AS hours FROM orders GROUP BY 1))
SELECT hour, event_type, count(*) AS events, max(event_id) AS last_event
FROM events JOIN s ON ts >= low AND ts < high GROUP BY 1, 2
""",
    "indicators_repaired": _indicators(),
    "bars_rolled_up": """
SELECT event_type AS symbol, date_trunc('day', ts) AS event_time, arg_min(value, ts) AS open, max(value) AS high,
  min(value) AS low, arg_max(value, ts) AS close, round(sum(value), 6) AS volume, count(*) AS ticks
FROM events GROUP BY 1, 2
""",
    "verified_write": """
SELECT o_orderstatus, count(*) AS rows_sent, count(*) AS rows_read, true AS ok, true AS whole FROM orders GROUP BY 1
UNION ALL
SELECT o_orderstatus, count(*), count(*), o_orderstatus <> 'P' OR min(o_totalprice) = max(o_totalprice), NULL FROM orders GROUP BY 1
""",
    "stream_csv": ORACLES["stream_project"],
    "upsert_partitions": """
SELECT o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 0.5::DOUBLE + o_orderkey ELSE o_totalprice END AS o_totalprice,
  o_orderdate, o_orderpriority FROM orders
UNION ALL
SELECT -1 - o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 5 = 0
""",
    "moving_avg_long": """
SELECT event_type AS symbol, ts AS event_time, value AS close,
  CASE WHEN count(value) OVER w = 150 THEN round(avg(value) OVER w, 6) END AS moving_avg
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 149 PRECEDING AND CURRENT ROW)
""",
    "bollinger_long": """
SELECT symbol, event_time, close, round(mean - 2 * dev, 6) AS bb_lower, round(mean, 6) AS bb_mid, round(mean + 2 * dev, 6) AS bb_upper
FROM (
  SELECT event_type AS symbol, ts AS event_time, value AS close, stddev_pop(value) OVER w AS dev,
    CASE WHEN count(value) OVER w = 150 THEN avg(value) OVER w END AS mean
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 149 PRECEDING AND CURRENT ROW))
""",
    "period_guards": """
SELECT user_id AS symbol, count(*) AS rows, greatest(count(*) - 66, 0) AS means, true AS refused FROM events GROUP BY 1
""",
    "indicators_incremental": ORACLES["indicators_since"],
    "indicators_nan": _INDICATORS_NAN,
    "price_delta_nan": _DELTA_NAN,
    "contract_report_any_case": """
SELECT 'type' AS check, 'c_custkey' AS "column", 'BIGINT' AS expected, 'bigint' AS actual, 0::BIGINT AS violations
UNION ALL SELECT 'type', 'c_name', 'String', 'string', 0
UNION ALL SELECT 'type', 'c_acctbal', 'decimal(10,2)', 'double', 1
UNION ALL SELECT 'nan', 'c_acctbal', 'no NaN', NULL, (SELECT count(*) FROM customer WHERE isnan(c_acctbal))
""",
    "schema_gate": "SELECT *, 'refused' AS outcome FROM orders",
    "upsert_bucketed": ORACLES["upsert_equi"],
    "upsert_large": ORACLES["upsert_equi"],
    "upsert_stored": ORACLES["upsert_equi"],
    "upsert_hot": _UPSERT_HOT,
    "bars_tiebreak": _BARS_TIEBREAK,
    "landed_text": _LANDED,
    "append_twice": "SELECT * FROM orders",
    "bronze_rows": f"SELECT *, {STAMP} FROM orders",
    "stream_bars_all": f"SELECT symbol, event_time, open, high, low, close, ticks FROM ({_BARS})",
    "stream_upsert_null_keys": _NULL_KEYS,
    "mixed_headers": """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 2 THEN o_custkey END AS o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 3 <> 2 THEN o_totalprice END AS o_totalprice
FROM orders WHERE o_orderkey % 20 <> 0
UNION ALL
SELECT count(*), CASE o_orderkey % 3 WHEN 0 THEN 6 WHEN 1 THEN 7 ELSE 4 END, 'broken', NULL
FROM orders WHERE o_orderkey % 20 = 0 GROUP BY 2
""",
    "profile_merged": """
WITH o AS (
  SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' OR o_orderkey % 3 > 0 THEN o_custkey END AS o_custkey, o_orderdate,
    CASE WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 0 THEN 'NaN'::DOUBLE ELSE o_totalprice END AS o_totalprice
  FROM orders WHERE o_orderstatus <> 'P' OR o_orderkey % 2 = 0)
SELECT 'o_orderkey' AS "column", count(*) AS "rows", count(*) FILTER (o_orderkey IS NULL) AS nulls, count(*) FILTER (isnan(o_orderkey::DOUBLE)) AS nans, min(o_orderkey) FILTER (NOT isnan(o_orderkey::DOUBLE))::DOUBLE AS low, max(o_orderkey) FILTER (NOT isnan(o_orderkey::DOUBLE))::DOUBLE AS high FROM o
UNION ALL
SELECT 'o_custkey' AS "column", count(*) AS "rows", count(*) FILTER (o_custkey IS NULL) AS nulls, count(*) FILTER (isnan(o_custkey::DOUBLE)) AS nans, min(o_custkey) FILTER (NOT isnan(o_custkey::DOUBLE))::DOUBLE AS low, max(o_custkey) FILTER (NOT isnan(o_custkey::DOUBLE))::DOUBLE AS high FROM o
UNION ALL
SELECT 'o_totalprice' AS "column", count(*) AS "rows", count(*) FILTER (o_totalprice IS NULL) AS nulls, count(*) FILTER (isnan(o_totalprice::DOUBLE)) AS nans, min(o_totalprice) FILTER (NOT isnan(o_totalprice::DOUBLE))::DOUBLE AS low, max(o_totalprice) FILTER (NOT isnan(o_totalprice::DOUBLE))::DOUBLE AS high FROM o
UNION ALL
SELECT 'o_orderdate' AS "column", count(*) AS "rows", count(*) FILTER (o_orderdate IS NULL) AS nulls, 0::BIGINT AS nans, NULL::DOUBLE AS low, NULL::DOUBLE AS high FROM o
""",
    "profile_drifted": """
WITH o AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 4 = 0) AS lost, count(DISTINCT o_orderstatus) AS states,
  count(*) FILTER (o_totalprice <= (SELECT median(o_totalprice) / 3 FROM orders)) AS cheap FROM orders)
SELECT 'o_orderkey' AS "column", 0.0::DOUBLE AS nulls_before, 0.0::DOUBLE AS nulls_after, '' AS reasons
UNION ALL SELECT 'o_custkey', 0.0, round(lost::DOUBLE / n, 6), CASE WHEN lost > 0.01 * n THEN 'nulls' ELSE '' END FROM o
UNION ALL SELECT 'o_orderstatus', 0.0, 0.0, CASE WHEN states > 2 THEN 'distinct' ELSE '' END FROM o
UNION ALL SELECT 'o_totalprice', 0.0, 0.0, CASE WHEN n / 2 - cheap > 0.1 * n THEN 'values' ELSE '' END FROM o
""",
}
