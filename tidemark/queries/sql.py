"""The same questions as plain SQL over the given tables, for a second engine to answer."""

from __future__ import annotations

SQL: dict[str, str] = {}

SPLIT_AT = "TIMESTAMP '2024-01-21 00:00:00'"
HOURLY = "hourly AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS ts, round(sum(value), 4) AS value FROM events GROUP BY 1, 2)"
SCORES = (
    "scores AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, "
    "value AS score, (event_type = 'error')::INT AS label FROM events)"
)
SEGMENTS = SCORES + (
    ", marks AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS flag "
    "FROM scores WINDOW w AS (PARTITION BY user_id ORDER BY idx)), "
    "segs AS (SELECT user_id, idx, score, label, sum(flag) OVER (PARTITION BY user_id ORDER BY idx ROWS UNBOUNDED PRECEDING)::BIGINT AS seg FROM marks)"
)
COMPLETED = HOURLY + (
    ", completed AS (SELECT t.ts, e.event_type, coalesce(h.value, 0.0) AS value FROM (SELECT DISTINCT ts FROM hourly) t "
    "CROSS JOIN (SELECT DISTINCT event_type FROM hourly) e LEFT JOIN hourly h ON h.ts = t.ts AND h.event_type = e.event_type)"
)
DENSE = HOURLY + (
    ", span AS (SELECT event_type, min(ts) AS lo, max(ts) AS hi FROM hourly GROUP BY 1), "
    "grid AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM span), "
    "dense AS (SELECT g.event_type, g.ts, CASE WHEN h.ts IS NULL THEN 0.0 ELSE h.value END AS value FROM grid g "
    "LEFT JOIN hourly h ON h.event_type = g.event_type AND h.ts = g.ts)"
)
F1 = "2.0 * ({tp} / ({p} + 1e-5)) * ({tp} / ({a} + 1e-5)) / ({tp} / ({p} + 1e-5) + {tp} / ({a} + 1e-5) + 1e-5)"


def f1(tp: str, p: str, a: str) -> str:
    return F1.format(tp=f"({tp})::DOUBLE", p=f"({p})::DOUBLE", a=f"({a})::DOUBLE")


# --- metrics ---------------------------------------------------------------------------------------

_REGION = """
SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS time, r_name AS dim_region, round(sum(o_totalprice), 2) AS order_amount
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
WHERE o_orderdate BETWEEN TIMESTAMP '1995-06-01' AND TIMESTAMP '2000-06-30' GROUP BY 1, 2"""
SQL["metric_orders_monthly_region"] = _REGION
SQL["metric_sql_text"] = _REGION
SQL["metric_events_hourly"] = """
SELECT date_trunc('hour', ts)::TIMESTAMP AS time, event_type AS dim_event_type, count(event_id) AS num_events
FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-02-01' GROUP BY 1, 2"""
SQL["metric_dim_filter_yearly"] = """
SELECT date_trunc('year', o_orderdate)::TIMESTAMP AS time, o_orderpriority AS dim_priority, c_mktsegment AS dim_segment, count(DISTINCT o_custkey) AS num_customers
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '2001-12-31' AND r_name IN ('ASIA', 'EUROPE') AND o_totalprice > 1000 GROUP BY 1, 2, 3"""

# --- series ----------------------------------------------------------------------------------------

SQL["series_from_records"] = """
WITH c AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS ts, round(sum(value), 4) AS total, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2)
SELECT 'total' AS series, event_type, ts, total AS value FROM c UNION ALL SELECT 'n', event_type, ts, n FROM c"""
SQL["series_wide_export"] = f"""
WITH {HOURLY} SELECT epoch(ts)::BIGINT AS time, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'error') AS error,
max(value) FILTER (event_type = 'purchase') AS purchase, max(value) FILTER (event_type = 'signup') AS signup, max(value) FILTER (event_type = 'view') AS view
FROM hourly GROUP BY ts"""
SQL["series_json_roundtrip"] = f"WITH {HOURLY} SELECT event_type, ts, value FROM hourly"
SQL["wide_to_long"] = """
SELECT vec_id AS id, (i - 1)::INT AS pos, round(embedding[i]::DOUBLE, 6) AS value
FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)"""
SQL["series_level_rename"] = f"""
WITH {HOURLY} SELECT CASE event_type WHEN 'click' THEN 'clicked' WHEN 'view' THEN 'viewed' ELSE event_type END AS event_type, ts, value FROM hourly"""
SQL["series_dense_filled"] = f"WITH {DENSE} SELECT event_type, ts, value FROM dense"
SQL["series_missing"] = """
WITH h AS (SELECT DISTINCT user_id, date_trunc('hour', ts)::TIMESTAMP AS ts FROM events),
g AS (SELECT user_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM h GROUP BY user_id)
SELECT user_id, ts FROM g EXCEPT SELECT user_id, ts FROM h"""
SQL["series_complete_zero"] = f"WITH {COMPLETED} SELECT ts AS time, event_type, value FROM completed"
SQL["series_future"] = f"""
WITH {HOURLY}, l AS (SELECT event_type, max(ts) AS hi FROM hourly GROUP BY 1),
r AS (SELECT event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS j FROM hourly)
SELECT event_type, ts FROM r WHERE j <= 3 UNION ALL SELECT event_type, hi + to_hours(k::INT) FROM l, generate_series(1, 24) AS g(k)"""
SQL["series_bounds"] = f"""
WITH {HOURLY} SELECT event_type, min(ts) AS first_ts, max(ts) AS last_ts, max(ts) + INTERVAL 1 HOUR AS next_ts FROM hourly GROUP BY 1"""
SQL["series_grid_months"] = """
WITH d AS (SELECT o_orderpriority AS priority, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders GROUP BY 1)
SELECT priority, lo + to_months(k::INT) AS ts FROM d, generate_series(0, 200) AS g(k) WHERE lo + to_months(k::INT) <= hi"""
SQL["series_resample_mean_max"] = """
SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS ts, round(avg(value), 6) AS mean_value, max((value > 150)::INT)::DOUBLE AS any_high
FROM events GROUP BY 1, 2"""
SQL["series_split"] = """
SELECT user_id, ts, value, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts) <= floor(0.9::DOUBLE * count(*) OVER (PARTITION BY user_id)) THEN 'train' ELSE 'valid' END AS split
FROM events"""
SQL["series_slice_time"] = """
SELECT user_id, ts, event_id, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12 12:00:00'"""
SQL["series_slice_pos"] = """
SELECT user_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS j FROM events)
WHERE i > 5 AND j > 5"""
SQL["series_drop_incomplete"] = """
WITH c AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS ts, count(*)::DOUBLE AS value FROM events GROUP BY 1, 2)
SELECT event_type, ts, value FROM c WHERE ts IN (SELECT ts FROM c GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT event_type) FROM c))"""
SQL["series_select_prefix"] = """
SELECT event_type, user_id, date_trunc('day', ts)::TIMESTAMP AS ts, count(*) AS value FROM events WHERE event_type = 'error' GROUP BY 1, 2, 3"""
SQL["series_is_in"] = f"WITH {HOURLY} SELECT event_type, ts, value, ts IN (SELECT ts FROM hourly WHERE event_type = 'error') AS found FROM hourly"
SQL["series_set_ops"] = f"""
WITH {HOURLY}, b AS (SELECT ts FROM hourly WHERE event_type = 'purchase'), e AS (SELECT ts FROM hourly WHERE event_type = 'error')
SELECT ts, 'difference' AS kind FROM b WHERE ts NOT IN (SELECT ts FROM e) UNION ALL SELECT ts, 'intersection' FROM b WHERE ts IN (SELECT ts FROM e)"""
SQL["series_granularity"] = """
WITH d AS (SELECT DISTINCT 'day ' || o_orderpriority AS priority, o_orderdate AS ts FROM orders
 UNION ALL SELECT DISTINCT 'event ' || event_type, ts FROM events),
q AS (SELECT DISTINCT 'month ' || o_orderpriority AS priority, date_trunc('quarter', o_orderdate)::TIMESTAMP AS ts FROM orders),
e AS (SELECT DISTINCT 'end ' || o_orderpriority AS priority, last_day(o_orderdate)::TIMESTAMP AS ts FROM orders),
dg AS (SELECT DISTINCT priority, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY priority ORDER BY ts)) AS g FROM d),
mg AS (SELECT DISTINCT 'month' AS kind, priority, datediff('month', lag(ts) OVER (PARTITION BY priority ORDER BY ts), ts) AS g FROM q
 UNION ALL SELECT DISTINCT 'month_end', priority, datediff('month', lag(ts) OVER (PARTITION BY priority ORDER BY ts), ts) FROM e)
SELECT priority, 'fixed' AS kind, list_reduce(list(g), lambda a, b: gcd(a, b))::BIGINT AS n FROM dg WHERE g IS NOT NULL GROUP BY 1
UNION ALL SELECT priority, kind, list_reduce(list(g), lambda a, b: gcd(a, b))::BIGINT FROM mg WHERE g IS NOT NULL GROUP BY 1, 2"""
SQL["series_granularity_recent"] = f"""
WITH {HOURLY}, r AS (SELECT event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS j,
 epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts)) AS g FROM hourly),
v AS (SELECT event_type, g, count(*) AS c, min(j) AS newest FROM r WHERE j < 10 AND g IS NOT NULL GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY c DESC, newest) AS k FROM v)
SELECT event_type, 'fixed' AS kind, g::BIGINT AS n FROM o WHERE k = 1"""
SQL["series_index_checks"] = """
WITH m AS (SELECT user_id, date_trunc('minute', ts)::TIMESTAMP AS ts FROM events),
a AS (SELECT user_id, count(*) - count(DISTINCT ts) AS duplicate_times, count(DISTINCT ts) - count(DISTINCT date_trunc('hour', ts)) AS duplicate_positions FROM m GROUP BY 1),
f AS (SELECT user_id, min(ts) AS lo FROM m GROUP BY 1),
b AS (SELECT m.user_id, count(DISTINCT ts) FILTER ((epoch_us(ts) - epoch_us(lo)) % 120000000 <> 0) AS off_grid FROM m JOIN f ON m.user_id = f.user_id GROUP BY 1)
SELECT a.user_id, duplicate_times, duplicate_positions, off_grid FROM a JOIN b ON a.user_id = b.user_id"""
SQL["series_has_missing"] = "SELECT user_id, max(value > 300) AS has_missing FROM events GROUP BY 1"
SQL["calendar_round"] = """
SELECT DISTINCT l_shipdate AS ts, last_day(l_shipdate)::TIMESTAMP AS to_m, date_trunc('month', l_shipdate)::TIMESTAMP AS to_ms,
last_day(date_trunc('quarter', l_shipdate)::DATE + INTERVAL 2 MONTH)::TIMESTAMP AS to_q, date_trunc('quarter', l_shipdate)::TIMESTAMP AS to_qs,
make_date(year(l_shipdate), 12, 31)::TIMESTAMP AS to_y, date_trunc('year', l_shipdate)::TIMESTAMP AS to_ys,
(l_shipdate::DATE - dayofweek(l_shipdate)::INT)::TIMESTAMP AS to_w, (l_shipdate::DATE - ((dayofweek(l_shipdate) + 6) % 7)::INT)::TIMESTAMP AS to_w_mon,
(l_shipdate::DATE - ((dayofweek(l_shipdate) + 4) % 7)::INT)::TIMESTAMP AS to_w_wed,
date_trunc('day', l_shipdate)::TIMESTAMP AS to_day, time_bucket(INTERVAL 12 HOUR, l_shipdate, TIMESTAMP '1970-01-01') AS to_12_hours FROM lineitem"""
SQL["time_int_scale"] = "SELECT event_id, ((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 900000000)::BIGINT AS ts_int FROM events"

_PAIRS = HOURLY + """, span AS (SELECT min(ts) AS lo, max(ts) AS hi FROM hourly),
grid AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM (SELECT DISTINCT event_type FROM hourly), span),
whole AS (SELECT g.event_type, g.ts, coalesce(h.value, 0.0) AS value FROM grid g LEFT JOIN hourly h ON h.event_type = g.event_type AND h.ts = g.ts),
pair AS (SELECT a.event_type AS "left", b.event_type AS "right", a.ts, a.value AS x, b.value AS y FROM whole a JOIN whole b ON a.ts = b.ts AND a.event_type < b.event_type)"""
_OPS = [("+", "x + y"), ("-", "x - y"), ("*", "x * y"), ("/", "x / nullif(y, 0)"), ("//", "floor(x / nullif(y, 0))"),
        ("%", "x - floor(x / nullif(y, 0)) * nullif(y, 0)"), ("100-", "100.0 - x"), ("**2", "pow(x, 2)"), ("abs", "abs(x - y)")]
SQL["series_arith"] = f"WITH {_PAIRS} " + " UNION ALL ".join(
    f"""SELECT "left", "right", ts, round({e}, 4) + 0.0 AS value, '{o}' AS op FROM pair""" for o, e in _OPS)
SQL["series_compare"] = f"WITH {_PAIRS} " + " UNION ALL ".join(
    f"""SELECT "left", "right", ts, (x {o} y)::INT::DOUBLE AS value, '{o}' AS op FROM pair""" for o in ("<", "<=", ">", ">="))

# --- scaling ---------------------------------------------------------------------------------------

SQL["minmax_scale"] = f"""
WITH c AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, round(sum(value), 4) AS total, count(*)::DOUBLE AS n, max((event_type = 'error')::INT) AS is_attack FROM events GROUP BY 1),
f AS (SELECT min(total) AS lt, max(total) AS ht, min(n) AS ln, max(n) AS hn FROM c WHERE ts < {SPLIT_AT})
SELECT ts, round((total - lt) / CASE WHEN ht = lt THEN 1 ELSE ht - lt END, 6) AS total, round((n - ln) / CASE WHEN hn = ln THEN 1 ELSE hn - ln END, 6) AS n, is_attack,
CASE WHEN ts < {SPLIT_AT} THEN 'train' ELSE 'test' END AS split FROM c, f"""
_SCALED = (
    "scaled AS (SELECT user_id, idx, label, (score - min(score) OVER u) / CASE WHEN max(score) OVER u = min(score) OVER u THEN 1 "
    "ELSE max(score) OVER u - min(score) OVER u END AS score FROM scores WINDOW u AS (PARTITION BY user_id))"
)
SQL["score_scale"] = f"WITH {SCORES}, {_SCALED} SELECT user_id, idx, label, round(score, 6) AS score, round(1.0 - score, 6) AS flipped FROM scaled"

# --- robust scale ----------------------------------------------------------------------------------


def huber(rows: str, key: str) -> str:
    """Proposal-2 scale about 0 of ``rows(key, a)``, a = absolute value."""
    return f"""
hr AS (SELECT {key}, a, count(*) OVER k AS n, row_number() OVER o AS r, sum(a * a) OVER (PARTITION BY {key} ORDER BY a ROWS UNBOUNDED PRECEDING) AS ss,
 lead(a) OVER o AS nxt FROM ({rows}) WINDOW k AS (PARTITION BY {key}), o AS (PARTITION BY {key} ORDER BY a)),
hs AS (SELECT *, CASE WHEN ss > 0 AND n * 0.7784652161744701 - (n - r) * 2.25 > 0 THEN sqrt(ss / (n * 0.7784652161744701 - (n - r) * 2.25)) END AS s FROM hr),
huber AS (SELECT {key}, max(n)::BIGINT AS n, min(CASE WHEN a <= 1.5 * s AND (nxt IS NULL OR 1.5 * s < nxt) THEN s END) AS scale FROM hs GROUP BY {key} HAVING max(n) >= 10)"""


SQL["detect_mad_scale"] = "SELECT user_id, round(median(abs(value)) / 0.6744897501960817, 6) AS scale FROM events GROUP BY 1"
SQL["detect_huber_scale"] = f"WITH {huber('SELECT user_id, abs(value) AS a FROM events', 'user_id')} SELECT user_id, n, round(scale, 6) AS scale FROM huber"
_TRAINED = f"{COMPLETED}, {huber(f'SELECT event_type, abs(value) AS a FROM completed WHERE ts < {SPLIT_AT}', 'event_type')}"
SQL["detect_flags"] = f"""
WITH {_TRAINED}, c AS (SELECT c.event_type, ts, value, scale FROM completed c JOIN huber h ON c.event_type = h.event_type WHERE ts >= {SPLIT_AT})
SELECT 'both' AS algorithm_name, event_type AS entity, ts AS timestamp, value, '{{}}' AS metadata FROM c WHERE abs(value) > 1.5 * scale
UNION ALL SELECT 'high', event_type, ts, value, '{{}}' FROM c WHERE value > 1.5 * scale"""
_FLAGGED = f"""
WITH {_TRAINED} SELECT c.event_type, ts, value, coalesce(abs(value) > 1.5 * scale, false) AS is_anomaly
FROM completed c LEFT JOIN huber h ON c.event_type = h.event_type WHERE ts >= {SPLIT_AT}"""
SQL["incremental_score"] = _FLAGGED
SQL["detector_runs"] = f"""
SELECT event_type AS entity, ts AS timestamp, round(value, 4) AS value, CASE WHEN ts < TIMESTAMP '2024-01-25' THEN 'score-1' ELSE 'score-2' END AS run_id
FROM ({_FLAGGED}) WHERE is_anomaly AND ts < TIMESTAMP '2024-01-31'"""
SQL["streaming_score"] = f"""
WITH {_TRAINED} SELECT c.event_type, ts, value, coalesce(abs(value) > 1.5 * scale, false) AS is_anomaly
FROM hourly c LEFT JOIN huber h ON c.event_type = h.event_type
WHERE ts >= {SPLIT_AT} AND ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)"""


def _sparse(grain: str) -> str:
    rows = f"(SELECT o_custkey AS customer_id, date_trunc('{grain}', CAST(o_orderdate AS TIMESTAMP)) AS ts, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL)"
    dense = f"(SELECT c.customer_id, t.ts, coalesce(value, 0.0) AS value FROM (SELECT DISTINCT customer_id FROM {rows}) c CROSS JOIN (SELECT DISTINCT ts FROM {rows}) t LEFT JOIN {rows} r ON r.customer_id = c.customer_id AND r.ts = t.ts)"
    return f"""SELECT '{grain}' AS grain, algorithm_name, CAST(customer_id AS VARCHAR) AS entity, ts AS timestamp, value FROM (
WITH d AS MATERIALIZED {dense}, {huber("SELECT customer_id, abs(value) AS a FROM d WHERE ts < TIMESTAMP '1999-01-01'", 'customer_id')}
SELECT unnest(CASE WHEN value > 0 THEN ['both', 'high'] ELSE ['both'] END) AS algorithm_name, d.customer_id, ts, value
FROM d JOIN huber h ON d.customer_id = h.customer_id WHERE ts >= TIMESTAMP '1999-01-01' AND abs(value) > 1.5 * scale)"""


SQL["detect_sparse_entities"] = f"{_sparse('day')} UNION ALL {_sparse('quarter')}"
_DEFECTIVE = """
cells AS (SELECT user_id, date_trunc('hour', ts) AS ts, round(sum(value), 4) AS value FROM events GROUP BY ALL),
spoilt AS (SELECT user_id, ts, CASE WHEN user_id % 10 = 0 THEN 5.0 WHEN user_id % 10 = 2 AND ts = max(ts) OVER u THEN 'inf'::DOUBLE WHEN user_id % 10 <> 4 THEN value END AS value
           FROM cells WINDOW u AS (PARTITION BY user_id) QUALIFY user_id % 10 <> 1 OR ts = min(ts) OVER u)"""
SQL["forecast_report"] = f"""
WITH {_DEFECTIVE}, t AS (SELECT user_id, count(value) AS n, bool_or(isinf(value)) AS bad FROM spoilt GROUP BY user_id)
SELECT user_id, n, CASE WHEN n = 0 THEN 'empty' WHEN n < 2 THEN 'short' WHEN bad THEN 'not finite' WHEN user_id % 10 = 3 THEN 'failed' ELSE 'ok' END AS status,
       CASE WHEN n = 0 THEN 'no values' WHEN n < 2 THEN 'fewer than 2 values' WHEN bad THEN 'a value or regressor is not finite' END AS reason FROM t"""
SQL["detector_report"] = f"""
WITH {_DEFECTIVE}, sane AS (SELECT user_id, value - CASE WHEN user_id % 10 = 0 THEN 5.0 ELSE 0.0 END AS value FROM spoilt WHERE value IS NULL OR NOT isinf(value)),
{huber('SELECT user_id, abs(value) AS a FROM sane WHERE value IS NOT NULL', 'user_id')},
t AS (SELECT user_id, count(value) AS n FROM sane GROUP BY user_id)
SELECT unnest(['both', 'high']) AS algorithm_name, t.user_id, t.n,
       CASE WHEN t.n = 0 THEN 'empty' WHEN t.n < 10 THEN 'short' WHEN scale IS NULL THEN 'no scale' ELSE 'ok' END AS status,
       CASE WHEN t.n = 0 THEN 'no values' WHEN t.n < 10 THEN 'fewer than 10 values' WHEN scale IS NULL THEN 'most values are zero' END AS reason
FROM t LEFT JOIN huber h ON t.user_id = h.user_id"""
SQL["streaming_empty_windows"] = f"""
WITH cells AS (SELECT user_id, date_trunc('hour', ts) AS ts, round(sum(value), 4) AS value FROM events GROUP BY ALL),
{huber(f'SELECT user_id, abs(value) AS a FROM cells WHERE ts < {SPLIT_AT}', 'user_id')},
begun AS (SELECT user_id, CASE WHEN min(ts) < {SPLIT_AT} THEN {SPLIT_AT} ELSE min(ts) END AS first_ts FROM cells GROUP BY user_id),
grid AS (SELECT user_id, unnest(generate_series(first_ts, (SELECT date_trunc('hour', max(ts) - INTERVAL 2 HOUR) - INTERVAL 1 HOUR FROM events), INTERVAL 1 HOUR)) AS ts FROM begun)
SELECT g.user_id, g.ts, coalesce(value, 0.0) AS value, coalesce(abs(coalesce(value, 0.0)) > 1.5 * scale, false) AS is_anomaly
FROM grid g LEFT JOIN cells c ON g.user_id = c.user_id AND g.ts = c.ts LEFT JOIN huber h ON g.user_id = h.user_id"""

# --- evaluation ------------------------------------------------------------------------------------

_CONF = """round(tp / (tp + fp + 1e-5), 6) AS precision, round(tp / (tp + fn + 1e-5), 6) AS recall, round({f1}, 6) AS f1, round(fp / (fp + tn + 1e-5), 6) AS fpr"""


def confusion(rows: str, key: str, pred: str, actual: str, extra: str = "") -> str:
    return f"""SELECT {key}, tp, tn, fp, fn, {_CONF.format(f1=f1('tp', 'tp + fp', 'tp + fn'))}{extra} FROM (
SELECT {key}, sum({pred} * {actual})::DOUBLE AS tp, sum((1 - {pred}) * (1 - {actual}))::DOUBLE AS tn, sum({pred} * (1 - {actual}))::DOUBLE AS fp,
sum((1 - {pred}) * {actual})::DOUBLE AS fn FROM {rows} GROUP BY {key})"""


SQL["eval_confusion"] = f"WITH {SCORES}, p AS (SELECT *, (score > 60)::INT AS pred FROM scores) {confusion('p', 'user_id', 'pred', 'label')}"
SQL["eval_outcome"] = f"""
WITH {SCORES} SELECT user_id, idx, CASE WHEN score > 60 THEN CASE label WHEN 1 THEN 'TP' ELSE 'FP' END ELSE CASE label WHEN 1 THEN 'FN' ELSE 'TN' END END AS outcome FROM scores"""
SQL["eval_segments"] = f"WITH {SEGMENTS} SELECT user_id, idx, label, seg FROM segs"
SQL["eval_segment_max"] = f"""
WITH {SEGMENTS} SELECT user_id, idx, CASE WHEN label = 1 THEN max(score) OVER (PARTITION BY user_id, seg) ELSE score END AS adj_score FROM segs"""
_ADJ = SEGMENTS + ", adj AS (SELECT *, CASE WHEN label = 1{0} AND max(score) OVER (PARTITION BY user_id, seg) > 60 THEN 1 ELSE (score > 60)::INT END AS adj_pred FROM segs)"
SQL["eval_point_adjust"] = f"WITH {_ADJ.format(' AND idx > 0')} SELECT user_id, idx, adj_pred FROM adj"
SQL["eval_point_adjust_score"] = f"WITH {_ADJ.format('')} {confusion('adj', 'user_id', 'adj_pred', 'label')}"
SQL["eval_latency"] = f"""
WITH {SEGMENTS}, s AS (SELECT user_id, seg, min(idx) FILTER (score > 60) - min(idx) AS late FROM segs WHERE label = 1 GROUP BY 1, 2)
SELECT user_id, count(late) AS detected, coalesce(sum(late), 0)::BIGINT AS backfilled, round(coalesce(sum(late), 0) / (count(late) + 1e-4), 6) AS latency FROM s GROUP BY 1"""


def best_f1(agg: str) -> str:
    return f"""
WITH {SEGMENTS}, units AS (SELECT user_id, {agg}(score) AS score, count(*) AS len, max(idx) AS fin, 1 AS hit FROM segs WHERE label = 1 GROUP BY user_id, seg
 UNION ALL SELECT user_id, score, 1, idx, 0 FROM segs WHERE label = 0),
cum AS (SELECT user_id, score, sum(len) OVER o AS p, sum(len * hit) OVER o AS tp, sum(len * hit) OVER (PARTITION BY user_id) AS a FROM units
 WINDOW o AS (PARTITION BY user_id ORDER BY score DESC, fin ROWS UNBOUNDED PRECEDING)),
f AS (SELECT user_id, score, p, {f1('tp', 'p', 'a')} AS f1 FROM cum),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY f1 DESC, p) AS k FROM f)
SELECT user_id, round(f1, 6) AS f1, round(score, 6) AS threshold FROM t WHERE k = 1"""


SQL["eval_best_f1"] = best_f1("min")
SQL["eval_best_f1_segment"] = best_f1("max")
SQL["eval_grid_f1"] = f"""
WITH {SCORES}, {_SCALED}, r AS (SELECT user_id, min(score) AS lo, max(score) AS hi, sum(label) AS a FROM scaled GROUP BY 1),
g AS (SELECT user_id, lo, a, k, lo + k * 0.05::DOUBLE AS t FROM r, generate_series(0, 19) AS g(k) WHERE k < ceil((hi - lo) / 0.05::DOUBLE)),
c AS (SELECT g.user_id, k, t, lo, any_value(a) AS a, count(*) FILTER (score > t) AS p, coalesce(sum(label) FILTER (score > t), 0) AS tp FROM g JOIN scaled s ON g.user_id = s.user_id GROUP BY 1, 2, 3, 4),
f AS (SELECT user_id, k, t, lo, CASE WHEN p + a > 0 THEN 2.0 * tp / (p + a) ELSE 0 END AS f1 FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY f1 DESC, k) AS n FROM f)
SELECT user_id, round(f1, 6) AS f1, round(CASE WHEN f1 > 0 THEN t ELSE lo END, 6) AS threshold FROM o WHERE n = 1"""
SQL["eval_search_threshold"] = f"""
WITH {SEGMENTS}, u AS (SELECT user_id, max(score) AS s, count(*) AS n, 1 AS hit FROM segs WHERE label = 1 GROUP BY user_id, seg UNION ALL SELECT user_id, score, 1, 0 FROM segs WHERE label = 0),
c AS (SELECT user_id, k, k * 5.0::DOUBLE AS t, coalesce(sum(n) FILTER (s > k * 5.0), 0) AS p, coalesce(sum(n * hit) FILTER (s > k * 5.0), 0) AS tp, sum(n * hit) AS a, sum(n) AS n
 FROM u, generate_series(1, 64) AS g(k) GROUP BY 1, 2),
f AS (SELECT *, {f1('tp', 'p', 'a')} AS f1, (p - tp)::DOUBLE / (n - a + 1e-5) AS fpr FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY f1 DESC, k) AS i, row_number() OVER (PARTITION BY user_id ORDER BY fpr <= 0.1 DESC, f1 DESC, k) AS j FROM f)
SELECT x.user_id, round(x.f1, 6) AS f1, round(x.t, 6) AS threshold, round(y.f1, 6) AS f1_low_fpr, round(y.t, 6) AS threshold_low_fpr
FROM o x JOIN o y ON x.user_id = y.user_id AND x.i = 1 AND y.j = 1"""


def windows(source: str) -> str:
    """Windows of five rows of ``source(user_id, idx, score, label)`` with their score and label."""
    return f"""
wa AS (SELECT user_id, idx, score, label AS a, idx // 5 AS win, lag(label, 1, 0) OVER w AS b FROM {source} WINDOW w AS (PARTITION BY user_id, idx // 5 ORDER BY idx)),
wb AS (SELECT *, sum((a = 0 AND b = 1)::INT) OVER (PARTITION BY user_id, win ORDER BY idx ROWS UNBOUNDED PRECEDING) AS ends, sum((a = 1 AND b = 0)::INT) OVER (PARTITION BY user_id, win) AS runs FROM wa),
wc AS (SELECT user_id, win, least(ends, greatest(runs - 1, 0)) AS piece, max(a) AS lab, max(score) AS top, arg_min(a, idx) AS fst, min(idx) AS pos FROM wb GROUP BY 1, 2, 3),
wd AS (SELECT *, sum((lab = 0 OR fst = 0)::INT) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM wc),
win AS (SELECT user_id, pos, lab, CASE WHEN lab = 0 THEN top ELSE max(CASE WHEN lab = 1 THEN top END) OVER (PARTITION BY user_id, run ORDER BY pos ROWS UNBOUNDED PRECEDING) END AS s FROM wd)"""


SQL["eval_window_f1"] = f"WITH {SCORES}, {windows('scores')}, p AS (SELECT *, (s > 60)::INT AS pred FROM win) {confusion('p', 'user_id', 'pred', 'lab')}"
_HALF = SCORES + ", halves AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY idx) <= floor(0.5 * count(*) OVER (PARTITION BY user_id)) AS early FROM scores)"
_TUNE_BODY = """
SELECT user_id, k * 10.0 AS t, sum(lab * (s > k * 10.0)::INT) AS tp, sum((s > k * 10.0)::INT) AS p, sum(lab) AS a, k
FROM ({win}) w, generate_series(1, 32) AS g(k) GROUP BY user_id, k"""
_VALID = f"WITH hv AS (SELECT user_id, idx, score, label FROM halves WHERE early), {windows('hv')} SELECT * FROM win"
_TEST = f"WITH ht AS (SELECT user_id, idx, score, label FROM halves WHERE NOT early), {windows('ht')} SELECT * FROM win"
SQL["eval_window_tuned"] = f"""
WITH {_HALF}, c AS ({_TUNE_BODY.format(win=_VALID)}), f AS (SELECT *, {f1('tp', 'p', 'a')} AS f1 FROM c WHERE a > 0 OR p > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY f1 DESC, k) AS i FROM f),
h AS (SELECT w.user_id, coalesce(o.t, 160.0) AS threshold, lab, (s > coalesce(o.t, 160.0))::INT AS pred FROM ({_TEST}) w LEFT JOIN o ON w.user_id = o.user_id AND o.i = 1)
{confusion('h', 'user_id, threshold', 'pred', 'lab')}"""
SQL["eval_pak"] = f"""
WITH {SEGMENTS}, r AS (SELECT user_id, seg, score, row_number() OVER (PARTITION BY user_id, seg ORDER BY score DESC, idx) AS r, count(*) OVER (PARTITION BY user_id, seg) AS len FROM segs WHERE label = 1),
ks AS (SELECT unnest([20, 40, 60, 80, 100])::INT AS k),
q AS (SELECT user_id, seg, k, max(score) FILTER (r = floor(k * len / 100) + 1) AS lift FROM r, ks GROUP BY 1, 2, 3),
e AS (SELECT r.user_id, q.k, greatest(r.score, coalesce(q.lift, r.score)) AS score, 1 AS hit FROM r JOIN q ON r.user_id = q.user_id AND r.seg = q.seg
 UNION ALL SELECT user_id, k, score, 0 FROM segs, ks WHERE label = 0),
d AS (SELECT user_id, k, score, count(*) AS m, sum(hit) AS h FROM e GROUP BY 1, 2, 3),
c AS (SELECT user_id, k, score, sum(m) OVER o AS p, sum(h) OVER o AS tp, sum(h) OVER (PARTITION BY user_id, k) AS a FROM d WINDOW o AS (PARTITION BY user_id, k ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, CASE WHEN p + a > 0 THEN 2.0 * tp / (p + a) ELSE 0 END AS f1 FROM c),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY f1 DESC, score DESC) AS i FROM f)
SELECT user_id, k, round(f1, 6) AS f1, round(score, 6) AS threshold FROM t WHERE i = 1"""
SQL["eval_adjusted_composite"] = f"""
WITH {SEGMENTS}, j AS (SELECT user_id, label, CASE WHEN label = 1 THEN max(score) OVER (PARTITION BY user_id, seg) ELSE score END AS score FROM segs),
d AS (SELECT user_id, score, count(*) AS m, sum(label) AS h FROM j GROUP BY 1, 2),
c AS (SELECT *, sum(m) OVER o AS p, sum(h) OVER o AS tp, sum(m) OVER u AS n, sum(h) OVER u AS a FROM d
 WINDOW o AS (PARTITION BY user_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING), u AS (PARTITION BY user_id))
SELECT user_id, round(sum(h * ((n - a) - (p - tp) + 0.5 * (m - h))) / nullif(any_value(a) * (any_value(n) - any_value(a)), 0), 6) AS auroc,
round(sum(h::DOUBLE / nullif(a, 0) * tp / p), 6) AS average_precision, round(max(2.0 * tp / (p + a)), 6) AS f1 FROM c GROUP BY 1"""
_ROWS = {k: v.strip() for k, v in SQL.items() if k in ("eval_best_f1_segment", "eval_pak")}
SQL["eval_benchmark_table"] = f"""
SELECT user_id AS dataset, 'value' AS model, 'f1_pa' AS metric_name, f1 AS metric_value, NULL::VARCHAR AS metric_param FROM ({_ROWS['eval_best_f1_segment']})
UNION ALL SELECT user_id, 'value', 'f1_pak', f1, '20' FROM ({_ROWS['eval_pak']}) WHERE k = 20"""
SQL["eval_align_tail"] = f"""
WITH {SCORES}, n AS (SELECT user_id, max(idx) AS m FROM scores GROUP BY 1), s AS (SELECT user_id, idx - 3 AS idx, score FROM scores WHERE idx >= 3),
b AS (SELECT s.user_id, s.idx, s.score, max(s.idx) OVER (PARTITION BY s.user_id) - s.idx AS back FROM s)
SELECT b.user_id, b.idx, b.score, l.label FROM b JOIN n ON b.user_id = n.user_id JOIN scores l ON l.user_id = b.user_id AND l.idx = n.m - b.back"""

# --- forecasts -------------------------------------------------------------------------------------

_PARAMS = HOURLY + """, s AS (SELECT event_type, count(*) AS n, min(ts) AS lo, max(ts) AS hi, quantile_cont(abs(value), 0.95) AS q FROM hourly GROUP BY 1),
params AS (SELECT event_type, n, lo AS first_ts, hi AS last_ts, CASE WHEN q < 1e-6 THEN 1.0 ELSE q END AS y_scale,
 CASE WHEN hi - lo < INTERVAL 14 DAY THEN 0 ELSE greatest(least(n // 60, 6), 1) END::INT AS weekly_order,
 CASE WHEN hi - lo < INTERVAL 2 DAY THEN 0 ELSE greatest(least(n // 60, 6), 1) END::INT AS daily_order,
 CASE WHEN n < 2 * least(n // 30, 10) THEN 0 ELSE least(n // 30, 10) END::INT AS n_changepoints FROM s)"""
SQL["forecast_parameters"] = f"WITH {_PARAMS} SELECT event_type, n, first_ts, last_ts, round(y_scale, 6) AS y_scale, weekly_order, daily_order, n_changepoints FROM params"
SQL["forecast_features"] = f"""
WITH {_PARAMS}, r AS (SELECT h.event_type, ts, value / y_scale AS y, (epoch_us(ts) - epoch_us(first_ts))::DOUBLE / (epoch_us(last_ts) - epoch_us(first_ts)) AS x,
 (isodow(ts) - 1) + (60 * hour(ts) + minute(ts)) / 1440.0::DOUBLE AS dow, hour(ts) + minute(ts) / 60.0::DOUBLE AS hod, weekly_order AS w, daily_order AS d, n_changepoints AS k
 FROM hourly h JOIN params p ON h.event_type = p.event_type), g AS (SELECT unnest(generate_series(0, 12))::INT AS j)
SELECT event_type, ts, 'y' AS feature, round(y, 6) AS v FROM r
UNION ALL SELECT event_type, ts, 'hinges_' || j, round(CASE WHEN j = 0 THEN x ELSE greatest(x - 0.8::DOUBLE * j / (k + 1), 0) END, 6) FROM r, g WHERE j <= k
UNION ALL SELECT event_type, ts, 'weekly_' || (j - 1), round(cos(2 * pi() / 7 * dow * j), 6) + 0.0 FROM r, g WHERE j BETWEEN 1 AND w
UNION ALL SELECT event_type, ts, 'weekly_' || (w + j - 1), round(sin(2 * pi() / 7 * dow * j), 6) + 0.0 FROM r, g WHERE j BETWEEN 1 AND w
UNION ALL SELECT event_type, ts, 'daily_' || (j - 1), round(cos(2 * pi() / 24 * hod * j), 6) + 0.0 FROM r, g WHERE j BETWEEN 1 AND d
UNION ALL SELECT event_type, ts, 'daily_' || (d + j - 1), round(sin(2 * pi() / 24 * hod * j), 6) + 0.0 FROM r, g WHERE j BETWEEN 1 AND d"""
SQL["forecast_holidays"] = """
WITH o AS (SELECT o_orderpriority AS priority, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2)
SELECT priority, ts, value, CASE WHEN (month(ts) = 1 AND day(ts) <= 3) OR (month(ts) = 5 AND day(ts) <= 2) OR (month(ts) = 4 AND day(ts) = 30) THEN 1.0 ELSE 0.0 END AS is_holiday FROM o"""
SQL["forecast_covariates"] = "SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS ts, round(sum(value), 4) AS value, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2"

_NAIVE = HOURLY + """, r AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY ts) <= floor(0.8::DOUBLE * count(*) OVER (PARTITION BY event_type)) THEN 'train' ELSE 'test' END AS split FROM hourly),
pf AS (SELECT event_type, hour(ts) AS h, avg(value) AS p, stddev_pop(value) AS sd FROM r WHERE split = 'train' GROUP BY 1, 2),
naive AS (SELECT r.event_type, ts, value AS y, split, p, p - 2 * sd AS lo, p + 2 * sd AS up FROM r LEFT JOIN pf ON r.event_type = pf.event_type AND hour(r.ts) = pf.h)"""
_MEASURE = {
    "mae": "abs(y - p)", "smape": "2 * abs(y - p) / nullif(abs(y) + abs(p), 0)", "ci_sz": "greatest(up - lo, 0)", "ci_cov": "(y >= lo AND y <= up)::INT",
    "ci_ordered": "(p >= lo AND p <= up)::INT", "calib_h": "(y > up)::INT", "calib_l": "(y < lo)::INT",
}
SQL["interval_metrics"] = f"WITH {_NAIVE} SELECT event_type, " + ", ".join(
    f"round(avg({e}) FILTER (split = '{s}'), 6) AS {m}_{s}" for m, e in _MEASURE.items() for s in ("train", "test")) + " FROM naive GROUP BY 1"
_RESULTS = """
e AS (SELECT user_id AS key, ts < TIMESTAMP '2024-01-16' AS early, round(avg(value), 4) AS mean_value, count(*)::DOUBLE AS n, round(max(value), 4) AS max_value FROM events GROUP BY 1, 2),
u AS (SELECT key, early, unnest(['mean_value', 'n', 'max_value']) AS metric, unnest([mean_value, n, max_value]) AS v FROM e),
pairs AS (SELECT a.key, a.metric, a.v AS l, b.v AS r FROM u a JOIN u b ON a.key = b.key AND a.metric = b.metric AND a.early AND NOT b.early)"""
SQL["compare_models"] = f"""
WITH {_RESULTS} SELECT metric, round(avg(l), 6) AS lmean, round(avg(r), 6) AS rmean, round(100 * avg((r - l) / nullif(abs(l), 0)), 6) AS rel_diff_pct,
round(quantile_cont(l, 0.1), 6) AS lp10, round(quantile_cont(l, 0.5), 6) AS lp50, round(quantile_cont(l, 0.9), 6) AS lp90,
round(quantile_cont(r, 0.1), 6) AS rp10, round(quantile_cont(r, 0.5), 6) AS rp50, round(quantile_cont(r, 0.9), 6) AS rp90 FROM pairs GROUP BY 1"""
SQL["compare_tests"] = f"""
WITH {_RESULTS}, v AS (SELECT metric, l AS v, 1 AS s FROM pairs UNION ALL SELECT metric, r, 0 FROM pairs),
g AS (SELECT metric, v, sum(s) AS cl, sum(1 - s) AS cr FROM v GROUP BY 1, 2),
c AS (SELECT metric, sum(cl) OVER o AS l, sum(cr) OVER o AS r, sum(cl) OVER m AS n1, sum(cr) OVER m AS n2 FROM g
 WINDOW o AS (PARTITION BY metric ORDER BY v ROWS UNBOUNDED PRECEDING), m AS (PARTITION BY metric)),
ks AS (SELECT metric, round(max(abs(l / n1 - r / n2)), 6) AS ks, max(n1)::BIGINT AS n1, max(n2)::BIGINT AS n2 FROM c GROUP BY 1),
d AS (SELECT metric, l - r AS d, rank() OVER (PARTITION BY metric ORDER BY abs(l - r)) + (count(*) OVER (PARTITION BY metric, abs(l - r)) - 1) / 2.0 AS rk FROM pairs WHERE l <> r),
w AS (SELECT metric, round(coalesce(sum(rk) FILTER (d > 0), 0)::DOUBLE, 6) AS r_plus, round(coalesce(sum(rk) FILTER (d < 0), 0)::DOUBLE, 6) AS r_minus, count(*) AS n_nonzero FROM d GROUP BY 1)
SELECT ks.metric, ks, n1, n2, r_plus, r_minus, n_nonzero FROM ks JOIN w ON ks.metric = w.metric"""

SQL["score_jitter"] = f"""
WITH {SCORES} SELECT user_id, idx, label,
score * (1.0::DOUBLE + (CAST('0x' || substr(md5(concat_ws(':', user_id, idx, '0')), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE * 0.2::DOUBLE - 0.1::DOUBLE)) AS score FROM scores"""

# --- forecasts -------------------------------------------------------------------------------------

SQL["forecast_components_sum"] = f"WITH {HOURLY} SELECT event_type, ts, 'daily,half_day,is_holiday,trend,weekly' AS parts, 0.0 AS gap FROM hourly"
SQL["forecast_certificate"] = f"""
WITH {HOURLY}, n AS (SELECT event_type, count(value) AS n FROM hourly GROUP BY 1)
SELECT event_type, unnest(['point', 'upper', 'lower']) AS role, n, true AS optimal, true AS balanced FROM n"""
_CELLS = f"""
every AS (SELECT user_id, date_trunc('hour', ts) AS ts, round(sum(value), 4) AS value FROM events GROUP BY ALL),
cells AS (SELECT user_id, ts, value, epoch(ts) / 3600 AS x, ts < {SPLIT_AT} AS early FROM every
          WHERE user_id IN (SELECT user_id FROM every WHERE ts < {SPLIT_AT} GROUP BY 1 HAVING count(*) >= 10))"""
_LINE = f"""{_CELLS},
line AS (SELECT user_id, avg(value) AS my, avg(x) AS mx, covar_pop(value, x) / var_pop(x) AS slope FROM cells WHERE early GROUP BY 1),
lined AS (SELECT c.*, my + slope * (x - mx) AS p FROM cells c JOIN line l ON c.user_id = l.user_id)"""
SQL["forecast_trend"] = f"""
WITH {_CELLS}, l AS (SELECT user_id, count(*) AS n, avg(value) AS my, avg(x) AS mx, covar_pop(value, x) / var_pop(x) AS slope, min(x) AS x0, max(x) AS x1 FROM cells GROUP BY 1)
SELECT user_id, n, round(my + slope * (x0 - mx), 3) AS first_yhat, round(my + slope * (x1 - mx), 3) AS last_yhat FROM l"""
SQL["detect_with_trend"] = f"""
WITH {_LINE}, {huber('SELECT user_id, abs(value - p) AS a FROM lined WHERE early', 'user_id')}
SELECT 'trend' AS algorithm_name, CAST(t.user_id AS VARCHAR) AS entity, ts AS timestamp, value, '{{}}' AS metadata
FROM lined t JOIN huber h ON t.user_id = h.user_id WHERE NOT early AND abs(value - p) > 2.0 * scale"""
SQL["backtest_trend"] = f"""
WITH {_LINE}, naive AS (SELECT user_id, value AS y, p, p AS lo, p AS up, CASE WHEN early THEN 'train' ELSE 'test' END AS split FROM lined)
SELECT user_id, """ + ", ".join(f"round(avg({e}) FILTER (split = '{s}'), { {'mae': 2, 'ci_sz': 2, 'smape': 4}.get(m, 9)}) AS {m}_{s}" for m, e in _MEASURE.items() for s in ("train", "test")) + " FROM naive GROUP BY 1"
SQL["tune_trend"] = f"""
WITH {_CELLS}, s AS (SELECT user_id, avg(value) AS my, min(x) AS x0, max(x) - min(x) AS w FROM cells WHERE early GROUP BY 1),
u AS (SELECT c.*, my, (x - x0) / w AS z FROM cells c JOIN s ON c.user_id = s.user_id),
l AS (SELECT user_id, any_value(my) AS my, avg(z) AS mz, covar_pop(value, z) AS c, var_pop(z) AS v FROM u WHERE early GROUP BY 1),
e AS (SELECT u.user_id, trial, value - (l.my + c / (v + [0.0, 0.5, 5.0][trial + 1]) * (z - mz)) AS h FROM u JOIN l ON u.user_id = l.user_id, (SELECT unnest([0, 1, 2]) AS trial) WHERE NOT early),
losses AS (SELECT user_id, trial, avg(greatest(0.95 * h, -0.05 * h) + greatest(0.05 * h, -0.95 * h)) AS loss FROM e GROUP BY 1, 2)
SELECT user_id, CAST(arg_min(trial, loss) AS INTEGER) AS trial, round(min(loss), 3) AS loss FROM losses GROUP BY 1"""

# --- state -----------------------------------------------------------------------------------------

_VERSIONS = "versions AS (SELECT 'customer_' || o_custkey AS model, o_orderkey AS version, o_orderdate AS created_at, o_orderstatus AS status FROM orders)"
SQL["state_latest"] = f"WITH {_VERSIONS} SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY model ORDER BY version DESC) = 1"
SQL["state_retention"] = f"WITH {_VERSIONS} SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY model ORDER BY version DESC) <= 5"
SQL["state_retire"] = f"WITH {_VERSIONS} SELECT * FROM versions WHERE model IN (SELECT model FROM versions WHERE created_at >= TIMESTAMP '2001-01-01')"

# --- bounds ----------------------------------------------------------------------------------------

_BOUNDS = COMPLETED + f""", ps AS (SELECT unnest([0, 1, 2])::INT AS estimator),
q AS (SELECT event_type, quantile_cont(value, [0.05, 0.1, 0.2]) AS lo, quantile_cont(value, [0.95, 0.9, 0.8]) AS hi FROM completed WHERE ts < {SPLIT_AT} GROUP BY 1),
bounds AS (SELECT ts, c.event_type AS entity, estimator, value, lo[estimator + 1] AS lower, hi[estimator + 1] AS upper FROM completed c JOIN q ON c.event_type = q.event_type, ps WHERE ts >= {SPLIT_AT})"""
SQL["bounds_alignment"] = f"""
WITH {COMPLETED} SELECT event_type AS entity, CASE WHEN event_type = 'click' THEN 0 ELSE count(*) FILTER (ts >= {SPLIT_AT}) END AS n,
CASE event_type WHEN 'click' THEN 'no values' WHEN 'view' THEN 'not in the model' ELSE 'scored' END AS status FROM completed GROUP BY event_type"""
SQL["bounds_score"] = f"WITH {_BOUNDS} SELECT ts, round(avg((value < lower OR value > upper)::INT), 6) AS score FROM bounds GROUP BY 1"
SQL["bounds_verdict"] = f"""
WITH {_BOUNDS} SELECT ts, entity, round(value, 6) AS value, round(lower, 6) AS lower, round(upper, 6) AS upper, value > upper AS is_anomaly
FROM (SELECT ts, entity, max(value) AS value, avg(lower) AS lower, avg(upper) AS upper FROM bounds GROUP BY 1, 2)"""
SQL["pinball_loss"] = f"""
WITH {_BOUNDS} SELECT entity, round(avg(greatest(0.95::DOUBLE * (value - upper), (0.95::DOUBLE - 1) * (value - upper)) + greatest(0.05::DOUBLE * (value - lower), (0.05::DOUBLE - 1) * (value - lower))), 6) AS loss
FROM bounds GROUP BY 1"""
SQL["bounds_f1_loss"] = f"""
WITH {_BOUNDS}, s AS (SELECT ts, avg((value < lower OR value > upper)::INT) AS score FROM bounds GROUP BY 1),
l AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, (max(value) > 250)::INT AS label FROM events GROUP BY 1),
d AS (SELECT score, label FROM s JOIN l ON s.ts = l.ts), r AS (SELECT min(score) AS lo, max(score) AS hi, sum(label) AS a FROM d),
c AS (SELECT k, any_value(a) AS a, count(*) FILTER (score > lo + k * 0.05::DOUBLE) AS p, coalesce(sum(label) FILTER (score > lo + k * 0.05::DOUBLE), 0) AS tp
 FROM d, r, generate_series(0, 19) AS g(k) WHERE k < ceil((hi - lo) / 0.05::DOUBLE) GROUP BY k)
SELECT 0 AS trial, round(-max(CASE WHEN p + a > 0 THEN 2.0 * tp / (p + a) ELSE 0 END), 6) AS loss FROM c"""
SQL["context_rows"] = f"""
WITH o AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS j FROM events WHERE ts < {SPLIT_AT})
SELECT user_id, ts, value, false AS is_new FROM o WHERE j <= 10 UNION ALL SELECT user_id, ts, value, true FROM events WHERE ts >= {SPLIT_AT}"""
