"""The same queries in DuckDB SQL, written from the definitions.

``SQL[name]`` is the plain query and ``DOUBLES[name]`` lists its floating
columns; ``published`` adds the rounding that ``catalog.publish`` applies.
"""

from __future__ import annotations

from barloom import config as C
from barloom.catalog import DIGITS

EVENT_TICKS = """
ticks AS (
  SELECT event_id AS seq, ts AS timestamp, event_type AS symbol,
         100.0::DOUBLE + value / 1000 AS bid,
         100.0::DOUBLE + value / 1000
           + 0.01::DOUBLE * (1 + CAST(json_extract_string(props, '$.k') AS INTEGER) % 5) AS ask,
         (1 + user_id % 10)::DOUBLE AS ask_volume,
         (1 + event_id % 7)::DOUBLE AS bid_volume
  FROM events)"""
ORDER_TICKS = """
ticks AS (
  SELECT o_orderkey AS seq, o_orderdate AS timestamp, o_orderstatus AS symbol,
         o_totalprice / 1000 - 0.5::DOUBLE AS bid, o_totalprice / 1000 + 0.5::DOUBLE AS ask,
         1.0::DOUBLE AS ask_volume, (1 + o_custkey % 5)::DOUBLE AS bid_volume
  FROM orders)"""
LINE_TICKS = """
ticks AS (
  SELECT l_orderkey * 10 + l_linenumber AS seq, l_shipdate AS timestamp, l_returnflag AS symbol,
         l_extendedprice / l_quantity * (1 - l_discount) AS bid,
         l_extendedprice / l_quantity * (1 + l_tax) AS ask,
         l_quantity AS ask_volume, l_quantity AS bid_volume
  FROM lineitem)"""


def bars_cte(bucket: str = "date_trunc('hour', timestamp)") -> str:
    return f"""
quotes AS (
  SELECT symbol, timestamp, seq, (ask + bid) / 2 AS mid, ask - bid AS spread,
         ask_volume + bid_volume AS tick_volume, {bucket} AS bar_start
  FROM ticks),
bars AS (
  SELECT symbol, bar_start,
         first(mid ORDER BY timestamp, seq) AS open, max(mid) AS high, min(mid) AS low,
         last(mid ORDER BY timestamp, seq) AS close,
         coalesce(sum(tick_volume), 0) AS volume, avg(spread) AS spread, count(*) AS tick_count
  FROM quotes GROUP BY symbol, bar_start)"""


BARS = f"{EVENT_TICKS}, {bars_cte()}"


def roll(fn: str, x: str, rows: int) -> str:
    frame = f"(PARTITION BY symbol ORDER BY bar_start ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {frame} = {rows} THEN {fn}({x}) OVER {frame} END"


def zscore(x: str, rows: int) -> str:
    return f"({x} - ({roll('avg', x, rows)})) / ({roll('stddev_samp', x, rows)})"


def ema(span: int) -> str:
    a = f"(2.0::DOUBLE / {span + 1})"
    return f"list_reduce(hist, lambda acc, x: acc * (1 - {a}) + x * {a})"


W = "(PARTITION BY symbol ORDER BY bar_start)"
PI2 = "(2 * pi())"
FEATURES = f"""
f1 AS (
  SELECT *, row_number() OVER {W} - 1 AS idx, count(*) OVER (PARTITION BY symbol) AS n,
         lag(close) OVER {W} AS c1, lag(high) OVER {W} AS h1, lag(low) OVER {W} AS l1,
         lag(close, 4) OVER {W} AS c4, lag(close, 12) OVER {W} AS c12,
         list(close) OVER (PARTITION BY symbol ORDER BY bar_start
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hist
  FROM bars),
f2 AS (
  SELECT *, close / c4 - 1 AS return_4, close / c12 - 1 AS return_12, close / c1 - 1 AS return_1h,
         {ema(12)} AS e12, {ema(26)} AS e26,
         CASE WHEN close - c1 < 0 THEN 0.0 ELSE close - c1 END AS gain,
         -(CASE WHEN close - c1 > 0 THEN 0.0 ELSE close - c1 END) AS loss,
         greatest(high - low, abs(high - c1), abs(low - c1)) AS tr,
         CASE WHEN high - h1 > l1 - low THEN greatest(high - h1, 0.0) ELSE 0.0 END AS plus_dm,
         CASE WHEN l1 - low > high - h1 THEN greatest(l1 - low, 0.0) ELSE 0.0 END AS minus_dm,
         CASE WHEN close > c1 THEN 1 WHEN close < c1 THEN -1 ELSE 0 END * volume AS signed_volume,
         hour(bar_start) AS hh, isodow(bar_start) AS dd
  FROM f1),
f3 AS (
  SELECT *, e12 / close - 1 AS ema_12, e26 / close - 1 AS ema_26, (e12 - e26) / close AS macd_pct,
         {roll("avg", "gain", 14)} AS mean_gain, {roll("avg", "loss", 14)} AS mean_loss,
         {roll("avg", "tr", 14)} AS atr,
         {roll("avg", "plus_dm", 14)} AS plus_mean, {roll("avg", "minus_dm", 14)} AS minus_mean,
         {roll("avg", "close", 20)} AS bb_mid, {roll("stddev_samp", "close", 20)} AS bb_std,
         {roll("stddev_samp", "return_1h", 24)} AS volatility_24,
         {roll("stddev_samp", "return_1h", 6)} AS vol_6,
         {zscore("spread", 24)} AS spread_z_24, {zscore("tick_count", 24)} AS tick_count_z_24,
         {roll("min", "low", 24)} AS low_24, {roll("max", "high", 24)} AS high_24,
         sum(signed_volume) OVER (PARTITION BY symbol ORDER BY bar_start
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS obv
  FROM f2),
f4 AS (
  SELECT *, 100 - 100 / (1 + mean_gain / mean_loss) AS rsi_14, atr / close AS atr_14,
         abs(100 * plus_mean / atr - 100 * minus_mean / atr)
           / greatest(100 * plus_mean / atr + 100 * minus_mean / atr, 1e-8::DOUBLE) * 100 AS dx,
         4 * bb_std / bb_mid AS bb_width, (close - bb_mid) / (2 * bb_std) AS bb_position,
         vol_6 / volatility_24 AS vol_ratio_6_24,
         (close - low_24) / (high_24 - low_24) AS close_in_range_24,
         {zscore("obv", 48)} AS obv_z_48, obv - lag(obv, 12) OVER {W} AS obv_delta_12,
         (close - open) / close AS body_pct,
         (high - greatest(open, close)) / close AS upper_wick_pct,
         (least(open, close) - low) / close AS lower_wick_pct, (high - low) / close AS range_pct,
         spread / close AS spread_pct, ln(1 + tick_count) AS log_tick_count,
         sin({PI2} * hh / 24) AS hour_sin, cos({PI2} * hh / 24) AS hour_cos,
         sin({PI2} * dd / 7) AS dow_sin, cos({PI2} * dd / 7) AS dow_cos
  FROM f3),
featured AS (SELECT *, {roll("avg", "dx", 14)} AS adx_14 FROM f4)"""
ALL_FEATURES = ", ".join(C.FEATURES)
NO_NULLS = " AND ".join(f"{c} IS NOT NULL" for c in C.FEATURES)
FEATURED = f"WITH {BARS}, {FEATURES}"


def labels_cte(source: str, start: str = "0", end: str = "n", h: int = 4, thr: str = "0.0005", gap: bool = True) -> str:
    """Label columns on ``source``, looking ahead inside [start, end)."""
    limit = "AND future_gap_hours <= 5" if gap else ""
    return f"""
ahead AS (
  SELECT *, CASE WHEN idx + {h} < {end} THEN lead(close, {h}) OVER {W} END AS future_close,
         CASE WHEN idx + {h} < {end} THEN lead(bar_start, {h}) OVER {W} END AS future_ts
  FROM {source}),
measured AS (
  SELECT *, future_close / close - 1 AS future_return,
         (date_diff('microsecond', bar_start, future_ts) // 1000000) / 3600 AS future_gap_hours,
         idx - {start} AS event_start, least(idx + {h}, {end} - 1) - {start} AS event_end
  FROM ahead),
marked AS (
  SELECT *, CASE WHEN future_return > {thr}::DOUBLE THEN 1 ELSE -1 END AS label,
         coalesce(isfinite(future_return) AND abs(future_return) > {thr}::DOUBLE {limit}, false) AS valid
  FROM measured)"""


LABELS = f"{FEATURED}, {labels_cte('featured')}"
SPLIT = f"""{FEATURED},
parts AS (
  SELECT *, floor(n * 0.8::DOUBLE)::BIGINT AS cut, floor(n * 0.8::DOUBLE)::BIGINT + 4 AS resume FROM featured),
sliced AS (
  SELECT *, CASE WHEN idx < cut THEN 'train' WHEN idx >= resume THEN 'test' ELSE 'purge' END AS part,
         CASE WHEN idx < cut THEN 0 WHEN idx >= resume THEN resume ELSE cut END::BIGINT AS slice_start,
         CASE WHEN idx < cut THEN cut WHEN idx >= resume THEN n ELSE resume END::BIGINT AS slice_end
  FROM parts),
{labels_cte("sliced", "slice_start", "slice_end")},
train AS (SELECT * FROM marked WHERE part = 'train' AND valid AND {NO_NULLS}),
test_labeled AS (SELECT * FROM marked WHERE part = 'test' AND valid AND {NO_NULLS})"""

def test_blocks_cte(splits: int) -> str:
    return f"""{SPLIT},
numbered AS (
  SELECT symbol, bar_start, event_start, event_end, row_number() OVER {W} - 1 AS row,
         count(*) OVER (PARTITION BY symbol) AS n_rows FROM train),
blocks AS (
  SELECT symbol, i AS fold, (i + 1) * size AS first_row,
         CASE WHEN i = {splits - 1} THEN n_rows ELSE (i + 2) * size END AS end_row
  FROM (SELECT symbol, any_value(n_rows) AS n_rows, greatest(1, any_value(n_rows) // {splits + 1}) AS size
        FROM numbered GROUP BY symbol), range({splits}) r(i)),
tested AS (
  SELECT n.*, b.fold, b.first_row FROM numbered n JOIN blocks b
    ON n.symbol = b.symbol AND n.row >= b.first_row AND n.row < b.end_row),
bounds AS (
  SELECT symbol, fold, any_value(first_row) AS first_row,
         arg_min(event_start, row) AS t_from, arg_max(event_end, row) AS t_to
  FROM tested GROUP BY symbol, fold)"""


FOLDS = f"""{test_blocks_cte(5)},
trained AS (
  SELECT n.*, b.fold FROM numbered n JOIN bounds b ON n.symbol = b.symbol AND n.row < b.first_row
  WHERE NOT (n.event_start <= t_to AND n.event_end >= t_from)),
fold_rows AS (
  SELECT symbol, fold::INTEGER AS fold, 'train' AS role, row, bar_start, event_start, event_end FROM trained
  UNION ALL
  SELECT symbol, fold::INTEGER, 'test', row, bar_start, event_start, event_end FROM tested t
  WHERE EXISTS (SELECT 1 FROM trained x WHERE x.symbol = t.symbol AND x.fold = t.fold))"""

SCORED = f"""{SPLIT},
priors AS (
  SELECT symbol, count(*) FILTER (label = -1) AS n_sell, count(*) FILTER (label = 1) AS n_buy FROM train GROUP BY symbol),
joined AS (
  SELECT t.symbol, t.bar_start, t.label AS y, t.return_4, coalesce(n_sell, 0) AS n_sell, coalesce(n_buy, 0) AS n_buy,
         CASE WHEN n_sell + n_buy > 0 THEN n_sell / (n_sell + n_buy) ELSE 0.5 END AS prior_sell,
         ('0x' || substr(md5('42:' || t.symbol || ':' || epoch_us(t.bar_start)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
  FROM test_labeled t LEFT JOIN priors p ON t.symbol = p.symbol),
predicted AS (
  SELECT 'naive_majority' AS model, symbol, bar_start, y,
         CASE WHEN n_buy > n_sell THEN 1 ELSE -1 END AS pred, prior_sell AS p_sell FROM joined
  UNION ALL SELECT 'naive_random_prior', symbol, bar_start, y,
         CASE WHEN draw < prior_sell THEN -1 ELSE 1 END, prior_sell FROM joined
  UNION ALL SELECT 'naive_momentum_return_4', symbol, bar_start, y,
         CASE WHEN return_4 >= 0 AND NOT isnan(return_4) THEN 1 ELSE -1 END,
         CASE WHEN return_4 >= 0 AND NOT isnan(return_4) THEN 0.0 ELSE 1.0 END FROM joined
  UNION ALL SELECT 'naive_buy_only', symbol, bar_start, y, 1, 0.0 FROM joined),
scored AS (SELECT *, 1 - p_sell AS p_buy FROM predicted)"""


def counts_cte(by: str) -> str:
    return f"""
counts AS (
  SELECT {by}, count(*) AS n, count(*) FILTER (y = pred) AS correct,
         count(*) FILTER (y = -1 AND pred = -1) AS tp_s, count(*) FILTER (y <> -1 AND pred = -1) AS fp_s,
         count(*) FILTER (y = -1 AND pred <> -1) AS fn_s,
         count(*) FILTER (y = 1 AND pred = 1) AS tp_b, count(*) FILTER (y <> 1 AND pred = 1) AS fp_b,
         count(*) FILTER (y = 1 AND pred <> 1) AS fn_b
  FROM scored GROUP BY {by}),
rates AS (
  SELECT *, coalesce(tp_s / nullif(tp_s + fp_s, 0), 0) AS precision_sell,
         coalesce(tp_s / nullif(tp_s + fn_s, 0), 0) AS recall_sell,
         coalesce(tp_b / nullif(tp_b + fp_b, 0), 0) AS precision_buy,
         coalesce(tp_b / nullif(tp_b + fn_b, 0), 0) AS recall_buy,
         coalesce(2 * tp_s / nullif(2 * tp_s + fp_s + fn_s, 0), 0) AS f1_sell,
         coalesce(2 * tp_b / nullif(2 * tp_b + fp_b + fn_b, 0), 0) AS f1_buy,
         (2 * tp_s + fp_s + fn_s > 0)::INTEGER + (2 * tp_b + fp_b + fn_b > 0)::INTEGER AS present
  FROM counts)"""


METRIC_COLUMNS = """correct / n AS accuracy, (f1_sell + f1_buy) / present AS f1_macro,
  precision_sell, recall_sell, precision_buy, recall_buy"""
AUC = """
pairs AS (
  SELECT a.model, sum(CASE WHEN a.p_buy > b.p_buy THEN 1.0 WHEN a.p_buy = b.p_buy THEN 0.5 ELSE 0.0 END)
           / count(*) AS roc_auc
  FROM scored a JOIN scored b ON a.model = b.model AND a.y = 1 AND b.y <> 1 GROUP BY a.model)"""

CURVE = f"""{FEATURED},
signals AS (
  SELECT *, CASE WHEN return_4 >= 0 AND NOT isnan(return_4) THEN 1 ELSE -1 END AS signal FROM featured),
held AS (
  SELECT *, first_value(signal) OVER (PARTITION BY symbol, idx // 4 ORDER BY idx) AS position FROM signals),
lagged AS (
  SELECT *, lag(position) OVER {W} AS p1, lag(position, 2) OVER {W} AS p2,
         lag(spread) OVER {W} AS s1 FROM held),
returns AS (
  SELECT *, coalesce(p1, 0) AS prev_position,
         CASE WHEN idx = 0 THEN 0.0
              ELSE p1 * (close / c1 - 1) - abs(p1 - coalesce(p2, 0)) * s1 / c1 END AS strategy_return
  FROM lagged),
levels AS (
  SELECT *, 10000 * product(1 + strategy_return) OVER (PARTITION BY symbol ORDER BY bar_start
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM returns),
curve AS (
  SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY bar_start
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak,
         lag(equity) OVER {W} AS prev_equity,
         equity - coalesce(lag(equity) OVER {W}, equity) AS bar_pnl FROM levels)"""
TRADES = f"""{CURVE},
changes AS (
  SELECT * FROM curve WHERE position <> prev_position),
exits AS (
  SELECT *, lead(idx) OVER {W} AS xi, lead(close) OVER {W} AS xc,
         lead(equity) OVER {W} AS xe, lead(bar_start) OVER {W} AS xt FROM changes),
ends AS (SELECT symbol, max(idx) AS li, arg_max(close, idx) AS lc, arg_max(equity, idx) AS le,
                max(bar_start) AS lt FROM curve GROUP BY symbol),
trades AS (
  SELECT e.symbol, e.idx AS entry_idx, coalesce(xi, li) AS exit_idx, bar_start AS entry_time,
         coalesce(xt, lt) AS exit_time, CASE WHEN position > 0 THEN 'LONG' ELSE 'SHORT' END AS direction,
         close AS entry_price, coalesce(xc, lc) AS exit_price, coalesce(xi, li) - e.idx AS bars_held,
         coalesce(xe, le) / equity - 1 AS trade_return, coalesce(xe, le) - equity AS trade_pnl_usd,
         coalesce(xe, le) - equity > 0 AS win
  FROM exits e JOIN ends USING (symbol) WHERE n > 1)"""
SHARPE = "CASE WHEN {sd} > 0 THEN sqrt(252 * 24) * avg({r}) / {sd} ELSE 0 END".format(
    sd="stddev_pop(equity / prev_equity - 1)", r="equity / prev_equity - 1"
)
PROFIT_FACTOR = """CASE WHEN coalesce(sum(trade_pnl_usd) FILTER (trade_pnl_usd > 0), 0) = 0 THEN 0.0
  WHEN coalesce(sum(trade_pnl_usd) FILTER (trade_pnl_usd < 0), 0) = 0 THEN 'inf'::DOUBLE
  ELSE sum(trade_pnl_usd) FILTER (trade_pnl_usd > 0) / abs(sum(trade_pnl_usd) FILTER (trade_pnl_usd < 0)) END"""


def calendar_cte(asset_class: str = "fx", source: str = "ticks") -> str:
    keep = "true" if asset_class == "crypto" else "isodow(slot) <= 5 OR (isodow(slot) = 7 AND hour(slot) >= 21)"
    return f"""
covered AS (SELECT symbol, date_trunc('hour', timestamp) AS slot, count(*) AS ticks FROM {source} GROUP BY ALL),
months AS (SELECT DISTINCT symbol, date_trunc('month', slot)::TIMESTAMP AS month_start FROM covered),
expected AS (
  SELECT symbol, slot FROM (
    SELECT symbol, unnest(generate_series(month_start, month_start + INTERVAL 1 MONTH - INTERVAL 1 HOUR,
                                          INTERVAL 1 HOUR)) AS slot FROM months)
  WHERE {keep}),
gone AS (SELECT e.* FROM expected e ANTI JOIN covered c ON e.symbol = c.symbol AND e.slot = c.slot)"""


LEDGER = """
ledger AS (
  SELECT r.symbol, r.month, r.rows, coalesce(m.missing, 0) AS missing_hours, coalesce(m.missing, 0) AS confirmed_absent
  FROM (SELECT symbol, strftime(slot, '%Y-%m') AS month, sum(ticks)::BIGINT AS rows FROM covered GROUP BY ALL) r
  LEFT JOIN (SELECT symbol, strftime(slot, '%Y-%m') AS month, count(*) AS missing FROM gone GROUP BY ALL) m
    ON r.symbol = m.symbol AND r.month = m.month)"""


def quantile_cols(x: str, spots: dict[str, float]) -> str:
    """Nearest-rank picks from the sorted list, the median interpolated."""
    cols = []
    for name, q in spots.items():
        if "median" in name:
            cols.append(f"quantile_cont({x}, {q}) AS {name}")
        else:
            cols.append(f"list_sort(list({x}))[1 + floor((count({x}) - 1) * {q}::DOUBLE + 0.5)::BIGINT] AS {name}")
    return ", ".join(cols)


SPREADS = {"min": 0, "p01": 0.01, "p05": 0.05, "median": 0.5, "p95": 0.95, "p99": 0.99, "max": 1}
GAPS = {"min_gap": 0, "p50_gap": 0.5, "p95_gap": 0.95, "p99_gap": 0.99, "max_gap": 1}
QUOTES = "ask, bid, ask_volume, bid_volume"
NULLS = ", ".join(f"count(*) FILTER ({c} IS NULL) AS {c}_nulls" for c in QUOTES.split(", "))


def histogram_sql(source: str, x: str) -> str:
    return f"""
edges AS (SELECT symbol, min({x})::DOUBLE AS lo, max({x})::DOUBLE AS hi FROM {source} GROUP BY symbol)
SELECT symbol, bin, lo + (hi - lo) / 100 * bin AS bin_start, lo + (hi - lo) / 100 * (bin + 1) AS bin_end, count(*) AS rows
FROM (SELECT b.symbol, lo, hi, coalesce(least(floor(({x} - lo) / nullif(hi - lo, 0) * 100), 99), 0)::BIGINT AS bin
      FROM {source} b JOIN edges USING (symbol) WHERE {x} IS NOT NULL)
GROUP BY symbol, bin, lo, hi"""


GAPPED = "(SELECT symbol, timestamp, date_diff('microsecond', lag(timestamp) OVER (PARTITION BY symbol ORDER BY timestamp), timestamp) AS gap_us FROM ticks)"

BAR_DOUBLES = "open high low close volume spread"
SQL: dict[str, str] = {}
DOUBLES: dict[str, list[str]] = {}


def sql(name: str, text: str, doubles: str = "") -> None:
    SQL[name], DOUBLES[name] = text.strip(), doubles.split()


sql("tick_projection", f"""WITH {EVENT_TICKS}
SELECT symbol, timestamp, seq, (ask + bid) / 2 AS mid, ask - bid AS spread, ask_volume + bid_volume AS tick_volume
FROM ticks""", "mid spread tick_volume")
sql("normalize_ticks", f"WITH {EVENT_TICKS} SELECT symbol, seq, timestamp, {QUOTES} FROM ticks", QUOTES.replace(",", ""))
for _tf, _bucket in {
    "1h": "date_trunc('hour', timestamp)",
    "15m": "time_bucket(INTERVAL '15 minutes', timestamp)",
    "1d": "date_trunc('day', timestamp)::TIMESTAMP",
    "1w": "date_trunc('week', timestamp)::TIMESTAMP",
    "1mo": "date_trunc('month', timestamp)::TIMESTAMP",
}.items():
    sql(f"bars_{_tf}", f"WITH {EVENT_TICKS}, {bars_cte(_bucket)} SELECT * FROM bars", BAR_DOUBLES)
DAILY = f"{ORDER_TICKS}, {bars_cte('date_trunc(' + chr(39) + 'day' + chr(39) + ', timestamp)::TIMESTAMP')}"
sql("bars_of_tied_ticks", f"WITH {DAILY} SELECT * FROM bars", BAR_DOUBLES)
sql("latest_months", f"""WITH {ORDER_TICKS}, m AS (SELECT *, strftime(timestamp, '%Y-%m') AS month FROM ticks)
SELECT month, count(*) AS ticks, avg(ask) AS avg_ask FROM m
WHERE month IN (SELECT DISTINCT month FROM m ORDER BY month DESC LIMIT 6) GROUP BY month""", "avg_ask")

_types = {"symbol": "string", "timestamp": "timestamp", "seq": "bigint", "ask": "double", "bid": "double",
          "ask_volume": "double", "bid_volume": "double"}
sql("schema_check", f"WITH {EVENT_TICKS} " + " UNION ALL ".join(
    f"""SELECT {i} AS position, '{c}' AS "column", '{t}' AS dtype, {str(c not in ("symbol", "seq")).lower()} AS required,
  count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls FROM ticks""" for i, (c, t) in enumerate(_types.items())))
sql("date_range", f"WITH {DAILY} SELECT symbol, min(bar_start) AS start, max(bar_start) AS end FROM bars GROUP BY symbol")
sql("tick_overview", f"""WITH {EVENT_TICKS}
SELECT symbol, count(*) AS rows, min(timestamp) AS start, max(timestamp) AS end,
  count(DISTINCT timestamp) + (max((timestamp IS NULL)::INTEGER)) AS unique_timestamps, {NULLS} FROM ticks GROUP BY symbol""")
sql("tick_quality", f"""WITH {LINE_TICKS}
SELECT symbol, count(*) FILTER (ask <= 0) AS ask_non_positive, count(*) FILTER (bid <= 0) AS bid_non_positive,
  count(*) FILTER (ask < bid) AS ask_below_bid, count(*) FILTER (ask - bid < 0) AS negative_spread,
  count(*) FILTER (ask - bid = 0) AS zero_spread, count(*) FILTER (ask_volume < 0) AS negative_ask_volume,
  count(*) FILTER (bid_volume < 0) AS negative_bid_volume FROM ticks GROUP BY symbol""")
for _name, _ticks in {"spread_quantiles": EVENT_TICKS, "spread_quantiles_lineitem": LINE_TICKS}.items():
    sql(_name, f"WITH {_ticks} SELECT symbol, {quantile_cols('(ask - bid)', SPREADS)} FROM ticks GROUP BY symbol", " ".join(SPREADS))
sql("gap_summary", f"WITH {EVENT_TICKS} SELECT symbol, {quantile_cols('gap_us', GAPS)} FROM {GAPPED} WHERE gap_us IS NOT NULL GROUP BY symbol")
sql("large_gaps_top20", f"""WITH {EVENT_TICKS}
SELECT * FROM {GAPPED} WHERE gap_us > 3600000000 ORDER BY gap_us DESC, symbol, timestamp LIMIT 20""")
sql("bar_gaps_top20", f"""WITH {BARS}
SELECT * FROM (SELECT symbol, bar_start, date_diff('microsecond', lag(bar_start) OVER {W}, bar_start) AS gap_us FROM bars)
WHERE gap_us > 3600000000 ORDER BY gap_us DESC, symbol, bar_start LIMIT 20""")
sql("duplicate_timestamps", f"""WITH {LINE_TICKS}
SELECT symbol, timestamp, count(*) AS n FROM ticks GROUP BY ALL HAVING count(*) > 1 ORDER BY n DESC, symbol, timestamp LIMIT 20""")
sql("first_ticks", f"WITH {EVENT_TICKS} SELECT symbol, timestamp, seq, {QUOTES} FROM ticks ORDER BY timestamp, seq LIMIT 10", QUOTES.replace(",", ""))
sql("last_bars", f"WITH {BARS} SELECT * FROM bars ORDER BY bar_start DESC, symbol DESC LIMIT 10", BAR_DOUBLES)
RETURNS_1H = f"{BARS}, r AS (SELECT *, close / lag(close) OVER {W} - 1 AS return_1h FROM bars)"
sql("bar_summary", f"""WITH {RETURNS_1H}
SELECT symbol, min(bar_start) AS start, max(bar_start) AS end, count(*) AS bars, min(close) AS min_close, max(close) AS max_close,
  avg(return_1h) AS mean_return_1h, stddev_samp(return_1h) AS std_return_1h,
  {quantile_cols("return_1h", {"p01_return_1h": 0.01, "p99_return_1h": 0.99}).replace("list(return_1h)", "list(return_1h) FILTER (return_1h IS NOT NULL)")},
  {quantile_cols("spread", {"median_spread": 0.5})}, quantile_cont(tick_count::DOUBLE, 0.5) AS median_tick_count
FROM r GROUP BY symbol""", "min_close max_close mean_return_1h std_return_1h p01_return_1h p99_return_1h median_spread median_tick_count")
SEASON = f"""WITH {RETURNS_1H}, season AS (
SELECT symbol, isodow(bar_start)::INTEGER AS weekday, hour(bar_start)::INTEGER AS hour, avg(tick_count) AS avg_tick_count,
  avg(spread) AS avg_spread, stddev_samp(return_1h) AS return_vol FROM r GROUP BY ALL)"""
sql("seasonality", f"{SEASON} SELECT * FROM season", "avg_tick_count avg_spread return_vol")
HOURS = [f"h{h:02d}" for h in range(24)]
sql("seasonality_pivot", f"""{SEASON} SELECT symbol, weekday,
{", ".join(f"max(avg_tick_count) FILTER (hour = {h}) AS h{h:02d}" for h in range(24))} FROM season GROUP BY symbol, weekday""", " ".join(HOURS))
sql("return_histogram", f"WITH {RETURNS_1H}, {histogram_sql('r', 'return_1h')}", "bin_start bin_end")
sql("spread_histogram", f"WITH {BARS}, {histogram_sql('bars', 'spread')}", "bin_start bin_end")
sql("tick_count_histogram", f"WITH {BARS}, {histogram_sql('bars', 'tick_count')}", "bin_start bin_end")

for _name, _columns in {
    "return_1h": "return_1h",
    "ret_features": "return_4 return_12",
    "ema_macd": "ema_12 ema_26 macd_pct",
    "rsi": "rsi_14",
    "adx": "adx_14",
    "atr": "atr_14",
    "bollinger": "bb_width bb_position",
    "volatility": "volatility_24 vol_ratio_6_24",
    "spread_z": "spread_z_24",
    "range_position": "close_in_range_24",
    "obv": "obv_z_48 obv_delta_12",
    "candle_structure": "body_pct upper_wick_pct lower_wick_pct range_pct",
    "microstructure": "spread_pct log_tick_count tick_count_z_24",
    "calendar": "hour_sin hour_cos dow_sin dow_cos",
}.items():
    sql(_name, f"{FEATURED} SELECT symbol, bar_start, {_columns.replace(' ', ', ')} FROM featured", _columns)
FLOAT_FEATURES = " ".join(c for c in C.FEATURES if c != "tick_count")
sql("all_features", f"{FEATURED} SELECT symbol, bar_start, {ALL_FEATURES} FROM featured", FLOAT_FEATURES)
sql("present_features", f"{FEATURED} SELECT symbol, bar_start, volume, spread, tick_count, return_4, return_12, rsi_14 FROM featured",
    "volume spread return_4 return_12 rsi_14")
sql("features_from_state", f"{FEATURED} SELECT symbol, bar_start, {ALL_FEATURES} FROM featured WHERE bar_start >= TIMESTAMP '2024-01-20'", FLOAT_FEATURES)
_daily = "return_4 return_12 ema_12 ema_26 macd_pct rsi_14 bb_width bb_position"
sql("daily_order_features", f"WITH {DAILY}, {FEATURES} SELECT symbol, bar_start, {_daily.replace(' ', ', ')} FROM featured", _daily)
sql("clean_features", f"{FEATURED} SELECT symbol, bar_start, {ALL_FEATURES} FROM featured WHERE {NO_NULLS}", FLOAT_FEATURES)

LABEL_COLS = "future_return, future_gap_hours, label, event_start, event_end"
sql("labels_fixed_horizon", f"{LABELS} SELECT symbol, bar_start, {LABEL_COLS} FROM marked WHERE valid", "future_return future_gap_hours")
sql("labels_without_gap_limit", f"""{FEATURED}, {labels_cte('featured', h=8, thr='0.001', gap=False)}
SELECT symbol, bar_start, future_return, label, event_start, event_end FROM marked WHERE valid""", "future_return")
sql("labeled_features", f"{LABELS} SELECT symbol, bar_start, {LABEL_COLS}, {ALL_FEATURES} FROM marked WHERE valid AND {NO_NULLS}",
    "future_return future_gap_hours " + FLOAT_FEATURES)
sql("label_distribution", f"""{LABELS} SELECT symbol, buy, sell, buy + sell AS total,
  CASE WHEN least(buy, sell) > 0 THEN round(least(buy, sell) / greatest(buy, sell), 4) ELSE 0.0 END AS balance_ratio
FROM (SELECT symbol, count(*) FILTER (label = 1) AS buy, count(*) FILTER (label = -1) AS sell FROM marked WHERE valid GROUP BY symbol)""", "balance_ratio")
sql("label_counts", f"""{LABELS} SELECT label, count(*) AS rows, 100 * count(*) / sum(count(*)) OVER () AS pct FROM marked WHERE valid GROUP BY label""", "pct")
_spots = {"min_future_return": 0, "p01_future_return": 0.01, "median_future_return": 0.5, "p99_future_return": 0.99, "max_future_return": 1}
sql("label_quantiles", f"{LABELS} SELECT symbol, {quantile_cols('future_return', _spots)} FROM marked WHERE valid GROUP BY symbol", " ".join(_spots))
sql("chrono_split", f"{SPLIT} SELECT symbol, bar_start, idx, part, slice_start, slice_end FROM sliced")
_parts = ", ".join(
    f"count(*) FILTER (part = '{p}') AS {p}_bars, min(bar_start) FILTER (part = '{p}') AS {p}_from, "
    f"max(bar_start) FILTER (part = '{p}') AS {p}_to"
    for p in ("train", "purge", "test")
)
sql("split_info", f"""{SPLIT} SELECT symbol, max(slice_end) FILTER (part = 'train') AS split,
  max(slice_start) FILTER (part = 'test') AS test_start, {_parts} FROM sliced GROUP BY symbol""")
sql("dataset_summary", f"""{SPLIT}, datasets AS (
  SELECT *, 'featured' AS dataset, CASE WHEN valid AND {NO_NULLS} THEN label END AS l FROM marked
  UNION ALL SELECT *, 'train', label FROM train
  UNION ALL SELECT *, 'test_labeled', label FROM test_labeled
  UNION ALL SELECT *, 'labeled_total', label FROM train
  UNION ALL SELECT *, 'labeled_total', label FROM test_labeled
  UNION ALL SELECT *, 'test_continuous', CASE WHEN valid THEN label END FROM marked WHERE part = 'test' AND {NO_NULLS})
SELECT symbol, dataset, count(*) AS rows, min(bar_start) AS start, max(bar_start) AS end,
  count(*) FILTER (l = 1) AS buy, count(*) FILTER (l = -1) AS sell, 30 AS feature_count FROM datasets GROUP BY symbol, dataset""")
sql("split_distributions", f"""{SPLIT}, parts_of AS (SELECT symbol, part, label FROM train UNION ALL SELECT symbol, part, label FROM test_labeled)
SELECT symbol, part, buy, sell, buy + sell AS total,
  CASE WHEN least(buy, sell) > 0 THEN round(least(buy, sell) / greatest(buy, sell), 4) ELSE 0.0 END AS balance_ratio
FROM (SELECT symbol, part, count(*) FILTER (label = 1) AS buy, count(*) FILTER (label = -1) AS sell FROM parts_of GROUP BY ALL)""", "balance_ratio")
sql("purged_rows_of_many_blocks", f"""{test_blocks_cte(50)}
SELECT n.symbol, n.row, b.fold::INTEGER AS fold FROM numbered n JOIN bounds b ON n.symbol = b.symbol
WHERE n.row < b.first_row AND n.event_start <= t_to AND n.event_end >= t_from""")
sql("purged_folds", f"{FOLDS} SELECT * FROM fold_rows")
sql("fold_sizes", f"""{FOLDS} SELECT symbol, fold, role, count(*) AS rows, min(row) AS first_row, max(row) AS last_row
FROM fold_rows GROUP BY ALL""")

sql("class_priors", f"""{SCORED} SELECT symbol, n_sell, n_buy,
  CASE WHEN n_sell + n_buy > 0 THEN n_sell / (n_sell + n_buy) ELSE 0.5 END AS prior_sell FROM priors""", "prior_sell")
sql("baseline_predictions", f"{SCORED} SELECT model, symbol, bar_start, y, pred, p_sell, p_buy FROM scored", "p_sell p_buy")
_metric = "accuracy f1_macro precision_sell recall_sell precision_buy recall_buy"
sql("class_metrics", f"{SCORED}, {counts_cte('model, symbol')} SELECT model, symbol, {METRIC_COLUMNS} FROM rates", _metric)
sql("class_report", f"""{SCORED}, {counts_cte('model')}
SELECT model, -1 AS label, precision_sell AS precision, recall_sell AS recall, f1_sell AS f1, tp_s + fn_s AS support FROM rates
UNION ALL SELECT model, 1, precision_buy, recall_buy, f1_buy, tp_b + fn_b FROM rates""", "precision recall f1")
sql("confusion_matrix", f"""{SCORED}, {counts_cte('model')}
SELECT model, -1 AS y, -1 AS pred, tp_s AS rows FROM counts UNION ALL SELECT model, -1, 1, fn_s FROM counts
UNION ALL SELECT model, 1, -1, fn_b FROM counts UNION ALL SELECT model, 1, 1, tp_b FROM counts""")
sql("roc_auc", f"""{SPLIT}, scored AS (
  SELECT 'rsi' AS model, label AS y, rsi_14 / 100 AS p_buy FROM test_labeled
  UNION ALL SELECT 'range', label, close_in_range_24 FROM test_labeled
  UNION ALL SELECT 'hour', label, hour(bar_start) / 24 FROM test_labeled), {AUC} SELECT * FROM pairs""", "roc_auc")
sql("baseline_metrics", f"""{SCORED}, {counts_cte('model')}, {AUC}
SELECT model, {METRIC_COLUMNS}, roc_auc FROM rates LEFT JOIN pairs USING (model)""", _metric + " roc_auc")

sql("held_positions", f"{CURVE} SELECT symbol, bar_start, signal, position, prev_position FROM curve")
sql("strategy_returns", f"{CURVE} SELECT symbol, bar_start, strategy_return FROM curve", "strategy_return")
sql("equity_curve", f"{CURVE} SELECT symbol, bar_start, equity, peak, bar_pnl FROM curve", "equity peak bar_pnl")
sql("drawdown", f"{CURVE} SELECT symbol, min((equity - peak) / peak) AS max_drawdown FROM curve GROUP BY symbol", "max_drawdown")
sql("sharpe", f"{CURVE} SELECT symbol, {SHARPE} AS sharpe FROM curve GROUP BY symbol", "sharpe")
_trade = "entry_price exit_price trade_return trade_pnl_usd"
sql("trades", f"{TRADES} SELECT * FROM trades", _trade)
sql("trades_table", f"""{TRADES} SELECT symbol, direction, entry_price, exit_price, bars_held, trade_return, trade_pnl_usd, win,
  strftime(entry_time, '%Y-%m-%d %H:%M:%S') AS entry_time, strftime(exit_time, '%Y-%m-%d %H:%M:%S') AS exit_time FROM trades""", _trade)
sql("trade_ratios", f"""{TRADES} SELECT symbol, avg(win::INTEGER) AS win_rate, count(*)::DOUBLE AS trades,
  {PROFIT_FACTOR} AS profit_factor FROM trades GROUP BY symbol""", "win_rate trades profit_factor")
sql("trade_summary", f"""{TRADES} SELECT symbol, count(*) AS total_trades, count(*) FILTER (win) AS wins, count(*) FILTER (NOT win) AS losses,
  round(avg(win::INTEGER), 4) AS win_rate, round(avg(bars_held), 1) AS avg_bars_held, round(avg(trade_pnl_usd), 2) AS avg_pnl_usd,
  coalesce(round(avg(trade_pnl_usd) FILTER (win), 2), 0) AS avg_win_pnl_usd,
  coalesce(round(avg(trade_pnl_usd) FILTER (NOT win), 2), 0) AS avg_loss_pnl_usd,
  round(max(trade_pnl_usd), 2) AS max_win_usd, round(min(trade_pnl_usd), 2) AS max_loss_usd,
  count(*) FILTER (direction = 'LONG') AS long_trades, count(*) FILTER (direction = 'SHORT') AS short_trades
FROM trades GROUP BY symbol""", "win_rate avg_bars_held avg_pnl_usd avg_win_pnl_usd avg_loss_pnl_usd max_win_usd max_loss_usd")
sql("exposure", f"""{CURVE} SELECT symbol, count(*) FILTER (position > 0) AS long_bar_count, count(*) FILTER (position < 0) AS short_bar_count,
  round(count(*) FILTER (position > 0) / count(*) * 100, 2) AS long_exposure_pct,
  round(count(*) FILTER (position < 0) / count(*) * 100, 2) AS short_exposure_pct FROM curve GROUP BY symbol""", "long_exposure_pct short_exposure_pct")
sql("turnover", f"""{TRADES} SELECT symbol, win_rate, turnover FROM
  (SELECT symbol, round(avg((position <> prev_position)::INTEGER), 6) AS turnover FROM curve GROUP BY symbol)
  JOIN (SELECT symbol, round(avg(win::INTEGER), 6) AS win_rate FROM trades GROUP BY symbol) USING (symbol)""", "win_rate turnover")
sql("backtest_metrics", f"""{TRADES} SELECT symbol, total_return, max_drawdown, sharpe, win_rate, trades, trade_signals, profit_factor FROM
  (SELECT symbol, arg_max(equity, idx) / 10000 - 1 AS total_return, min((equity - peak) / peak) AS max_drawdown, {SHARPE} AS sharpe,
          count(*) FILTER (position <> prev_position)::DOUBLE AS trade_signals FROM curve GROUP BY symbol)
  JOIN (SELECT symbol, avg(win::INTEGER) AS win_rate, count(*)::DOUBLE AS trades, {PROFIT_FACTOR} AS profit_factor
        FROM trades GROUP BY symbol) USING (symbol)""", "total_return max_drawdown sharpe win_rate trades trade_signals profit_factor")
sql("buy_hold_curve", f"""{CURVE} SELECT symbol, bar_start, equity,
  first_value(equity) OVER {W} * close / first_value(close) OVER {W} AS buy_hold FROM curve""", "equity buy_hold")
sql("predictions_table", f"""{CURVE}, {labels_cte('curve')}
SELECT symbol, bar_start, close, spread, CASE WHEN valid THEN label END AS label, CASE WHEN valid THEN signal END AS prediction,
  signal, position AS executed_position, bar_pnl AS bar_pnl_usd, equity AS equity_usd FROM marked""", "close spread bar_pnl_usd equity_usd")

sql("trading_calendar", f"WITH {EVENT_TICKS}, {calendar_cte()} SELECT symbol, slot FROM expected")
sql("crypto_calendar", f"""WITH {ORDER_TICKS}, {calendar_cte('crypto')}
SELECT symbol, strftime(slot, '%Y-%m') AS month, count(*) AS slots FROM expected GROUP BY ALL""")
sql("covered_hours", f"WITH {EVENT_TICKS}, {calendar_cte()} SELECT symbol, slot FROM covered")
sql("missing_hours", f"WITH {EVENT_TICKS}, {calendar_cte()} SELECT * FROM gone")
sql("month_ledger", f"WITH {EVENT_TICKS}, {calendar_cte()}, {LEDGER} SELECT * FROM ledger")
sql("order_month_ledger", f"WITH {ORDER_TICKS}, {calendar_cte('crypto')}, {LEDGER} SELECT * FROM ledger")
_order_rows = f"WITH {ORDER_TICKS}, {calendar_cte()}, {LEDGER} SELECT * FROM ledger"
_event_rows = f"WITH {EVENT_TICKS}, {calendar_cte()}, {LEDGER} SELECT * FROM ledger"
sql("ledger_upsert", f"SELECT * FROM ({_order_rows}) UNION ALL SELECT * FROM ({_event_rows})")
sql("pending_months", f"""WITH {EVENT_TICKS}, {calendar_cte()}, {LEDGER}
SELECT symbol, month FROM ledger WHERE missing_hours <> 0""")
sql("archive_totals", f"""WITH {EVENT_TICKS}, {calendar_cte()}, {LEDGER}
SELECT sum(rows)::BIGINT AS total_rows, sum(missing_hours)::BIGINT AS total_missing,
  count(*) FILTER (rows = 0 AND missing_hours > 0) AS total_errors FROM ledger""")
sql("dedup_keep_first", f"""WITH {ORDER_TICKS}
SELECT * FROM ticks QUALIFY row_number() OVER (PARTITION BY symbol, timestamp ORDER BY seq) = 1""", QUOTES.replace(",", ""))
_kept = "symbol, timestamp, seq, ask, bid, ask_volume, bid_volume"
HOLES = f"""
base AS (SELECT {_kept} FROM ticks WHERE hour(timestamp) NOT IN (3, 7)),
offered AS (SELECT symbol, timestamp, seq, ask + 1 AS ask, bid, ask_volume, NULL::DOUBLE AS bid_volume FROM ticks)"""
# Where a symbol gets a patch row in a month, one row stays of equal times: one of the archive, or else the one of lowest seq.
MERGED = f"""
touched AS (SELECT DISTINCT symbol, date_trunc('month', timestamp) AS month_start FROM patch),
keyed AS (SELECT *, date_trunc('month', timestamp) AS month_start FROM base),
merged AS (
  SELECT {_kept} FROM keyed k ANTI JOIN touched t ON k.symbol = t.symbol AND k.month_start = t.month_start
  UNION ALL
  SELECT {_kept} FROM (
    SELECT {_kept}, 0 AS source FROM keyed k SEMI JOIN touched t ON k.symbol = t.symbol AND k.month_start = t.month_start
    UNION ALL SELECT {_kept}, 1 FROM patch)
  QUALIFY row_number() OVER (PARTITION BY symbol, timestamp ORDER BY source, seq) = 1)"""
USABLE = """
patch AS (SELECT o.* FROM offered o SEMI JOIN gone g ON o.symbol = g.symbol AND date_trunc('hour', o.timestamp) = g.slot)"""
sql("patch_merge", f"WITH {EVENT_TICKS}, {HOLES}, patch AS (FROM offered), {MERGED} SELECT * FROM merged", QUOTES.replace(",", ""))
_repaired = f"WITH {EVENT_TICKS}, {HOLES}, {calendar_cte(source='base')}, {USABLE}, {MERGED}"
sql("repair_missing_hours", f"{_repaired} SELECT * FROM merged", QUOTES.replace(",", ""))
sql("repair_report", f"""{_repaired},
before_of AS (SELECT symbol, strftime(timestamp, '%Y-%m') AS month, count(*) AS before FROM base GROUP BY ALL),
after_of AS (SELECT symbol, strftime(timestamp, '%Y-%m') AS month, count(*) AS after FROM merged GROUP BY ALL),
left_over AS (SELECT symbol, strftime(slot, '%Y-%m') AS month, count(*) AS missing
              FROM (WITH {calendar_cte(source='merged')} SELECT * FROM gone) GROUP BY ALL)
SELECT symbol, month, after - coalesce(before, 0) AS rows_added, coalesce(missing, 0) AS still_missing
FROM after_of LEFT JOIN before_of USING (symbol, month) LEFT JOIN left_over USING (symbol, month)""")


_listed = """
listed AS (
  SELECT DISTINCT symbol, month_start FROM ticks,
    unnest([TIMESTAMP '2023-12-01', TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01']) m(month_start))"""
sql("month_enumeration", f"""WITH {EVENT_TICKS}, {_listed}
SELECT symbol, strftime(month_start, '%Y-%m') AS month, month_start FROM listed""")
_listed_ledger = f"""WITH {EVENT_TICKS}, {_listed}, {calendar_cte()},
slots AS (
  SELECT symbol, month_start, unnest(generate_series(month_start, month_start + INTERVAL 1 MONTH - INTERVAL 1 HOUR,
                                                     INTERVAL 1 HOUR)) AS slot
  FROM listed WHERE month_start + INTERVAL 1 MONTH < TIMESTAMP '2024-03-01'),
ledger AS (
  SELECT s.symbol, strftime(month_start, '%Y-%m') AS month, coalesce(sum(ticks), 0)::BIGINT AS rows,
         count(*) FILTER (ticks IS NULL AND (isodow(s.slot) <= 5 OR (isodow(s.slot) = 7 AND hour(s.slot) >= 21))) AS missing_hours,
         missing_hours AS confirmed_absent
  FROM slots s LEFT JOIN covered c ON s.symbol = c.symbol AND s.slot = c.slot GROUP BY s.symbol, month_start)"""
sql("absent_month_ledger", f"{_listed_ledger} SELECT * FROM ledger")
sql("absent_month_totals", f"""{_listed_ledger} SELECT sum(rows)::BIGINT AS total_rows, sum(missing_hours)::BIGINT AS total_missing,
  count(*) FILTER (rows = 0 AND missing_hours > 0) AS total_errors FROM ledger""")
_absent = HOLES.replace("offered AS", "same_month AS")
sql("repair_absent_month", f"""WITH {EVENT_TICKS}, {_absent}, {_listed},
offered AS (FROM same_month UNION ALL SELECT * REPLACE (timestamp + INTERVAL 31 DAY AS timestamp) FROM same_month),
complete AS (
  WITH {calendar_cte(source='base')}
  SELECT m.* FROM months m ANTI JOIN gone g ON m.symbol = g.symbol AND m.month_start = date_trunc('month', g.slot)
  WHERE m.month_start + INTERVAL 1 MONTH < TIMESTAMP '2024-03-01'),
work AS (SELECT l.* FROM listed l ANTI JOIN complete c ON l.symbol = c.symbol AND l.month_start = c.month_start),
{calendar_cte(source='base').replace("FROM months)", "FROM work)")},
{USABLE}, {MERGED}
SELECT *, strftime(timestamp, '%Y-%m') AS month FROM merged
WHERE date_trunc('month', timestamp) IN (SELECT month_start FROM touched)""", QUOTES.replace(",", ""))
sql("repair_tied_ticks", f"""WITH {ORDER_TICKS},
base AS (SELECT {_kept} FROM ticks WHERE timestamp >= TIMESTAMP '1995-01-01' AND timestamp < TIMESTAMP '1995-04-01'),
patched AS (
  SELECT *, 0 AS source FROM base WHERE symbol = 'F'
  UNION ALL SELECT symbol, timestamp + INTERVAL 5 HOUR, seq, ask + 1, bid, ask_volume, bid_volume, 1 FROM base
  WHERE symbol = 'F' AND isodow(timestamp) <= 5)
SELECT {_kept}, strftime(timestamp, '%Y-%m') AS month FROM (
  SELECT {_kept} FROM patched QUALIFY row_number() OVER (PARTITION BY timestamp ORDER BY source, seq) = 1
  UNION ALL SELECT {_kept} FROM base WHERE symbol <> 'F')""", QUOTES.replace(",", ""))
sql("archive_round_trip", f"""WITH {ORDER_TICKS}
SELECT {_kept}, strftime(timestamp, '%Y-%m') AS month FROM ticks
WHERE month IN (SELECT DISTINCT strftime(timestamp, '%Y-%m') AS m FROM ticks ORDER BY m DESC LIMIT 6)""", QUOTES.replace(",", ""))
sql("unreadable_months", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders WHERE month = '1995-03'")
sql("unreadable_month_ledger", f"""WITH {ORDER_TICKS},
months AS (SELECT symbol, date_trunc('month', timestamp)::TIMESTAMP AS month_start, count(*) AS rows, count(DISTINCT timestamp) AS hours
           FROM ticks GROUP BY ALL),
listed AS (SELECT * FROM (SELECT DISTINCT symbol FROM months), (SELECT DISTINCT month_start FROM months)),
readable AS (SELECT * FROM months WHERE month_start <> TIMESTAMP '1995-03-01')
SELECT symbol, strftime(month_start, '%Y-%m') AS month, coalesce(rows, 0) AS rows,
  date_diff('hour', month_start, month_start + INTERVAL 1 MONTH) - coalesce(hours, 0) AS missing_hours, missing_hours AS confirmed_absent
FROM listed LEFT JOIN readable USING (symbol, month_start)""")
sql("csv_round_trip", """SELECT event_id, ts,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN props WHEN 3 THEN ' , "a"" ' ELSE event_type END AS note,
  CASE WHEN event_id % 6 > 3 THEN value END AS number,
  CASE event_id % 6 WHEN 0 THEN 'null' WHEN 1 THEN 'nan' WHEN 2 THEN 'inf' WHEN 3 THEN '-inf'
    ELSE CASE WHEN value IS NULL THEN 'null' ELSE 'finite' END END AS kind FROM events""", "number")
_crypto_ledger = f"WITH {ORDER_TICKS}, {calendar_cte('crypto')}, {LEDGER}"
sql("ledger_json_read", f"""{_crypto_ledger} SELECT * FROM ledger
WHERE substr(month, 6)::INTEGER % 2 = 0 AND substr(month, 6) <> '10'""")
sql("json_round_trip", f"""{_crypto_ledger} SELECT symbol, month, rows,
  CASE WHEN rows > 100 THEN missing_hours END AS missing_hours, false AS broken FROM ledger""")
sql("spread_sketches", f"""WITH {LINE_TICKS}
SELECT symbol, quantile::DOUBLE AS quantile, count(*) AS n, true AS within_bound
FROM ticks, unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) q(quantile) GROUP BY ALL""", "quantile")
sql("distinct_time_sketches", f"""WITH {LINE_TICKS}
SELECT symbol, count(*) AS ticks, count(DISTINCT timestamp) AS distinct_times, true AS within_bound FROM ticks GROUP BY symbol""")
sql("oof_rows", f"""{FOLDS} SELECT f.symbol, f.bar_start, f.fold, f.row, t.label
FROM fold_rows f JOIN train t ON f.symbol = t.symbol AND f.bar_start = t.bar_start WHERE role = 'test'""")
sql("class_weights", f"""{SPLIT} SELECT label, count(*) AS rows,
  (SELECT count(*) FROM train) / (2.0::DOUBLE * count(*)) AS weight FROM train GROUP BY label""", "weight")
_long = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS value FROM train" for c in C.FEATURES)
sql("feature_medians", f"""{SPLIT}, long AS ({_long})
SELECT feature, quantile_cont(value, 0.5) AS median FROM long WHERE NOT isnan(value) GROUP BY feature""", "median")
sql("signal_rules", """SELECT event_id, CASE WHEN event_id % 9 >= 4 THEN 1 ELSE -1 END AS signal,
  CASE WHEN event_id % 9 > 4 THEN 1 ELSE -1 END AS prediction FROM events""")


def published(name: str) -> str:
    """The query with doubles rounded and non-finite values as NULL."""
    digits = DIGITS[name]
    columns = ", ".join(
        f'CASE WHEN isfinite("{c}") THEN round("{c}"::DOUBLE, {digits}) + 0.0::DOUBLE END AS "{c}"' for c in DOUBLES[name]
    )
    return f"SELECT * REPLACE ({columns}) FROM ({SQL[name]})" if columns else SQL[name]
