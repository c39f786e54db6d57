"""Oracle SQL building blocks: panels, features, targets, macro (DuckDB dialect)."""

from __future__ import annotations

from tidemark.plans.inputs import TEST_START, TRAIN_END, VAL_END, VAL_START
from tidemark.plans.registry import cte
from tidemark.sources.tables import MONTHLY_SERIES, PRIORITY_SERIES, SERIES

SPLIT = (
    f"CASE WHEN date <= DATE '{TRAIN_END}' THEN 'train' "
    f"WHEN date BETWEEN DATE '{VAL_START}' AND DATE '{VAL_END}' THEN 'val' "
    f"WHEN date >= DATE '{TEST_START}' THEN 'test' END"
)
W = "PARTITION BY symbol ORDER BY date"


def rows(a: int, b: int, part: str = W) -> str:
    def edge(n: int) -> str:
        return "CURRENT ROW" if n == 0 else f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}"

    return f"({part} ROWS BETWEEN {edge(a)} AND {edge(b)})"


def guarded(agg: str, x: str, n: int, a: int, b: int, part: str = W, at_least: int | None = None) -> str:
    over = rows(a, b, part)
    return f"CASE WHEN count({x}) OVER {over} >= {at_least or n} THEN {agg}({x}) OVER {over} END"


def pivot_series(value: str) -> str:
    return ", ".join(f"max(CASE WHEN series_id = '{s}' THEN {value} END) AS {s}" for s in SERIES)


def _bars(symbol: str) -> str:
    return f"""
SELECT symbol, date, arg_min(price, rn) AS open, max(price) AS high, min(price) AS low, arg_max(price, rn) AS close, sum(qty) AS volume
FROM (SELECT CAST({symbol} AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price, l_quantity AS qty,
        row_number() OVER (PARTITION BY {symbol}, CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn
      FROM lineitem) GROUP BY symbol, date"""


cte("bars", _bars("l_returnflag"))
cte("supplier_bars", f"SELECT * FROM ({_bars('l_suppkey')}) WHERE isodow(date) < 6")
cte("wbars", "SELECT * FROM bars WHERE isodow(date) < 6")
cte("shared_dates", "SELECT date FROM wbars GROUP BY date HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM wbars)")
cte("panel", "SELECT * FROM wbars WHERE date IN (SELECT date FROM shared_dates)")
cte("panel_ret", f"SELECT *, ln(close) - ln(lag(close) OVER ({W})) AS r FROM panel")
cte("hourly", """
SELECT event_type AS symbol, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, arg_min(value, event_id) AS open,
  max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close, count(*) AS volume
FROM events WHERE value > 0 GROUP BY ALL""")


def _features(source: str) -> str:
    r = "logret"
    return f"""
SELECT symbol, date, logret,
  sqrt(252) * {guarded('stddev_samp', r, 21, -20, 0)} AS vol_21d,
  sqrt(252) * {guarded('stddev_samp', r, 63, -62, 0)} AS vol_63d,
  {guarded('sum', r, 21, -20, 0)} AS mom_21d,
  {guarded('sum', r, 63, -62, 0)} AS mom_63d,
  {guarded('sum', r, 126, -125, 0)} AS mom_126d,
  4 * {guarded('stddev_samp', 'c1', 20, -19, 0)} / {guarded('avg', 'c1', 20, -19, 0)} AS bb_width
FROM (SELECT symbol, date, lag(close) OVER ({W}) AS c1, ln(lag(close) OVER ({W})) - ln(lag(close, 2) OVER ({W})) AS logret FROM {source})"""


def _atr(source: str) -> str:
    return f"""
SELECT symbol, date, lag(a) OVER ({W}) AS atr_14 FROM (
  SELECT symbol, date, {guarded('avg', 'tr', 14, -13, 0)} AS a FROM (
    SELECT symbol, date, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr
    FROM (SELECT *, lag(close) OVER ({W}) AS pc FROM {source})))"""


def _mdd(source: str) -> str:
    """Forward drawdown by joining each row to its next 21 rows and a running peak."""
    return f"""
SELECT symbol, date, CASE WHEN count(*) = 21 THEN min(dd) END AS mdd FROM (
  SELECT a.symbol, a.date, (b.close - max(b.close) OVER g) / max(b.close) OVER g AS dd
  FROM (SELECT *, row_number() OVER ({W}) AS rn FROM {source}) a
  JOIN (SELECT *, row_number() OVER ({W}) AS rn FROM {source}) b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn + 1 AND a.rn + 21
  WINDOW g AS (PARTITION BY a.symbol, a.rn ORDER BY b.rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
GROUP BY symbol, date"""


def _targets(source: str, mdd: str) -> str:
    return f"""
SELECT t.*, m.mdd AS tgt_mdd_21d FROM (
  SELECT symbol, date, ln(lead(close, 1) OVER ({W}) / close) AS tgt_ret_1d, ln(lead(close, 5) OVER ({W}) / close) AS tgt_ret_5d,
    ln(lead(close, 21) OVER ({W}) / close) AS tgt_ret_21d,
    {guarded('stddev_samp', 'r', 5, 1, 5)} AS tgt_vol_5d, {guarded('stddev_samp', 'r', 21, 1, 21)} AS tgt_vol_21d,
    count(*) OVER {rows(1, 21)} AS ahead
  FROM (SELECT *, ln(close) - ln(lag(close) OVER ({W})) AS r FROM {source})) t
LEFT JOIN {mdd} m USING (symbol, date)"""


cte("feat", _features("panel"))
cte("atr", _atr("wbars"))
cte("supplier_feat", _features("supplier_bars"))
cte("supplier_atr", _atr("supplier_bars"))
cte("fwd_mdd_21_rows", _mdd("panel"))
cte("fwd_mdd_21", "SELECT symbol, date, mdd FROM panel LEFT JOIN fwd_mdd_21_rows USING (symbol, date)")
cte("tgt_all", _targets("panel", "fwd_mdd_21_rows"))
cte("tgt_all_mdd", "SELECT symbol, date, tgt_mdd_21d FROM tgt_all")
cte("tgt", "SELECT * FROM tgt_all WHERE ahead = 21")
cte("supplier_mdd", _mdd("supplier_bars"))
cte("supplier_tgt_all", _targets("supplier_bars", "supplier_mdd"))
cte("supplier_tgt", "SELECT * FROM supplier_tgt_all WHERE ahead = 21")


def _rsi(name: str, source: str) -> None:
    """Wilder smoothing unrolled: weight (13/14)^(age) / 14, the seed keeping its full weight."""
    cte(f"{name}_moves", f"""
SELECT symbol, date, row_number() OVER ({W}) AS rn, greatest(d, 0) AS g, -least(d, 0) AS l
FROM (SELECT symbol, date, lag(close) OVER ({W}) - lag(close, 2) OVER ({W}) AS d FROM {source})""")
    cte(f"{name}_smooth", f"""
SELECT a.symbol, a.date, a.rn,
  sum(b.g * CASE WHEN b.rn = 3 THEN 1.0 ELSE 1.0 / 14 END * pow(13.0 / 14, a.rn - b.rn)) AS ag,
  sum(b.l * CASE WHEN b.rn = 3 THEN 1.0 ELSE 1.0 / 14 END * pow(13.0 / 14, a.rn - b.rn)) AS al
FROM {name}_moves a JOIN {name}_moves b ON a.symbol = b.symbol AND b.rn BETWEEN 3 AND a.rn GROUP BY ALL""")
    cte(name, f"""
SELECT m.symbol, m.date, CASE WHEN s.rn < 16 THEN NULL WHEN al > 0 THEN 100 - 100 / (1 + ag / al) WHEN ag = 0 AND al = 0 THEN 50 END AS rsi_14
FROM {name}_moves m LEFT JOIN {name}_smooth s USING (symbol, date)""")


_rsi("rsi", "panel")
cte("hourly_bars", "SELECT symbol, hour AS date, open, high, low, close, volume FROM hourly")
cte("hourly_feat", _features("hourly_bars"))
cte("hourly_atr", _atr("hourly_bars"))
cte("hourly_mdd", _mdd("hourly_bars"))
cte("hourly_tgt_all", _targets("hourly_bars", "hourly_mdd"))
cte("hourly_tgt", "SELECT * FROM hourly_tgt_all WHERE ahead = 21")
_rsi("hourly_rsi", "hourly_bars")

_SERIES_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PRIORITY_SERIES.items())
cte("macro_obs", f"""
SELECT series_id, CASE WHEN series_id = '{MONTHLY_SERIES}' THEN CAST(date_trunc('month', d) AS DATE) ELSE d END AS obs_date,
  avg(o_totalprice) / 10000 AS value
FROM (SELECT CASE o_orderpriority {_SERIES_CASE} END AS series_id, CAST(o_orderdate AS DATE) AS d, o_totalprice FROM orders)
GROUP BY ALL""")
cte("macro_known", f"""
SELECT series_id, CASE WHEN series_id = '{MONTHLY_SERIES}' THEN CAST(obs_date + INTERVAL 1 MONTH AS DATE) ELSE obs_date END AS obs_date, value
FROM macro_obs""")
cte("macro_long", f"""
SELECT g.series_id, g.date, m.value
FROM (SELECT date, unnest([{', '.join(repr(s) for s in SERIES)}]) AS series_id FROM shared_dates) g
ASOF LEFT JOIN macro_known m ON g.series_id = m.series_id AND g.date >= m.obs_date""")
cte("macro_wide", f"SELECT date, {pivot_series('value')} FROM macro_long GROUP BY date")
_O = "ORDER BY date"
cte("macro_feat", "SELECT *, " + guarded("avg", "yield_curve_slope", 21, -20, 0, _O) + f""" AS yield_curve_slope_21d_ma FROM (
  SELECT date, """ + ", ".join(
    f"lag({s}) OVER ({_O}) - lag({s}, {1 + k}) OVER ({_O}) AS {s}_change_{k}d" for s in ("DFF", "GS10") for k in (1, 5, 21)
) + f""", CPIAUCSL / lag(CPIAUCSL, 21) OVER ({_O}) - 1 AS cpi_surprise,
  CASE WHEN lag(VIXCLS) OVER ({_O}) <= 15 THEN 'low' WHEN lag(VIXCLS) OVER ({_O}) <= 25 THEN 'medium' WHEN lag(VIXCLS) OVER ({_O}) > 25 THEN 'high' END AS vix_regime,
  lag(VIXCLS) OVER ({_O}) - lag(VIXCLS, 6) OVER ({_O}) AS vix_change_5d, lag(VIXCLS) OVER ({_O}) - lag(VIXCLS, 22) OVER ({_O}) AS vix_change_21d,
  lag(GS10 - DFF) OVER ({_O}) AS yield_curve_slope FROM macro_wide)""")
cte("first_date", "SELECT min(date) AS d0 FROM shared_dates")
# Walk-forward folds: the month step is applied to the previous train end, as a recursion.
_NEXT = "CAST(CASE isodow({0}) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS INTEGER)"
_PREV = "CAST(CASE isodow({0}) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END AS INTEGER)"
cte("fold_ends", f"""
SELECT 0 AS fold, d0, e - {_PREV.format('e')} AS train_end
FROM (SELECT d0, CAST(d0 + INTERVAL 12 MONTH AS DATE) AS e FROM first_date)
UNION ALL
SELECT fold + 1, d0, CAST(train_end + INTERVAL 1 MONTH AS DATE) FROM fold_ends WHERE train_end < DATE '{VAL_END}'""")
cte("fold_all", f"""
SELECT fold, d0 AS train_start, train_end, test_start, e - {_PREV.format('e')} AS test_end FROM (
  SELECT *, CAST(test_start + INTERVAL 1 MONTH AS DATE) AS e FROM (
    SELECT *, train_end + {_NEXT.format('train_end')} AS test_start FROM fold_ends))""")
cte("fold_hits", """
SELECT f.fold, count(s.date) AS n FROM fold_all f LEFT JOIN shared_dates s ON s.date BETWEEN f.test_start AND f.test_end GROUP BY f.fold""")
cte("folds", f"""
SELECT * FROM fold_all WHERE test_end <= DATE '{VAL_END}'
  AND fold < coalesce((SELECT min(fold) FROM fold_hits WHERE n = 0), 1000000)""")
