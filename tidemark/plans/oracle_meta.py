"""Oracle SQL building blocks for predictions, meta-features and backtests (DuckDB dialect)."""

from __future__ import annotations

from tidemark.operators.meta import META_FEATURES
from tidemark.plans.inputs import TRAIN_END, VAL_END, VAL_START, WEIGHT_MODEL
from tidemark.plans.oracle_base import W, guarded, rows
from tidemark.plans.registry import cte

PREDS = ("return_pred", "vol_pred", "regime_pred", "drawdown_risk_prob")
MODELS = ("return", "vol", "regime", "drawdown")
VAL = f"date BETWEEN DATE '{VAL_START}' AND DATE '{VAL_END}'"
RISK = "CASE regime_label WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 1 THEN 2 END"

cte("preds", f"""
SELECT symbol, date, close, r AS ret_bwd,
  {guarded('avg', 'rs', 5, -4, 0)} AS return_pred,
  sqrt(252) * {guarded('stddev_samp', 'rs', 21, -20, 0)} AS vol_pred,
  CASE WHEN vlag <= 19 THEN 0 WHEN vlag > 30 THEN 1 WHEN vlag IS NOT NULL THEN 2 END AS regime_label,
  CASE WHEN count(rs) OVER {rows(-20, 0)} = 21 THEN 1 / (1 + exp(sum(rs) OVER {rows(-20, 0)})) END AS drawdown_risk_prob, vlag
FROM (SELECT symbol, date, close, r, lag(r) OVER ({W}) AS rs, lag(VIXCLS) OVER ({W}) AS vlag FROM panel_ret JOIN macro_wide USING (date))""")
cte("preds_risk", f"SELECT *, CAST({RISK} AS DOUBLE) AS regime_pred FROM preds")
_TR = f"date <= DATE '{TRAIN_END}'"


def _stat(fn: str, c: str) -> str:
    return f"{fn}({c}) FILTER ({'k <= 252' if c == 'vol_pred' else _TR})"


cte("norm", "SELECT symbol, " + ", ".join(
    f"CASE WHEN {_stat('stddev_samp', c)} > 0 {'' if c == 'vol_pred' else 'AND ' + _stat('count', c) + ' >= 20'} THEN {_stat(fn, c)} END AS {p}_{c}"
    for c in PREDS for p, fn in (("mu", "avg"), ("sd", "stddev_samp"))
) + f" FROM (SELECT *, count(vol_pred) OVER ({W}) AS k FROM preds_risk) GROUP BY symbol")
cte("preds_z", "SELECT symbol, date, close, ret_bwd, regime_label, " + ", ".join(
    f"CASE WHEN sd_{c} IS NULL THEN {c} ELSE ({c} - mu_{c}) / sd_{c} END AS {c}" for c in PREDS
) + " FROM preds_risk JOIN norm USING (symbol)")
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in PREDS)
cte("dis_fit", "SELECT symbol, " + ", ".join(
    f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in PREDS
) + f" FROM preds_z WHERE {_COMPLETE} AND {VAL} GROUP BY symbol")
_Z = [f"z_{c}" for c in PREDS]
cte("preds_d", f"""
SELECT symbol, date, close, ret_bwd, regime_label, {', '.join(PREDS)}, CASE WHEN {_COMPLETE} THEN list_stddev_samp([{', '.join(_Z)}]) END AS disagreement
FROM (SELECT p.*, {', '.join(f'({c} - m_{c}) / s_{c} AS z_{c}' for c in PREDS)} FROM preds_z p JOIN dis_fit USING (symbol))""")


def ic_ctes(name: str, jobs: str) -> None:
    """Spearman over the 21 rows before each row, by self-join and average-tie ranks.

    ``jobs`` yields (symbol, date, job, x, y), already limited to participating rows.
    """
    cte(f"{name}_in", f"SELECT *, row_number() OVER (PARTITION BY symbol, job ORDER BY date) AS rn FROM ({jobs})")
    cte(f"{name}_pairs", f"""
SELECT a.symbol, a.job, a.date, b.x, b.y FROM {name}_in a
JOIN {name}_in b ON a.symbol = b.symbol AND a.job = b.job AND b.rn BETWEEN a.rn - 21 AND a.rn - 1""")
    cte(f"{name}_rank", f"""
SELECT symbol, job, date, x, y,
  rank() OVER (PARTITION BY symbol, job, date ORDER BY x) + (count(*) OVER (PARTITION BY symbol, job, date, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY symbol, job, date ORDER BY y) + (count(*) OVER (PARTITION BY symbol, job, date, y) - 1) / 2.0 AS ry
FROM {name}_pairs""")
    cte(f"{name}_long", f"""
SELECT symbol, job, date, CASE WHEN count(x) FILTER (y IS NOT NULL) = 21 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS ic
FROM {name}_rank GROUP BY ALL""")
    cte(name, f"""
SELECT symbol, date, max(ic) FILTER (job = 'return') AS rolling_ic_return, max(ic) FILTER (job = 'vol') AS rolling_ic_vol
FROM {name}_long GROUP BY symbol, date""")


def track_record(source: str) -> str:
    """E5-E8 style rolling columns over a source with predictions and ret_bwd."""
    call = "CASE regime_label WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END"
    return f"""
SELECT symbol, date,
  {guarded('sum', 'pr', 21, -20, 0)} AS rolling_pnl_return, {guarded('sum', 'pg', 21, -20, 0)} AS rolling_pnl_regime,
  {guarded('avg', 'disagreement', 21, -20, 0)} AS rolling_disagreement, {guarded('avg', 'hit', 21, -20, 0, at_least=10)} AS rolling_regime_accuracy
FROM (SELECT *, lag(s) OVER ({W}) * ret_bwd AS pr, lag(g) OVER ({W}) * ret_bwd AS pg,
        CASE WHEN lag(g) OVER ({W}) <> 0 AND ret_bwd IS NOT NULL THEN CAST(lag(g) OVER ({W}) = sign(ret_bwd) AS INTEGER) END AS hit
      FROM (SELECT *, sign(return_pred - avg(return_pred) OVER ({W})) AS s, {call} AS g FROM {source}))"""


cte("known_targets", f"""
SELECT symbol, date, lag(tgt_ret_1d, 2) OVER ({W}) AS pr, lag(tgt_vol_5d, 6) OVER ({W}) AS pv FROM tgt""")
ic_ctes("ic_train", """
SELECT symbol, date, 'return' AS job, return_pred AS x, pr AS y FROM preds_d JOIN known_targets USING (symbol, date) WHERE return_pred IS NOT NULL
UNION ALL BY NAME SELECT symbol, date, 'vol' AS job, vol_pred AS x, pv AS y FROM preds_d JOIN known_targets USING (symbol, date) WHERE vol_pred IS NOT NULL""")
cte("track", track_record("preds_d"))
cte("meta", "SELECT * FROM track LEFT JOIN ic_train USING (symbol, date)")

# Run-local view of the online loop: everything starts at the first run date.
cte("run_rows", f"SELECT * FROM preds_d WHERE {VAL}")
cte("run_past", f"""
SELECT *, lag(ret_bwd) OVER ({W}) AS pr,
  CASE WHEN count(ret_bwd) OVER {rows(-5, -1)} = 5 THEN stddev_samp(ret_bwd) OVER {rows(-5, -1)} END AS pv FROM run_rows""")
ic_ctes("ic_live", """
SELECT symbol, date, 'return' AS job, return_pred AS x, pr AS y FROM run_past WHERE return_pred IS NOT NULL
UNION ALL BY NAME SELECT symbol, date, 'vol' AS job, vol_pred AS x, pv AS y FROM run_past WHERE vol_pred IS NOT NULL""")
cte("track_live", track_record("run_rows"))
cte("meta_live", "SELECT * FROM track_live LEFT JOIN ic_live USING (symbol, date)")

# Proxy target on the validation slice.
_SIGN = {"return": "", "vol": "-", "regime": "-", "drawdown": "-"}
cte("proxy_raw", "SELECT symbol, date, " + ", ".join(
    f"CASE WHEN count(*) OVER {rows(1, 21)} = 21 AND count(p_{m}) OVER {rows(1, 21)} >= 5 THEN avg(p_{m}) OVER {rows(1, 21)} END AS y_{m}" for m in MODELS
) + " FROM (SELECT p.symbol, p.date, " + ", ".join(f"{_SIGN[m]}{c} * tgt_ret_1d AS p_{m}" for m, c in zip(MODELS, PREDS)) + f"""
  FROM (SELECT * FROM preds_d WHERE {VAL}) p LEFT JOIN (SELECT * FROM tgt WHERE {VAL}) t USING (symbol, date))""")
_YS = [f"y_{m}" for m in MODELS]
cte("proxy_known", f"SELECT * FROM proxy_raw WHERE {' AND '.join(f'{y} IS NOT NULL' for y in _YS)}")
cte("proxy", "SELECT symbol, date, " + ", ".join(
    f"({y} - avg({y}) OVER (PARTITION BY symbol)) / stddev_samp({y}) OVER (PARTITION BY symbol) AS {y}" for y in _YS) + " FROM proxy_known")
cte("meta_xy", f"""
SELECT *, CASE WHEN row_number() OVER ({W}) <= floor(0.7 * count(*) OVER (PARTITION BY symbol)) THEN 'train' ELSE 'eval' END AS part
FROM (SELECT symbol, date, {', '.join(META_FEATURES)}, {', '.join(_YS)} FROM (SELECT * FROM meta WHERE {VAL}) JOIN proxy USING (symbol, date)
WHERE {' AND '.join(f'{c} IS NOT NULL' for c in META_FEATURES)})""")


def score_sql(m: str) -> str:
    if m in WEIGHT_MODEL.saturated:
        return "0.0"
    terms = [f"{c!r} * ({f} - ({mu!r})) / {sd!r}" for f, c, mu, sd in zip(META_FEATURES, WEIGHT_MODEL.coef[m], WEIGHT_MODEL.mean, WEIGHT_MODEL.scale)]
    return " + ".join([repr(WEIGHT_MODEL.intercept[m]), *terms])


def weights_sql(source: str) -> str:
    complete = " AND ".join(f"{c} IS NOT NULL" for c in META_FEATURES)
    total = " + ".join(f"exp(s_{m})" for m in MODELS)
    return f"SELECT * EXCLUDE (s_return, s_vol, s_regime, s_drawdown), " + ", ".join(
        f"CASE WHEN {complete} THEN 0.8 * exp(s_{m}) / ({total}) + 0.05 END AS w_{m}" for m in MODELS
    ) + f" FROM (SELECT *, {', '.join(f'{score_sql(m)} AS s_{m}' for m in MODELS)} FROM {source})"


cte("weights_train", f"SELECT * FROM ({weights_sql('meta')}) WHERE w_return IS NOT NULL")
cte("weights_live", weights_sql("meta_live"))
BEFORE = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
cte("bt_weights", "SELECT symbol, date, " + ", ".join(
    f"coalesce(last_value(w_{m} IGNORE NULLS) OVER {BEFORE}, 0.25) AS w_{m}" for m in MODELS) + " FROM weights_live")
SIGNAL = "w_return * return_pred - w_vol * coalesce(vol_pred, 0) - w_regime * coalesce(regime_pred, 0) - w_drawdown * coalesce(drawdown_risk_prob, 0)"
cte("bt", f"""
SELECT *, lag(signal) OVER ({W}) * ret_bwd AS pnl_mag, sign(lag(signal) OVER ({W})) * ret_bwd AS pnl_dir
FROM (SELECT r.symbol, r.date, r.ret_bwd, {', '.join(f'w_{m}' for m in MODELS)}, {SIGNAL} AS signal FROM run_rows r JOIN bt_weights USING (symbol, date))""")


def sharpe_sql(x: str, sd: str = "stddev_samp") -> str:
    return f"CASE WHEN count({x}) >= 2 AND {sd}({x}) > 0 THEN avg({x}) / {sd}({x}) * sqrt(252) END"


def perf_sql(source: str, pnl: str, keys: str = "symbol") -> str:
    part = f"(PARTITION BY {keys} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""
SELECT {keys}, {sharpe_sql(pnl)} AS sharpe, avg({pnl}) * 252 AS ann_ret, stddev_samp({pnl}) * sqrt(252) AS ann_vol,
  avg(CAST({pnl} > 0 AS INTEGER)) AS hit_rate, min(cum - peak) AS max_dd, count({pnl}) AS n_days
FROM (SELECT *, max(cum) OVER {part} AS peak FROM (SELECT *, sum(coalesce({pnl}, 0)) OVER {part} AS cum FROM {source}))
GROUP BY {keys}"""


def _coalesced(c: str) -> str:
    return f"coalesce({c}, 0)"


_R, _V, _G, _D = (_coalesced(c) for c in PREDS)
cte("baselines", f"""
SELECT symbol, date, ret_bwd, 0.25 * {_R} AS B1_ret_only, 0.25 * ({_R} + {_V} + {_G} + {_D}) AS B2_naive_eq,
  0.25 * ({_R} - {_V} - {_G} - {_D}) AS B3_signed_eq, CAST(1.0 AS DOUBLE) AS B4_buy_hold FROM run_rows""")
cte("strategies", """
SELECT symbol, date, ret_bwd, strategy, signal, lag(signal) OVER w * ret_bwd AS pnl_mag, sign(lag(signal) OVER w) * ret_bwd AS pnl_dir
FROM (UNPIVOT baselines ON B1_ret_only, B2_naive_eq, B3_signed_eq, B4_buy_hold INTO NAME strategy VALUE signal)
WINDOW w AS (PARTITION BY symbol, strategy ORDER BY date)""")
cte("strategy_perf", f"""
SELECT symbol, strategy, p.sharpe AS dir_sharpe, m.sharpe AS mag_sharpe, p.ann_ret, p.ann_vol, p.hit_rate, p.max_dd
FROM ({perf_sql('strategies', 'pnl_dir', 'symbol, strategy')}) p JOIN ({perf_sql('strategies', 'pnl_mag', 'symbol, strategy')}) m USING (symbol, strategy)""")
