"""Base predictors and the weight learner."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.functions.scalars import MODELS
from tidemark.functions.windows import ordered
from tidemark.operators import backtest as bt
from tidemark.operators import calendar as cal
from tidemark.operators import diagnostics as dg
from tidemark.operators import ensemble as en
from tidemark.operators import macro_features as mf
from tidemark.operators import meta as mt
from tidemark.operators import price_features as pf
from tidemark.operators import regime as rg
from tidemark.operators import ridge as rr
from tidemark.operators import splits as sp
from tidemark.operators import targets as tg
from tidemark.operators import trees as tr
from tidemark.operators import volatility as vo
from tidemark.plans import inputs as src
from tidemark.plans import oracle_base as ob
from tidemark.plans import oracle_meta as om
from tidemark.plans import oracle_ridge  # noqa: F401  (defines its building blocks)
from tidemark.plans.oracle_base import W, guarded
from tidemark.plans.registry import CTES, cte, register, twin
from tidemark.plans.stage import write_once
from tidemark.session import scratch_dir
from tidemark.sources import store

TREE_COLS = ["logret", "vol_21d", "vol_63d", "mom_21d", "mom_63d", "bb_width"]
# The fixture's prices swing far more than a daily index: its drawdown event sits near the median.
EVENT_AT = -0.989
# Rounds of the registered regression: a tenth of the library's 1000 at ten times its rate, to keep the query short.
QUERY_TREES, QUERY_RATE = 100, 0.1


# --- volatility ---------------------------------------------------------------

cte("rv", f"SELECT symbol, date, sqrt(252) * {guarded('stddev_samp', 'l', 21, -20, 0)} AS realized_vol_21d FROM (SELECT symbol, date, lag(r) OVER ({W}) AS l FROM panel_ret)")
cte("rv63", f"SELECT symbol, date, sqrt(252) * {guarded('stddev_samp', 'l', 63, -62, 0)} AS rv63 FROM (SELECT symbol, date, lag(r) OVER ({W}) AS l FROM panel_ret)")


@register("rv_predict", "symbol date realized_vol_21d:9", "SELECT * FROM rv")
def rv_predict(spark, sf):
    return vo.realized_vol(src.returns(spark, sf))


# The grid's points stepped through the history side by side: the state at row t knows the rows before it.
cte("garch_grid", "SELECT row_number() OVER () AS gp, u[1] AS om, u[2] AS al, u[3] AS be FROM (SELECT unnest([" + ", ".join(
    f"[{float(a)!r}, {float(b)!r}, {float(c)!r}]" for a, b, c in vo.grid()) + "]) AS u)")
cte("garch_rows", f"""
SELECT symbol, date, t, e, power(e - CASE WHEN t = 0 THEN 0 ELSE avg(e) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END, 2) AS shock,
  coalesce(CASE WHEN count(r) OVER ({W} ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING) = 21 THEN stddev_samp(r) OVER ({W} ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING) END,
    stddev_samp(r) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS plain
FROM (SELECT symbol, date, r, {vo.SCALE!r} * r AS e, row_number() OVER ({W}) - 1 AS t FROM panel_ret WHERE r IS NOT NULL)""")
cte("garch_anchor", f"""
SELECT symbol, var_pop(e) FILTER (t < {vo.MIN_OBS}) AS anchor FROM garch_rows GROUP BY symbol HAVING count(*) > {vo.MIN_OBS} AND anchor > 0""")
cte("garch_state", """
SELECT symbol, CAST(0 AS BIGINT) AS t, gp, om * anchor AS om, al, be, anchor AS v, CAST(0 AS DOUBLE) AS ll FROM garch_anchor, garch_grid
UNION ALL SELECT s.symbol, s.t + 1, gp, om, al, be, om + al * shock + be * v, ll - 0.5 * (ln(v) + shock / v)
FROM garch_state s JOIN garch_rows r ON s.symbol = r.symbol AND s.t = r.t""")
cte("garch", f"""
SELECT r.symbol, r.date, best IS NOT NULL AS fitted, coalesce(sqrt(best) / {vo.SCALE!r}, plain) * sqrt(252) AS garch_vol_1d_ann
FROM garch_rows r LEFT JOIN (SELECT symbol, t, arg_max(v, ll ORDER BY gp) AS best FROM garch_state WHERE t >= {vo.MIN_OBS} GROUP BY symbol, t) b ON r.symbol = b.symbol AND r.t = b.t
WHERE r.date >= DATE '{src.VAL_START}'""")


@register("garch_walk", "symbol date garch_vol_1d_ann:9 fitted", "SELECT * FROM garch")
def garch_walk(spark, sf):
    return vo.garch_walk(src.returns(spark, sf), src.TRAIN_END)


cte("garch_best", f"""
SELECT symbol, t, arg_max(v, ll ORDER BY gp) AS v, arg_max(om, ll ORDER BY gp) AS om, arg_max(al + be, ll ORDER BY gp) AS p FROM garch_state WHERE t >= {vo.MIN_OBS} GROUP BY symbol, t""")


@register("garch_horizons", "symbol date h:b vol:9 fitted", f"""
SELECT r.symbol, r.date, h, v IS NOT NULL AS fitted, coalesce(sqrt(om / (1 - p) + power(p, h - 1) * (v - om / (1 - p))) / {vo.SCALE!r}, plain) * sqrt(252) AS vol
FROM garch_rows r LEFT JOIN garch_best b ON r.symbol = b.symbol AND r.t = b.t, range(1, 6) AS ahead(h) WHERE r.date >= DATE '{src.VAL_START}'""")
def garch_horizons(spark, sf):
    return vo.garch_horizons(src.returns(spark, sf), src.TRAIN_END)


@register("vol_rmse", "symbol rmse_21:9 rmse_63:9 winner", f"""
SELECT symbol, a AS rmse_21, b AS rmse_63, CASE WHEN a <= b THEN 'rmse_21' ELSE 'rmse_63' END AS winner FROM (
  SELECT symbol, sqrt(avg(power(tgt_vol_5d * sqrt(252) - realized_vol_21d, 2))) AS a, sqrt(avg(power(tgt_vol_5d * sqrt(252) - rv63, 2))) AS b
  FROM rv JOIN rv63 USING (symbol, date) JOIN tgt USING (symbol, date) WHERE {om.VAL} GROUP BY symbol)""")
def vol_rmse(spark, sf):
    w = ordered("symbol")
    r = vo.realized_vol(src.returns(spark, sf)).withColumnRenamed("realized_vol_21d", "rmse_21")
    lagged = pf.with_lags(r, w).withColumn("rmse_63", pf.vol_cols(w)["vol_63d"])
    return vo.vol_rmse(sp.split_rows(lagged, "val", src.TRAIN_END, src.VAL_END), src.trimmed_targets(spark, sf), ["rmse_21", "rmse_63"])


@register("garch_rmse", "symbol garch_vol_1d_ann:9 realized_vol_21d:9 winner", f"""
SELECT symbol, a AS garch_vol_1d_ann, b AS realized_vol_21d, CASE WHEN a <= b THEN 'garch_vol_1d_ann' ELSE 'realized_vol_21d' END AS winner FROM (
  SELECT symbol, sqrt(avg(power(tgt_vol_5d * sqrt(252) - garch_vol_1d_ann, 2))) AS a, sqrt(avg(power(tgt_vol_5d * sqrt(252) - realized_vol_21d, 2))) AS b
  FROM garch JOIN rv USING (symbol, date) JOIN tgt USING (symbol, date) WHERE {om.VAL} GROUP BY symbol)""")
def garch_rmse(spark, sf):
    r = src.returns(spark, sf)
    both = vo.garch_walk(r, src.TRAIN_END).join(vo.realized_vol(r), ["symbol", "date"])
    both = sp.split_rows(both, "val", src.TRAIN_END, src.VAL_END)
    return vo.vol_rmse(both, src.trimmed_targets(spark, sf), ["garch_vol_1d_ann", "realized_vol_21d"])


# --- regime ---------------------------------------------------------------------

cte("regime_in", f"""
SELECT * FROM (SELECT symbol, date, ret, {guarded('stddev_samp', 'ret', 21, -20, 0)} AS vol_21d, vix, slope FROM (
  SELECT symbol, date, lag(r) OVER ({W}) AS ret, lag(VIXCLS) OVER ({W}) AS vix, lag(T10Y2Y) OVER ({W}) AS slope FROM panel_ret LEFT JOIN macro_wide USING (date)))
WHERE ret IS NOT NULL AND vol_21d IS NOT NULL AND vix IS NOT NULL AND slope IS NOT NULL""")


def _inputs(spark, sf):
    return rg.regime_inputs(src.panel(spark, sf), cal.macro_wide(src.macro_long(spark, sf)))


def _scaled(spark, sf):
    return rg.scale_train_only(_inputs(spark, sf), src.TRAIN_END)


@register("regime_inputs", "symbol date ret:9 vol_21d:9 vix:9 slope:9", "SELECT * FROM regime_in")
def regime_inputs(spark, sf):
    return _inputs(spark, sf)


cte("regime_scaled", "SELECT r.symbol, date, " + ", ".join(
    f"({c} - mu_{c}) / sd_{c} AS {c}" for c in rg.INPUTS) + " FROM regime_in r LEFT JOIN (SELECT symbol, " + ", ".join(
    f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in rg.INPUTS) + f" FROM regime_in WHERE date <= DATE '{src.TRAIN_END}' GROUP BY symbol) s USING (symbol)")


@register("scale_train_only", "symbol date ret:9 vol_21d:9 vix:9 slope:9", "SELECT * FROM regime_scaled")
def scale_train_only(spark, sf):
    return _scaled(spark, sf)


# Known parameters: calm, middle and stressed states, apart in volatility and VIX.
GIVEN = rg.GivenModel(
    start=(0.4, 0.4, 0.2),
    trans=((0.95, 0.04, 0.01), (0.03, 0.94, 0.03), (0.01, 0.05, 0.94)),
    mean=((0.05, -0.5, -0.9, 0.3), (0.0, 0.0, 0.0, 0.0), (-0.1, 0.6, 1.0, -0.3)),
    var=((0.6, 0.5, 0.4, 1.0), (1.0, 0.8, 0.5, 1.0), (1.8, 1.2, 0.6, 1.0)),
)


def _log_dens(j: int) -> str:
    return " + ".join(f"-0.5 * (power({c} - ({m!r}), 2) / {v!r} + ln(2 * pi() * {v!r}))" for c, m, v in zip(rg.INPUTS, GIVEN.mean[j], GIVEN.var[j]))


cte("given_dens", "SELECT symbol, date, t, " + ", ".join(f"exp(d{j} - greatest(d0, d1, d2)) AS b{j}" for j in range(3)) + f"""
FROM (SELECT symbol, date, row_number() OVER ({W}) AS t, {', '.join(f'{_log_dens(j)} AS d{j}' for j in range(3))} FROM regime_scaled)""")
cte("given_filter", "SELECT symbol, t, " + ", ".join(f"{GIVEN.start[j]!r} * b{j} / ({' + '.join(f'{GIVEN.start[i]!r} * b{i}' for i in range(3))}) AS p{j}" for j in range(3)) + """
FROM given_dens WHERE t = 1
UNION ALL SELECT symbol, t, q0 / (q0 + q1 + q2), q1 / (q0 + q1 + q2), q2 / (q0 + q1 + q2) FROM (
  SELECT f.symbol, d.t, """ + ", ".join(f"({' + '.join(f'p{i} * {GIVEN.trans[i][j]!r}' for i in range(3))}) * b{j} AS q{j}" for j in range(3)) + """
  FROM given_filter f JOIN given_dens d ON f.symbol = d.symbol AND d.t = f.t + 1)""")


@register("regime_filter_given", "symbol date state:i", """
SELECT symbol, date, CASE WHEN p0 IS NULL THEN NULL WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS state FROM given_filter JOIN given_dens USING (symbol, t)""")
def regime_filter_given(spark, sf):
    return rg.filter_given(_scaled(spark, sf), GIVEN)


@register("hmm_fit_report", "symbol n_train:b start_sums transitions_sum improved", f"""
SELECT symbol, count(*) AS n_train, true AS start_sums, true AS transitions_sum, true AS improved FROM regime_scaled WHERE date <= DATE '{src.TRAIN_END}' GROUP BY symbol""")
def hmm_fit_report(spark, sf):
    """What must hold of every fit: probabilities that sum to one, and a likelihood above that of one state for all rows."""
    x = write_once(_scaled(spark, sf), "regime-inputs").where(F.col("date") <= F.lit(src.TRAIN_END).cast("date"))
    fit = rg.hmm_fit(x, src.TRAIN_END)
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    # Standardised inputs: one state without correlation has n * d * (ln 2 pi + 1) / -2.
    one = x.groupBy("symbol").agg(F.count("*").alias("n_train"))
    flat = -0.5 * F.col("n_train") * len(rg.INPUTS) * (F.log(2 * F.lit(math.pi)) + 1)
    return one.join(fit, "symbol", "left").select(
        "symbol", "n_train", (F.abs(add("start") - 1) < 1e-9).alias("start_sums"), (F.abs(add("trans") - rg.N_STATES) < 1e-9).alias("transitions_sum"),
        (F.col("loglik") > flat).alias("improved"),
    )


@register("hmm_fit", "symbol loglik:6 n_iter:i")
def hmm_fit(spark, sf):
    return rg.hmm_fit(_scaled(spark, sf), src.TRAIN_END)


@register("regime_filtered", "symbol date state:i")
def regime_filtered(spark, sf):
    x = _scaled(spark, sf)
    return rg.decode(x, rg.hmm_fit(x, src.TRAIN_END))


@register("regime_smoothed", "symbol date state:i")
def regime_smoothed(spark, sf):
    x = _scaled(spark, sf)
    return rg.decode(x, rg.hmm_fit(x, src.TRAIN_END), smoothed=True)


@register("regime_agreement", "symbol n:b agreement:9")
def regime_agreement(spark, sf):
    x = _scaled(spark, sf)
    path = scratch_dir(spark, "hmm")
    rg.hmm_fit(x, src.TRAIN_END).write.parquet(path)
    model = spark.read.schema(rg.MODEL_SCHEMA).parquet(path)
    return rg.agreement(rg.decode(x, model), rg.decode(x, model, smoothed=True))


def _stand_in_states(spark, sf):
    """Closed-form states (the stand-in label shifted by one, so that mapping has work to do)."""
    p = src.preds(spark, sf).where("regime_label is not null")
    return p.select("symbol", "date", ((F.col("regime_label") + 1) % 3).alias("state"), F.col("vlag").alias("vix"), F.col("ret_bwd").alias("ret"))


cte("states", "SELECT symbol, date, (regime_label + 1) % 3 AS state, vlag AS vix, ret_bwd AS ret FROM preds WHERE regime_label IS NOT NULL")
cte("state_labels", """
SELECT symbol, state, median_vix, CASE place WHEN 1 THEN 0 WHEN 3 THEN 1 ELSE place END AS label FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY median_vix, state) AS place FROM (
    SELECT symbol, state, median(VIXCLS) FILTER (date <= DATE '""" + src.TRAIN_END + """') AS median_vix FROM states JOIN macro_wide USING (date) GROUP BY symbol, state))""")


cte("given_states", """
SELECT symbol, date, CASE WHEN p0 IS NULL THEN NULL WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS state FROM given_filter JOIN given_dens USING (symbol, t)""")
cte("given_labels", re.sub(r"\bstates\b", "given_states", CTES["state_labels"]))


def _given_labels(spark, sf):
    """Filtered states of the given model and their labels by the train rows' median VIX."""
    states = write_once(rg.filter_given(_scaled(spark, sf), GIVEN), "given-states")
    vix = cal.macro_wide(src.macro_long(spark, sf)).select("date", F.col("VIXCLS").alias("vix"))
    return states, rg.label_map(states.where("state IS NOT NULL"), vix, train_end=src.TRAIN_END)


@register("regime_filtered_labels", "symbol date state:i label:i", "SELECT symbol, date, state, label FROM given_states LEFT JOIN given_labels USING (symbol, state)")
def regime_filtered_labels(spark, sf):
    return rg.apply_labels(*_given_labels(spark, sf))


def _labels(spark, sf):
    states = _stand_in_states(spark, sf)
    vix = cal.macro_wide(src.macro_long(spark, sf)).select("date", F.col("VIXCLS").alias("vix"))
    return states, rg.label_map(states.drop("vix"), vix, train_end=src.TRAIN_END)


@register("regime_labels", "symbol state:i median_vix:9 label:i", f"""
SELECT symbol, state, median_vix, CASE place WHEN 1 THEN 0 WHEN 3 THEN 1 ELSE place END AS label FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY coalesce(median_vix, CAST('inf' AS DOUBLE)), state) AS place FROM (
    SELECT symbol, state, median_vix FROM (SELECT symbol, unnest([0, 1, 2]) AS state FROM (SELECT DISTINCT symbol FROM states)) LEFT JOIN (
      SELECT symbol, state, median(VIXCLS) FILTER (date <= DATE '{src.TRAIN_END}') AS median_vix FROM states JOIN macro_wide USING (date) GROUP BY symbol, state)
    USING (symbol, state)))""")
def regime_labels(spark, sf):
    return _labels(spark, sf)[1]


@register("regime_labelled", "symbol date label:i", "SELECT symbol, date, label FROM states JOIN state_labels USING (symbol, state)")
def regime_labelled(spark, sf):
    return rg.apply_labels(*_labels(spark, sf))


TRANS = f"""
SELECT *, n / sum(n) OVER (PARTITION BY symbol, src) AS p FROM (
  SELECT symbol, src, dst, count(*) AS n FROM (SELECT symbol, regime_label AS src, lead(regime_label) OVER ({W}) AS dst FROM preds WHERE regime_label IS NOT NULL)
  WHERE dst IS NOT NULL GROUP BY symbol, src, dst)"""
RUNS = f"""
SELECT symbol, label, count(*) AS n_runs, avg(len) AS avg_run FROM (
  SELECT symbol, run, label, count(*) AS len FROM (
    SELECT *, sum(fresh) OVER ({W}) AS run FROM (
      SELECT symbol, date, regime_label AS label, CASE WHEN regime_label <> lag(regime_label) OVER ({W}) THEN 1 ELSE 0 END AS fresh FROM preds WHERE regime_label IS NOT NULL))
  GROUP BY symbol, run, label) GROUP BY symbol, label"""


@register("regime_transition", "symbol src:i dst:i n:b p:9", TRANS)
def regime_transition(spark, sf):
    return rg.transitions(src.preds(spark, sf), "regime_label")


@register("regime_runs", "symbol label:i n_runs:b avg_run:9", RUNS)
def regime_runs(spark, sf):
    return rg.runs(src.preds(spark, sf), "regime_label")


@register("persistence_gate", "symbol label:i avg_run:9 p_stay:9 run_verdict stay_verdict", f"""
SELECT r.symbol, r.label, avg_run, p AS p_stay, CASE WHEN avg_run < 5 THEN 'FAIL' WHEN avg_run < 30 THEN 'WARN' ELSE 'PASS' END AS run_verdict,
  CASE WHEN p < 0.7 THEN 'FAIL' WHEN p < 0.85 THEN 'WARN' WHEN p >= 0.85 THEN 'PASS' END AS stay_verdict
FROM ({RUNS}) r LEFT JOIN (SELECT symbol, src, coalesce(max(p) FILTER (src = dst), 0) AS p FROM ({TRANS}) GROUP BY symbol, src) t ON r.symbol = t.symbol AND r.label = t.src""")
def persistence_gate(spark, sf):
    p = src.preds(spark, sf)
    return dg.persistence_gate(rg.runs(p, "regime_label"), rg.transitions(p, "regime_label"))


@register("regime_stats", "symbol label:i vix_median:9 vix_mean:9 vix_std:9 n:b mean_daily:9 std_daily:9 ann_return:9 ann_vol:9 sharpe_ann:9", """
SELECT * EXCLUDE (mean), CASE WHEN n >= 2 THEN mean END AS mean_daily, CASE WHEN n >= 2 THEN mean * 252 END AS ann_return,
  std_daily * sqrt(252) AS ann_vol, CASE WHEN n >= 2 THEN CASE WHEN std_daily > 0 THEN mean / std_daily * sqrt(252) ELSE 0 END END AS sharpe_ann
FROM (SELECT symbol, regime_label AS label, median(vlag) AS vix_median, avg(vlag) AS vix_mean, stddev_samp(vlag) AS vix_std, count(ret_bwd) AS n,
    avg(ret_bwd) AS mean, stddev_samp(ret_bwd) AS std_daily
  FROM preds WHERE regime_label IS NOT NULL GROUP BY symbol, regime_label)""")
def regime_stats(spark, sf):
    return rg.stats_by_label(src.preds(spark, sf), "regime_label", "vlag", "ret_bwd")


# --- trees -----------------------------------------------------------------------

cte("evald", f"""
SELECT p.symbol, p.date, p.return_pred, p.drawdown_risk_prob, t.tgt_ret_1d, CAST(t.tgt_mdd_21d < {EVENT_AT} AS INTEGER) AS event, {ob.SPLIT} AS split
FROM preds p JOIN tgt t USING (symbol, date)""")


def _evald(spark, sf):
    t = src.trimmed_targets(spark, sf).select("symbol", "date", "tgt_ret_1d", "tgt_mdd_21d")
    df = src.preds(spark, sf).join(t, ["symbol", "date"])
    return tr.with_event(sp.with_split(df, src.TRAIN_END, src.VAL_END), threshold=EVENT_AT)


def _tree_rows(spark, sf):
    p = src.panel(spark, sf)
    f = sp.with_split(pf.price_features(p, rsi=False), src.TRAIN_END, src.VAL_END)
    targets = tg.forward_targets(p).select("symbol", "date", "tgt_ret_1d", "tgt_mdd_21d")
    return tr.with_event(tr.training_rows(f, targets, "tgt_ret_1d", TREE_COLS), threshold=EVENT_AT)


_TREE_ROWS = "FROM feat JOIN tgt USING (symbol, date) WHERE tgt_ret_1d IS NOT NULL AND " + " AND ".join(f"{c} IS NOT NULL" for c in TREE_COLS)


# The drawdown model's matrix: price features, macro features and the ordinal VIX bucket.
MACRO_COLS = [c for c in mf.MACRO_FEATURES if c != "vix_regime"]
JOINED_COLS = [*TREE_COLS, *MACRO_COLS, "vix_code"]
_KNOWN_MACRO = " AND ".join(f"{c} IS NOT NULL" for c in [*MACRO_COLS, "vix_regime"])
_JOINED_ROWS = _TREE_ROWS.replace("JOIN tgt USING (symbol, date)", "JOIN tgt USING (symbol, date) JOIN macro_feat USING (date)") + f" AND {_KNOWN_MACRO}"


def _joined_rows(spark, sf, rows):
    macro = mf.macro_features(src.macro_long(spark, sf)).withColumn("vix_code", scalars.vix_ordinal(F.col("vix_regime")))
    return cal.merge_features(rows, macro).na.drop(subset=JOINED_COLS)


def _filled_rows(spark, sf, features):
    """The joined matrix for scoring: left join with every column carried forward, complete rows."""
    macro = mf.macro_features(src.macro_long(spark, sf)).withColumn("vix_code", scalars.vix_ordinal(F.col("vix_regime")))
    return cal.join_left_ffill(features, macro).na.drop(subset=JOINED_COLS)


def _fit_report(scored, label, pred, rounds, loss):
    """Checkable facts of a fit per split: rows, more than one round, better than the best constant on its own train rows,
    more values than one tree has leaves (of a single tree: than a constant has)."""
    own = loss(F.col(label), F.col(pred))
    const = scored.where("split = 'train'").agg(F.avg(label)).first()[0]
    return scored.groupBy("split").agg(
        F.count("*").alias("n"), F.lit(rounds > 1).alias("several_rounds"), F.count_if(F.col(pred).isNull() | F.isnan(pred)).alias("unknown"),
        F.when(F.col("split") == "train", F.avg(own) < F.avg(loss(F.col(label), F.lit(const)))).alias("beats_constant"),
        (F.count_distinct(pred) > (2**tr.RETURN_DEPTH if rounds > 1 else 1)).alias("varied"),
    )


_REPORT = "split n:b several_rounds unknown:b beats_constant varied"
_REPORT_SQL = f"""
SELECT split, count(*) AS n, true AS several_rounds, 0 AS unknown, CASE WHEN split = 'train' THEN true END AS beats_constant, true AS varied
FROM (SELECT {ob.SPLIT} AS split, tgt_mdd_21d {_TREE_ROWS}) """


def _squared(y, p):
    return (y - p) * (y - p)


def _log_loss(y, p):
    return -(y * F.log(p) + (1 - y) * F.log(1 - p))


def _best_kept(errors, kept, error):
    """Whether the fit has the validation error of its last round, which no earlier round reaches and none of the next within patience beats."""
    if not errors:
        return kept == QUERY_TREES
    best = errors[kept - 1]
    return math.isclose(error, best, rel_tol=1e-9) and all(e > best for e in errors[: kept - 1]) and all(e >= best for e in errors[kept : kept + tr.PATIENCE])


# How many rounds validation likes best hangs on the data, one included: what holds of every fit is that all were tried and the best kept.
@register("return_fit", _REPORT.replace("several_rounds", "tried:b best_kept"), _REPORT_SQL.replace(
    "true AS several_rounds", f"CASE WHEN bool_or(split = 'val') OVER () THEN {QUERY_TREES} ELSE 0 END AS tried, true AS best_kept") + "GROUP BY split")
def return_fit(spark, sf):
    rows = write_once(_tree_rows(spark, sf), "tree-rows")
    model, errors = tr.return_rounds(rows, TREE_COLS, "tgt_ret_1d", QUERY_TREES, QUERY_RATE)
    scored, kept = tr.score_returns(model, rows), tr.rounds_kept(model)
    error = scored.where("split = 'val'").agg(F.avg(_squared(F.col("tgt_ret_1d"), F.col("return_pred")))).first()[0]
    report = _fit_report(scored, "tgt_ret_1d", "return_pred", kept, _squared)
    return report.withColumns({"tried": F.lit(len(errors)), "best_kept": F.lit(_best_kept(errors, kept, error))})


@register("drawdown_fit", _REPORT, _REPORT_SQL.replace(_TREE_ROWS, _JOINED_ROWS) + "WHERE tgt_mdd_21d IS NOT NULL GROUP BY split")
def drawdown_fit(spark, sf):
    rows = write_once(_joined_rows(spark, sf, _tree_rows(spark, sf)).where("event is not null"), "joined-rows")
    model = tr.drawdown_fit(rows, JOINED_COLS)
    return _fit_report(tr.score_drawdown(model, rows), "event", "drawdown_risk_prob", tr.rounds_kept(model), _log_loss)


_ALL_KNOWN = " AND ".join(f"last_value({c} IGNORE NULLS) OVER g IS NOT NULL" for c in [*TREE_COLS, *MACRO_COLS, "vix_regime"])
cte("all_filled", f"""
SELECT symbol, date FROM (SELECT symbol, date, {_ALL_KNOWN} AS known FROM feat LEFT JOIN macro_feat USING (date)
  WINDOW g AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE known""")
cte("all_preds", f"""
SELECT symbol, date, r.close, NULL AS ret_bwd, r.symbol IS NOT NULL AS has_return, j.ok IS NOT NULL AS drawdown_ok, CAST(NULL AS DOUBLE) AS return_pred, garch_vol_1d_ann AS vol_pred,
  label AS regime_label, CAST(NULL AS DOUBLE) AS drawdown_risk_prob
FROM (SELECT symbol, date, 1.0 AS close FROM feat WHERE {" AND ".join(f"{c} IS NOT NULL" for c in TREE_COLS)}) r FULL JOIN (SELECT *, true AS ok FROM all_filled) j USING (symbol, date)
LEFT JOIN garch USING (symbol, date) LEFT JOIN given_states USING (symbol, date) LEFT JOIN given_labels USING (symbol, state)""")
twin("all_", "preds", ["preds_risk", "norm", "preds_z"])


@register("predict_all", "symbol date vol_pred:9 regime_label:i regime_pred:9 has_return drawdown_ok", """
SELECT symbol, date, z.vol_pred, z.regime_label, z.regime_pred, has_return, drawdown_ok FROM all_preds_z z JOIN all_preds p USING (symbol, date)""")
def predict_all(spark, sf):
    """Both tree models, the walk-forward volatility and filtered regimes on every row that a model can score, normalised.

    The models learn on rows with known targets; they score all rows, the drawdown model on the joined matrix (left
    join, carried forward) as it was trained.
    """
    rows = write_once(_tree_rows(spark, sf), "tree-rows")
    features = write_once(pf.price_features(src.panel(spark, sf), rsi=False), "all-features")
    joined = write_once(_filled_rows(spark, sf, features), "filled-rows")
    rm = tr.return_fit(rows, TREE_COLS, "tgt_ret_1d", QUERY_TREES, QUERY_RATE)
    events = joined.join(rows.select("symbol", "date", "split", "event"), ["symbol", "date"]).where("event is not null")
    dm = tr.drawdown_fit(events, JOINED_COLS)
    vol = vo.garch_walk(src.returns(spark, sf), src.TRAIN_END).withColumnRenamed("garch_vol_1d_ann", "vol_pred")
    regime = rg.apply_labels(*_given_labels(spark, sf)).withColumnRenamed("label", "regime_label")
    raw = write_once(tr.predict_all(features, joined, rm, dm, vol, regime), "raw-predictions")
    out = en.normalize(raw, en.fit_normalizer(raw, src.TRAIN_END))
    out = out.join(raw.select("symbol", "date", F.col("drawdown_risk_prob").alias("p")), ["symbol", "date"])
    return out.withColumns({"has_return": F.col("return_pred").isNotNull(), "drawdown_ok": F.coalesce(F.col("p").between(0, 1), F.lit(False))})


@register("model_io", "model n:b identical", f"""
SELECT 'return' AS model, count(*) AS n, true AS identical {_TREE_ROWS} UNION ALL SELECT 'drawdown', count(*), true {_JOINED_ROWS}""")
def model_io(spark, sf):
    rows = write_once(_tree_rows(spark, sf), "tree-rows")
    joined = write_once(_joined_rows(spark, sf, rows), "joined-rows")
    fits = {
        "return": (rows, tr.return_fit(rows, TREE_COLS, "tgt_ret_1d", QUERY_TREES, QUERY_RATE), tr.score_returns, "return_pred"),
        "drawdown": (joined, tr.drawdown_fit(joined.where("event is not null"), JOINED_COLS), tr.score_drawdown, "drawdown_risk_prob"),
    }
    out = []
    for name, (matrix, model, score, pred) in fits.items():
        path = scratch_dir(spark, "model")
        tr.save_model(model, path)
        a, b = (score(m, matrix).select("symbol", "date", F.col(pred).alias(c)) for m, c in ((model, "_a"), (tr.load_model(path), "_b")))
        same = F.bool_and(F.col("_a") == F.col("_b")).alias("identical")
        out.append(a.join(b, ["symbol", "date"]).agg(F.lit(name).alias("model"), F.count("*").alias("n"), same))
    return out[0].unionByName(out[1])


def _rank(x: str, part: str) -> str:
    return f"rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0"


RETURN_EVAL = f"""
SELECT symbol, split, corr(ry, rp) AS ic, sqrt(avg(power(tgt_ret_1d - return_pred, 2))) AS rmse,
  avg(CAST(sign(tgt_ret_1d) = sign(return_pred) AS INTEGER)) AS hit_rate, count(*) AS n
FROM (SELECT *, {_rank('tgt_ret_1d', 'symbol, split')} AS ry, {_rank('return_pred', 'symbol, split')} AS rp FROM evald WHERE return_pred IS NOT NULL AND tgt_ret_1d IS NOT NULL)
GROUP BY symbol, split"""


@register("return_eval", "symbol split ic:9 rmse:9 hit_rate:9 n:b", RETURN_EVAL)
def return_eval(spark, sf):
    return tr.return_eval(_evald(spark, sf), "tgt_ret_1d", "return_pred", ["symbol", "split"])


def _ranking_sql(keys: str, source: str) -> str:
    """AUC by rank sums and average precision by a running sum over descending scores."""
    return f"""
SELECT {keys}, auc_roc, aucpr FROM (
  SELECT {keys}, (sum(rk) FILTER (event = 1) - sum(event) * (sum(event) + 1) / 2.0) / nullif(sum(event) * (count(*) - sum(event)), 0) AS auc_roc
  FROM (SELECT *, {_rank('drawdown_risk_prob', keys)} AS rk FROM ({source})) GROUP BY {keys})
JOIN (SELECT {keys}, sum(event * prec) / nullif(sum(event), 0) AS aucpr FROM (
  SELECT *, sum(event) OVER g / count(*) OVER g AS prec FROM ({source})
  WINDOW g AS (PARTITION BY {keys} ORDER BY drawdown_risk_prob DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY {keys}) USING ({keys})"""


SCORED = "SELECT * FROM evald WHERE event IS NOT NULL AND drawdown_risk_prob IS NOT NULL"


DRAWDOWN_EVAL = f"""
SELECT * FROM ({_ranking_sql('symbol, split', SCORED)}) JOIN (
  SELECT symbol, split, CASE WHEN sum(call) > 0 THEN sum(call * event) / sum(call) ELSE 0 END AS precision, CASE WHEN sum(event) > 0 THEN sum(call * event) / sum(event) ELSE 0 END AS recall,
    -avg(event * ln(drawdown_risk_prob) + (1 - event) * ln(1 - drawdown_risk_prob)) AS log_loss, avg(event) AS base_rate, count(*) AS n
  FROM (SELECT *, CAST(drawdown_risk_prob >= 0.5 AS INTEGER) AS call FROM ({SCORED})) GROUP BY symbol, split) USING (symbol, split)"""


@register("drawdown_eval", "symbol split auc_roc:9 aucpr:9 precision:9 recall:9 log_loss:9 base_rate:9 n:b", DRAWDOWN_EVAL)
def drawdown_eval(spark, sf):
    return tr.drawdown_eval(_evald(spark, sf), ["symbol", "split"])


_METRICS = {"return": (RETURN_EVAL, ["ic", "rmse", "hit_rate"]), "drawdown": (DRAWDOWN_EVAL, ["auc_roc", "aucpr", "precision", "recall", "log_loss", "base_rate"])}


@register("metrics_models", "run_id model symbol split metric value:9", " UNION ALL ".join(
    f"SELECT 'run-1' AS run_id, '{m}' AS model, * FROM (UNPIVOT (SELECT symbol, split, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in names)} FROM ({sql})) ON {', '.join(names)} INTO NAME metric VALUE value)"
    for m, (sql, names) in _METRICS.items()))
def metrics_models(spark, sf):
    """The metrics of both tree models per symbol and split, as JSON under one run; unknown ones (one class only) aren't written."""
    path = scratch_dir(spark, "model-metrics")
    rows = write_once(_evald(spark, sf), "evaluated")
    for name, table in (("return", tr.return_eval(rows, "tgt_ret_1d", "return_pred", ["symbol", "split"])), ("drawdown", tr.drawdown_eval(rows, ["symbol", "split"]))):
        store.write_json(store.metric_rows(table, _METRICS[name][1], "run-1", name, ["symbol", "split"]).where("value IS NOT NULL"), path, "append")
    return spark.read.json(path)


@register("drawdown_eval_pooled", "pool auc_roc:9 aucpr:9", _ranking_sql("pool", f"SELECT *, 'all' AS pool FROM ({SCORED})"))
def drawdown_eval_pooled(spark, sf):
    return tr.pooled_ranking_metrics(tr.score_counts(_evald(spark, sf), ["symbol"]))


@register("class_balance", "symbol split positives:b negatives:b base_rate:9", """
SELECT symbol, split, sum(event) AS positives, sum(1 - event) AS negatives, avg(event) AS base_rate FROM evald WHERE event IS NOT NULL GROUP BY symbol, split""")
def class_balance(spark, sf):
    return tr.class_balance(_evald(spark, sf), ["symbol", "split"])


# --- weight learner -----------------------------------------------------------------


def _meta_rows(spark, sf):
    return write_once(src.meta_rows(spark, sf), "meta-rows")


RIDGE_COLS = "symbol model alpha:6 intercept:6 " + " ".join(f"coef_{i}:6" for i in range(5)) + " saturated fitted"


def _long_fit(fit):
    cells = [
        F.struct(
            F.lit(m).alias("model"), F.col(f"alpha_{m}").alias("alpha"), F.col(f"intercept_{m}").alias("intercept"),
            *[F.col(f"coef_{m}")[i].alias(f"coef_{i}") for i in range(5)], F.col(f"saturated_{m}").alias("saturated"), "fitted",
        )
        for m in MODELS
    ]
    return fit.select("symbol", F.inline(F.array(*cells)))


@register("ridge_cv", RIDGE_COLS, "SELECT * FROM ridge_models")
def ridge_cv(spark, sf):
    return _long_fit(rr.fit_ridge(_meta_rows(spark, sf).where("part = 'train'")))


@register("ridge_io", RIDGE_COLS, "SELECT * FROM ridge_models")
def ridge_io(spark, sf):
    path = scratch_dir(spark, "ridge")
    rr.save_fit(rr.fit_ridge(_meta_rows(spark, sf).where("part = 'train'")), path)
    return _long_fit(rr.load_fit(spark, path))


@register("saturation_report", "symbol model alpha:6 position verdict", """
SELECT symbol, model, alpha, CASE WHEN alpha IS NULL THEN 'unfitted' WHEN alpha >= 10000 THEN 'MAX' WHEN alpha <= 0.001 THEN 'min' ELSE 'interior' END AS position,
  CASE WHEN count(*) FILTER (saturated) OVER (PARTITION BY symbol) >= 3 THEN 'FAIL' WHEN count(*) FILTER (saturated) OVER (PARTITION BY symbol) >= 1 THEN 'WARN' ELSE 'PASS' END AS verdict
FROM ridge_models""")
def saturation_report(spark, sf):
    return dg.alpha_positions(rr.fit_ridge(_meta_rows(spark, sf).where("part = 'train'")), rr.ALPHAS_V2)


_FEAT_STATS = "SELECT symbol, " + ", ".join(f"avg({c}) AS mu{i}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END AS sd{i}" for i, c in enumerate(mt.META_FEATURES)) + " FROM learner_xy WHERE part = 'train' GROUP BY symbol"
_LINEAR = "intercept + " + " + ".join(f"coef_{i} * ({c} - mu{i}) / sd{i}" for i, c in enumerate(mt.META_FEATURES))


cte("lift_rows", "SELECT p.symbol, p.date, p.ret_bwd, " + ", ".join(f"w_{m}" for m in MODELS) + f", {om.SIGNAL} AS meta, " + """
  0.25 * (return_pred - coalesce(vol_pred, 0) - coalesce(regime_pred, 0) - coalesce(drawdown_risk_prob, 0)) AS equal
FROM preds_d p JOIN lift_weights USING (symbol, date)""")
cte("lift_weights", "SELECT symbol, date, " + ", ".join(f"0.8 * max(e) FILTER (model = '{m}') / sum(e) + 0.05 AS w_{m}" for m in MODELS) + f"""
  , coalesce(bool_and(fitted), false) AS fitted
FROM (SELECT x.symbol, date, x.model, fitted, exp(CASE WHEN coalesce(fitted, false) AND NOT saturated THEN {_LINEAR} ELSE 0 END) AS e
  FROM (SELECT *, unnest(['return', 'vol', 'regime', 'drawdown']) AS model FROM learner_xy WHERE part = 'eval') x
  LEFT JOIN ridge_models m ON x.symbol = m.symbol AND x.model = m.model LEFT JOIN ({_FEAT_STATS}) s ON x.symbol = s.symbol) GROUP BY symbol, date""")
cte("lift_meta", f"SELECT symbol, date, lag(meta) OVER ({W}) * ret_bwd AS pnl FROM lift_rows")
cte("lift_equal", f"SELECT symbol, date, lag(equal) OVER ({W}) * ret_bwd AS pnl FROM lift_rows")


@register("learned_weights", "symbol date w_return:6 w_vol:6 w_regime:6 w_drawdown:6 fitted", "SELECT * FROM lift_weights")
def learned_weights(spark, sf):
    rows = _meta_rows(spark, sf)
    fit = rr.fit_ridge(rows.where("part = 'train'"))
    return mt.predict_weights_by_symbol(rows.where("part = 'eval'"), fit)


@register("learned_lift", "symbol meta_sharpe:6 equal_sharpe:6 n_days:b", f"""
SELECT m.symbol, m.sharpe AS meta_sharpe, e.sharpe AS equal_sharpe, m.n_days FROM ({om.perf_sql('lift_meta', 'pnl')}) m JOIN ({om.perf_sql('lift_equal', 'pnl')}) e USING (symbol)""")
def learned_lift(spark, sf):
    w = learned_weights(spark, sf).select("symbol", "date", *bt.WEIGHTS)
    return bt.evaluate_lift(src.preds_d(spark, sf).join(w, ["symbol", "date"]))
