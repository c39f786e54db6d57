"""Model kernels against brute force, and the meta layer's rules."""

import itertools

import numpy as np
import pandas as pd
import pytest
from conftest import by_symbol
from pyspark.sql import functions as F

from tidemark.functions.arrays import spearman_rows
from tidemark.operators import meta as mt
from tidemark.operators import regime as rg
from tidemark.operators import ridge as rr
from tidemark.operators import trees as tr
from tidemark.operators import volatility as vo


def _toy_hmm():
    rng = np.random.default_rng(1)
    start, trans = np.array([0.5, 0.3, 0.2]), np.array([[0.9, 0.05, 0.05], [0.1, 0.8, 0.1], [0.05, 0.15, 0.8]])
    return start, trans, rng.normal(size=(7, 3))


def test_filter_and_path_match_enumeration():
    start, trans, dens = _toy_hmm()
    b = np.exp(dens)
    paths = list(itertools.product(range(3), repeat=7))
    prob = {p: start[p[0]] * b[0, p[0]] * np.prod([trans[p[t - 1], p[t]] * b[t, p[t]] for t in range(1, 7)]) for p in paths}
    post, loglik = rg.forward(start, trans, dens)
    assert loglik == pytest.approx(np.log(sum(prob.values())))
    last = np.array([sum(v for p, v in prob.items() if p[-1] == k) for k in range(3)])
    np.testing.assert_allclose(post[-1], last / last.sum())
    assert tuple(rg.best_path(start, trans, dens)) == max(prob, key=prob.get)
    gamma, counts, _ = rg.expectation(start, trans, dens)
    mid = np.array([sum(v for p, v in prob.items() if p[3] == k) for k in range(3)])
    np.testing.assert_allclose(gamma[3], mid / mid.sum())
    assert counts.sum() == pytest.approx(6)


def test_filtered_states_ignore_the_future():
    start, trans, dens = _toy_hmm()
    changed = dens.copy()
    changed[4:] = changed[4:][:, ::-1]
    np.testing.assert_array_equal(rg.forward(start, trans, dens)[0][:4], rg.forward(start, trans, changed)[0][:4])


def test_fit_recovers_separated_states():
    rng = np.random.default_rng(0)
    states = np.repeat([0, 1, 2, 0, 1, 2], 80)
    x = rng.normal(size=(480, 4)) * 0.3 + states[:, None] * np.array([0.0, 1.0, 3.0, 0.5])
    m = rg.fit_states(x)
    path = rg.forward(m["start"], m["trans"], rg.log_density(x, m["mean"], m["cov"]))[0].argmax(axis=1)
    assert (path == states).mean() > 0.98


def test_expanding_garch_equals_a_refit_at_every_date():
    rng = np.random.default_rng(3)
    r = rng.normal(0, 0.01, 90) * np.where(np.arange(90) > 60, 2.5, 1.0)
    fast = vo.expanding_garch(r)
    e = vo.SCALE * r
    anchor = ((e[:60] - e[:60].mean()) ** 2).mean()
    for t in (60, 70, 89):
        best = None
        for w, a, b in vo.grid():
            var, ll = anchor, 0.0
            for i in range(t):
                shock = (e[i] - (e[:i].mean() if i else 0.0)) ** 2
                ll -= 0.5 * (np.log(var) + shock / var)
                var = w * anchor + a * shock + b * var
            if best is None or ll > best[0]:
                best = (ll, var)
        assert fast[t] == pytest.approx(np.sqrt(best[1]) / vo.SCALE * np.sqrt(252), rel=1e-9)
    assert np.isnan(fast[:60]).all()


def test_garch_walk_falls_back_and_ignores_the_future(spark, bars, prices):
    w = bars.select("symbol", "date", F.log("close").alias("c"))
    rets = prices.assign(ret_bwd=prices.groupby("symbol").close.transform(lambda c: np.log(c).diff()))[["symbol", "date", "ret_bwd"]]
    df = spark.createDataFrame(rets.assign(ret_bwd=rets.ret_bwd.astype(float)))
    df = df.withColumn("ret_bwd", F.when(~F.isnan("ret_bwd"), F.col("ret_bwd")))
    out = by_symbol(vo.garch_walk(df, "2018-02-28"), "AAA")
    assert not out.fitted.iloc[0] and out.fitted.iloc[-1] and out.garch_vol_1d_ann.notna().all()
    cut = df.where(F.col("date") <= "2018-08-01")
    short = by_symbol(vo.garch_walk(cut, "2018-02-28"), "AAA")
    pd.testing.assert_frame_equal(short, out.iloc[: len(short)])
    assert w.columns


def test_spearman_rows_with_ties():
    x = np.array([[1.0, 2.0, 2.0, 4.0], [1.0, 1.0, 1.0, 1.0]])
    y = np.array([[10.0, 9.0, 9.5, 1.0], [1.0, 2.0, 3.0, 4.0]])
    got = spearman_rows(x, y)
    want = pd.Series(x[0]).rank().corr(pd.Series(y[0]).rank())
    assert got[0] == pytest.approx(want) and np.isnan(got[1])


def test_ridge_solution_satisfies_normal_equations():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(60, 5)), rng.normal(size=(60, 4))
    t = np.hstack([np.ones((60, 1)), x, y])
    m = t.T @ t
    beta, b0 = rr._solve(m, 2.0)
    xc, yc = x - x.mean(axis=0), y - y.mean(axis=0)
    np.testing.assert_allclose(xc.T @ (yc - xc @ beta), 2.0 * beta, atol=1e-9)
    pred = b0 + x @ beta
    want = 1 - ((y - pred) ** 2).sum(axis=0) / (yc**2).sum(axis=0)
    np.testing.assert_allclose(rr._r2(m, beta, b0), want)


def _model(saturated=frozenset()):
    return mt.WeightModel(
        mean=(0.0,) * 5, scale=(1.0,) * 5, coef={m: (0.5 * i,) * 5 for i, m in enumerate(("return", "vol", "regime", "drawdown"))},
        intercept=dict.fromkeys(("return", "vol", "regime", "drawdown"), 0.0), saturated=saturated,
    )


def test_weights_sum_to_one_above_floor(spark):
    rng = np.random.default_rng(7)
    rows = pd.DataFrame(rng.normal(size=(50, 5)) * 30, columns=list(mt.META_FEATURES)).assign(symbol="A", date=pd.bdate_range("2020-01-01", periods=50).date)
    df = spark.createDataFrame(rows)
    for sat in (frozenset(), frozenset({"return", "vol", "regime", "drawdown"})):
        w = mt.predict_weights(df, _model(sat)).toPandas()[[f"w_{m}" for m in ("return", "vol", "regime", "drawdown")]]
        np.testing.assert_allclose(w.sum(axis=1), 1.0, atol=1e-10)
        assert (w.min(axis=1) >= 0.05 - 1e-10).all()
    assert np.allclose(w, 0.25)


@pytest.mark.parametrize("tied", [False, True])
def test_pooled_ranking_equals_pairwise_count(spark, tied):
    rng = np.random.default_rng(11)
    p = rng.beta(2, 5, 400)
    p[: 150] = 0.25  # a third and more of all rows share one score
    p = np.round(p, 2) if tied else p
    y = (rng.uniform(size=400) < p).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"symbol": np.where(np.arange(400) % 3, "A", "B"), "event": y, "drawdown_risk_prob": p}))
    got = tr.pooled_ranking_metrics(tr.score_counts(df, ["symbol"]), slices=16).first()
    pos, neg = p[y == 1][:, None], p[y == 0][None, :]
    auc = ((pos > neg) + 0.5 * (pos == neg)).mean()
    ap = sum((y[p == s].sum() / y.sum()) * (y[p >= s].sum() / (p >= s).sum()) for s in np.unique(p))
    assert got.auc_roc == pytest.approx(auc) and got.aucpr == pytest.approx(ap)


def test_no_event_is_refused(spark):
    df = spark.createDataFrame([("train", 0, 1.0)], "split string, event int, x double")
    with pytest.raises(ValueError):
        tr.drawdown_fit(df, ["x"])


def test_regression_is_the_same_from_any_files(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 2))
    table = pd.DataFrame({"split": np.where(np.arange(600) % 4, "train", "val"), "a": x[:, 0], "b": x[:, 1], "y": x[:, 0] + rng.normal(size=600)})
    monkeypatch.setattr(tr, "TASK_ROWS", 200, raising=False)  # three tasks
    trees = []
    for seed, parts in ((0, 1), (1, 3), (2, 7)):
        rows = spark.createDataFrame(table.sample(frac=1, random_state=seed)).repartition(parts)
        trees.append(tr.return_fit(rows, ["a", "b"], "y", 5, 0.1).stages[-1].toDebugString.split("\n", 1)[1])
    assert len(set(trees)) == 1


def test_symbol_without_train_rows_keeps_its_rows(spark):
    from tidemark.plans.queries_models import GIVEN

    rng = np.random.default_rng(0)
    days = pd.bdate_range("2019-12-01", periods=60).date
    rows = [(s, d, *map(float, rng.normal(size=4))) for s in ("old", "new") for d in days if s == "old" or d > days[30]]
    x = spark.createDataFrame(rows, "symbol string, date date, ret double, vol_21d double, vix double, slope double")
    end = str(days[30])
    scaled = rg.scale_train_only(x, end)
    assert scaled.count() == len(rows) and scaled.where("symbol = 'new' AND vix IS NULL").count() == 29
    for states in (rg.filter_given(scaled, GIVEN), rg.decode(scaled, rg.hmm_fit(scaled, end))):
        assert states.where("symbol = 'new' AND state IS NULL").count() == 29 and states.where("symbol = 'old'").count() == 60


def test_garch_horizons_stay_in_the_jvm_and_equal_the_array_form(spark):
    rng = np.random.default_rng(3)
    days = pd.bdate_range("2019-01-01", periods=130).date
    rows = [(s, d, float(x)) for s in ("A", "B") for d, x in zip(days, rng.normal(0, 0.01, 130))]
    rows += [("short", d, 0.01 * (i % 3)) for i, d in enumerate(days[-40:])] + [("flat", d, 0.0) for d in days] + [("A", days[0].replace(year=2018), None)]
    df = spark.createDataFrame(rows, "symbol string, date date, ret_bwd double")
    end = str(days[90])
    got = vo.garch_horizons(df, end)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    wide = got.groupBy("symbol", "date", "fitted").pivot("h", [1, 2, 3, 4, 5]).agg(F.first("vol")).toPandas().set_index(["symbol", "date"]).sort_index()
    one = vo.garch_walk(df, end).toPandas().set_index(["symbol", "date"]).sort_index()
    np.testing.assert_allclose(wide["1"], one.garch_vol_1d_ann, rtol=1e-9)
    assert (wide.fitted == one.fitted).all() and not wide.loc["short"].fitted.any() and not wide.loc["flat"].fitted.any() and wide.loc["A"].fitted.all()
    steps = wide.loc["A"][["1", "2", "3", "4", "5"]].to_numpy() ** 2
    moves = np.diff(steps, axis=1)  # variances close in on one level: steps of one sign that shrink
    assert ((np.sign(moves) == np.sign(moves[:, :1])) | (np.abs(moves) < 1e-12)).all() and (np.abs(moves[:, 1:]) <= np.abs(moves[:, :-1]) + 1e-12).all()
