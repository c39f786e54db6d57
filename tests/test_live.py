"""The online loop on typed state: streamed features against the batch, restarts, replays, failures."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest as bt
from tidemark.operators import ensemble as en
from tidemark.operators import regime as rg
from tidemark.operators import trees as tr
from tidemark.operators.meta import WeightModel
from tidemark.plans.inputs import WEIGHT_MODEL
from tidemark.plans.queries_models import GIVEN
from tidemark.session import scratch_dir
from tidemark.sources import store
from tidemark.streaming import live as lv
from tidemark.streaming import scoring as sc
from tidemark.streaming import sink

COLS = ["f1", "f2"]


def feature_frame(n=150, seed=4):
    rng = np.random.default_rng(seed)
    parts = []
    for s in ("A", "B"):
        f = rng.normal(size=(n, 2))
        pdf = pd.DataFrame({"symbol": s, "date": pd.bdate_range("2020-01-01", periods=n).date, "f1": f[:, 0], "f2": f[:, 1], "vol_21d": rng.uniform(0.1, 0.4, n)})
        pdf["ret_bwd"] = rng.normal(0, 0.01, n)
        for c in rg.INPUTS:
            pdf[f"regime_{c}"] = rng.normal(size=n)
        pdf["y"] = f[:, 0] + 0.1 * rng.normal(size=n)
        pdf["event"] = (f[:, 1] > 0).astype(int)
        pdf["split"] = np.where(np.arange(n) < 60, "train", "val")
        pdf.loc[70:74, "f1"] = np.nan  # rows the models can't score
        pdf.loc[[80, 90], "regime_vix"] = np.nan
        parts.append(pdf)
    return pd.concat(parts, ignore_index=True).astype(object).where(lambda x: x.notna(), None)


SCHEMA = "symbol string, date date, f1 double, f2 double, vol_21d double, ret_bwd double, " + ", ".join(f"regime_{c} double" for c in rg.INPUTS) + ", y double, event int, split string"


@pytest.fixture(scope="module")
def world(spark):
    rows = spark.createDataFrame(feature_frame(), SCHEMA).cache()
    root = scratch_dir(spark, "live-test")
    clean = rows.na.drop(subset=COLS)
    tr.save_model(tr.return_fit(clean, COLS, "y", 12, 0.3, 5), f"{root}/r")
    tr.save_model(tr.drawdown_fit(clean, COLS), f"{root}/d")
    end = "2020-03-24"
    inputs = rows.select("symbol", "date", *[F.col(f"regime_{c}").alias(c) for c in rg.INPUTS])
    labels = spark.createDataFrame([(s, 0, 2, 1) for s in ("A", "B")], "symbol string, label_0 int, label_1 int, label_2 int")
    parts = dict(returns=tr.load_model(f"{root}/r"), drawdown=tr.load_model(f"{root}/d"), regime=GIVEN, weights=WEIGHT_MODEL, scaling=rg.scale_stats(inputs, end), labels=labels)
    raw = lv.batch_predictions(rows, lv.LiveModels(**parts))
    path = f"{root}/raw"
    raw.write.parquet(path)
    raw = spark.read.parquet(path)
    norm = en.fit_normalizer(raw, end)
    models = lv.LiveModels(**parts, normalizer=norm, disagreement=en.fit_disagreement(en.normalize(raw, norm), None, end))
    tables = store.FeatureStore(spark, f"{root}/tables")
    versions = lv.save_tables(models, tables)
    kept = {k: v for k, v in parts.items() if k not in ("scaling", "labels")}
    return rows, raw, lv.LiveModels(**kept, **lv.load_tables(tables, versions))


def frame(df):
    return df.toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)


def deliver(spark, root, part, models, initial=None, audit=None):
    part.repartition(2).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(part.schema).parquet(f"{root}/in")
    with lv.rocks_store(spark):
        sink.run_available(lv.write_live(lv.live_signals(stream, models, initial), root, f"{root}/cp", audit, "run"))


def test_features_in_signals_out_equal_the_batch(spark, world):
    rows, raw, models = world
    days = sorted(r.date for r in rows.select("date").distinct().collect())
    run = rows.where(F.col("date") >= F.lit(days[60]))
    start = lv.regime_start(raw.where(F.col("date") < F.lit(days[60])))
    root, audit = scratch_dir(spark, "live-a"), None
    audit = store.WeightAudit(spark, f"{root}/audit")
    deliver(spark, root, run.where(F.col("date") < F.lit(days[100])), models, start, audit)
    deliver(spark, root, run.where(F.col("date") >= F.lit(days[95])), models, start, audit)
    want = frame(bt.backtest(lv.batch_rows(raw.where(F.col("date") >= F.lit(days[60])), models), models.weights))
    got = frame(spark.read.parquet(f"{root}/signals"))
    assert len(got) == len(want) == 180 and want.signal.isna().sum() == 10 and (~got.fallback).sum() > 50
    for c in ("signal", *bt.WEIGHTS, "disagreement"):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), atol=1e-9, err_msg=c)
    counters = spark.read.parquet(f"{root}/counters").orderBy("batch_id").collect()
    assert [(r.rows, r.late, r.failed) for r in counters] == [(80, 0, 0), (100, 10, 0)]
    log = frame(audit.load("run"))
    np.testing.assert_allclose(log.return_w, got.w_return)
    held = {r.symbol: r for r in lv.stored_value(spark, f"{root}/cp", "run").collect()}
    assert {s: (r.seen, r.late, r.last_date) for s, r in held.items()} == {s: (90, 5, days[-1]) for s in ("A", "B")}
    assert {r.symbol: r.n for r in lv.stored_list(spark, f"{root}/cp", "pairs_return").groupBy("symbol").agg(F.count("*").alias("n")).collect()} == {"A": 21, "B": 21}

    # a second loop that starts from the state a batch over the first forty days leaves
    first = raw.where(F.col("date").between(F.lit(days[60]), F.lit(days[99])))
    other = scratch_dir(spark, "live-b")
    deliver(spark, other, run.where(F.col("date") >= F.lit(days[100])), models, lv.state_after(lv.batch_rows(first, models), models.weights))
    resumed = frame(spark.read.parquet(f"{other}/signals"))
    tail = want[want.date >= days[100]].reset_index(drop=True)
    np.testing.assert_allclose(resumed.signal.astype(float), tail.signal.astype(float), atol=1e-9)


def run_rows(n=60, seed=1):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"symbol": "A", "date": pd.bdate_range("2020-01-01", periods=n).date, **{c: rng.normal(size=n) for c in sc.INPUT[2:]}, "regime_label": rng.integers(0, 3, n)})


@pytest.mark.parametrize("broken", ["missing", "overflow"])
def test_failed_score_falls_back_to_equal_weights_and_is_flagged(broken):
    coef = {k: v for k, v in WEIGHT_MODEL.coef.items() if k != "vol"} if broken == "missing" else WEIGHT_MODEL.coef | {"vol": (float("inf"),) * 5}
    bad = WeightModel(WEIGHT_MODEL.mean, WEIGHT_MODEL.scale, coef, WEIGHT_MODEL.intercept, WEIGHT_MODEL.saturated)
    rows = run_rows()
    good, _ = sc.score_block(rows, dict(sc.FRESH), WEIGHT_MODEL)
    out, state = sc.score_block(rows, dict(sc.FRESH), bad)
    assert (out.failed == ~good.fallback).all() and out.failed.sum() > 30 and not good.failed.any()
    assert (out[[f"w_{m}" for m in ("return", "vol", "regime", "drawdown")]] == 0.25).all().all()
    again, _ = sc.score_block(rows.iloc[:1], state, WEIGHT_MODEL)  # the flag is kept for the first row of the next block
    assert again.failed.tolist() == [True]


def test_regime_steps_equal_the_fold_over_any_cut(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 4))
    x[[0, 17]] = np.nan
    pdf = pd.DataFrame(x, columns=list(rg.INPUTS)).astype(object).where(lambda v: v.notna(), None)
    days = [date(2020, 1, 1) + timedelta(days=i) for i in range(50)]
    df = spark.createDataFrame([("A", d, *r) for d, r in zip(days, pdf.itertuples(index=False))], "symbol string, date date, " + ", ".join(f"{c} double" for c in rg.INPUTS))
    want = frame(rg.filter_probabilities(df, GIVEN))
    assert want.state.isna().sum() == 2
    for cut in (1, 18, 33):
        a, p = rg.filter_step(x[:cut], None, GIVEN)
        b, _ = rg.filter_step(x[cut:], p, GIVEN)
        np.testing.assert_allclose(np.concatenate((a, b)), want[["p0", "p1", "p2"]].astype(float))


def test_audit_slices_replay_merge_and_replace(spark):
    audit = store.WeightAudit(spark, scratch_dir(spark, "audit-slices"))

    def rows(day, w):
        return spark.createDataFrame([(s, date(2020, 1, 1) + timedelta(days=day), w, 0.2, 0.3, 0.4) for s in ("A", "B")], "symbol string, date date, w_return double, w_vol double, w_regime double, w_drawdown double")

    for batch in range(20):
        audit.append(rows(batch, 0.1), "r", batch)
        if batch % 7 == 0:
            audit.append(rows(batch, 0.1), "r", batch)  # delivered again
    assert audit.load("r").count() == 40
    spans = audit.slices("r")
    assert spans[:2] == [(0, 7), (8, 15)] and len(spans) == 6
    audit.append(rows(3, 0.9), "r", 20)  # a later batch corrects an old row
    fixed = audit.load("r").where(F.col("date") == F.lit(date(2020, 1, 4))).collect()
    assert [r.return_w for r in fixed] == [0.9, 0.9] and audit.load("r").count() == 40
    audit.append(rows(0, 0.5), "r", 2)  # long merged: nothing to do
    assert audit.load("r").count() == 40 and audit.slices("r")[0] == (0, 7)
    # what an interrupted merge leaves behind is passed over
    audit._write(rows(5, 7.0).withColumnsRenamed(store.WEIGHT_COLS).withColumns({"run_id": F.lit("r"), "slice": F.lit(5).cast("long")}), "r", 5, 5)
    assert audit.load("r").agg(F.max("return_w")).first()[0] == 0.9
    audit.append(rows(0, 0.5), "other")
    audit.clear("r")
    assert audit.load("r").count() == 0 and audit.load().count() == 2 and audit.runs() == ["other", "r"]


def test_frozen_disagreement_equals_the_window_form(spark, world):
    _, raw, _ = world
    z = en.with_regime_risk(raw)
    want = frame(en.with_disagreement(z, "2020-02-03", "2020-04-01"))
    got = frame(en.apply_disagreement(z, en.fit_disagreement(z, "2020-02-03", "2020-04-01")))
    np.testing.assert_allclose(got.disagreement.astype(float), want.disagreement.astype(float))
    assert got.in_fit.sum() == ((got.date >= date(2020, 2, 3)) & (got.date <= date(2020, 4, 1))).sum()
    lone = en.apply_disagreement(z.withColumn("symbol", F.lit("new")).limit(3), en.fit_disagreement(z, None, None))
    assert [(r.disagreement, r.in_fit) for r in lone.collect()] == [(None, False)] * 3
