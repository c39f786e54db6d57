"""The online loop from features to signals, the streaming regime filter, the audit they write and what their stores hold."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import functions as F

from tidemark.operators import calendar as cal
from tidemark.operators import ensemble as en
from tidemark.operators import price_features as pf
from tidemark.operators import regime as rg
from tidemark.operators import splits as sp
from tidemark.operators import trees as tr
from tidemark.plans import inputs as src
from tidemark.plans import oracle_meta as om
from tidemark.plans import queries_models as qm
from tidemark.plans import queries_streaming as qs
from tidemark.plans.oracle_base import W
from tidemark.plans.registry import cte, register, twin
from tidemark.plans.stage import stage, write_once
from tidemark.session import scratch_dir
from tidemark.sources import store
from tidemark.streaming import live as lv
from tidemark.streaming import sink

RUN = "live-1"
# Models with given coefficients, as saved pipelines: the loop takes whatever pipeline was saved, the oracle repeats these.
GIVEN_RETURN = "0.4 * logret + 0.1 * mom_21d"
GIVEN_DRAWDOWN = "1 / (1 + exp(mom_21d - 2 * bb_width))"

cte("live_preds", f"""
SELECT p.symbol, p.date, close, r AS ret_bwd, {GIVEN_RETURN} AS return_pred, vol_21d AS vol_pred, label AS regime_label, {GIVEN_DRAWDOWN} AS drawdown_risk_prob
FROM panel_ret p JOIN feat USING (symbol, date) LEFT JOIN given_states s ON s.symbol = p.symbol AND s.date = p.date
LEFT JOIN given_labels l ON l.symbol = s.symbol AND l.state = s.state""")


_IC = ["ic_live_in", "ic_live_pairs", "ic_live_rank", "ic_live_long", "ic_live"]
twin("live_", "preds", ["preds_risk", "norm", "preds_z", "dis_fit", "preds_d", "run_rows", "run_past", *_IC, "track_live", "meta_live", "weights_live", "bt_weights", "bt"])


def _pipeline(inputs: list[str], name: str, rule: str) -> PipelineModel:
    return PipelineModel([VectorAssembler(inputCols=inputs, outputCol="features"), SQLTransformer(statement=f"SELECT *, {rule} AS {name} FROM __THIS__")])


@stage
def features(spark, sf):
    """Rows the loop is fed with: price features, raw regime inputs and the realised return."""
    r = src.returns(spark, sf)
    f = pf.price_features(src.panel(spark, sf), rsi=False).select("symbol", "date", "logret", "mom_21d", "vol_21d", "bb_width")
    regime = rg.regime_inputs(src.panel(spark, sf), cal.macro_wide(src.macro_long(spark, sf)))
    regime = regime.select("symbol", "date", *[F.col(c).alias(f"regime_{c}") for c in rg.INPUTS])
    rows = r.select("symbol", "date", "ret_bwd").join(f, ["symbol", "date"])
    return rows.join(regime, ["symbol", "date"], "left")


def _models(spark, sf):
    """Saved and loaded again: pipelines, and the tables fitted on history. Also the raw batch predictions."""
    root = scratch_dir(spark, "live-models")
    given = {"returns": _pipeline(["logret", "mom_21d"], "return_pred", GIVEN_RETURN), "drawdown": _pipeline(["mom_21d", "bb_width"], "drawdown_risk_prob", GIVEN_DRAWDOWN)}
    for name, model in given.items():
        tr.save_model(model, f"{root}/{name}")
    loaded = {name: tr.load_model(f"{root}/{name}") for name in given}
    rows = features(spark, sf)
    scaled_in = rows.select("symbol", "date", *[F.col(f"regime_{c}").alias(c) for c in rg.INPUTS])
    scaling = write_once(rg.scale_stats(scaled_in, src.TRAIN_END), "live-scaling")
    states = rg.filter_given(rg.scale_by(scaled_in, scaling), qm.GIVEN).where("state IS NOT NULL")
    vix = cal.macro_wide(src.macro_long(spark, sf)).select("date", F.col("VIXCLS").alias("vix"))
    labels = write_once(lv.label_columns(rg.label_map(states, vix, train_end=src.TRAIN_END)), "live-labels")
    models = lv.LiveModels(**loaded, regime=qm.GIVEN, weights=src.WEIGHT_MODEL, scaling=scaling, labels=labels)
    raw = write_once(lv.batch_predictions(rows, models), "live-raw")
    normalizer = en.fit_normalizer(raw, src.TRAIN_END)
    disagreement = en.fit_disagreement(en.normalize(raw, normalizer), src.VAL_START, src.VAL_END)
    models = lv.LiveModels(**loaded, regime=qm.GIVEN, weights=src.WEIGHT_MODEL, scaling=scaling, labels=labels, normalizer=normalizer, disagreement=disagreement)
    tables = store.FeatureStore(spark, f"{root}/tables")
    versions = lv.save_tables(models, tables)
    return lv.LiveModels(**loaded, regime=qm.GIVEN, weights=src.WEIGHT_MODEL, **lv.load_tables(tables, versions)), raw


def _val(df):
    return sp.split_rows(df, "val", src.TRAIN_END, src.VAL_END)


def _deliver(spark, sf, halves_from: int = 0):
    """The run's dates in two deliveries and a third with the first LATE_DATES dates once more, each read by a restarted query.

    From ``halves_from`` = 1 on, the first delivery isn't streamed: the loop starts from the state that a batch left.
    """
    models, raw = _models(spark, sf)
    out = scratch_dir(spark, "live")
    rows = _val(features(spark, sf))
    rows = write_once(rows.join(qs._places(rows), "date"), "live-rows")
    last = rows.agg(F.max("_nth")).first()[0] or 0
    half = F.floor((F.col("_nth") - 1) * 2 / max(1, last))
    if halves_from:
        done = lv.batch_rows(_val(raw), models).join(rows.where(half < halves_from).select("symbol", "date"), ["symbol", "date"], "left_semi")
        initial = write_once(lv.state_after(done, models.weights), "live-start")
    else:
        initial = write_once(lv.regime_start(raw.where(F.col("date") <= F.lit(src.TRAIN_END).cast("date"))), "live-start")
    audit = store.WeightAudit(spark, f"{out}/audit")
    plain = rows.drop("_nth")
    with lv.rocks_store(spark):
        for part in range(halves_from, 3):
            chosen = half == part if part < 2 else F.col("_nth") <= qs.LATE_DATES
            rows.where(chosen).select(plain.columns).write.mode("append").parquet(f"{out}/inbox")
            stream = spark.readStream.schema(plain.schema).parquet(f"{out}/inbox")
            sink.run_available(lv.write_live(lv.live_signals(stream, models, initial), out, f"{out}/checkpoint", audit, RUN))
    return out, audit


_HALF = "2 * (dense_rank() OVER (ORDER BY date) - 1) // (SELECT count(DISTINCT date) FROM live_run_rows)"
_FALLBACK = f"(SELECT symbol, date, count(w_return) OVER {om.BEFORE} = 0 AS fallback FROM live_weights_live)"


@register("stream_live", "symbol date signal:9 w_return:9 w_vol:9 w_regime:9 w_drawdown:9 fallback failed", f"""
SELECT b.*, fallback, false AS failed FROM live_bt b JOIN {_FALLBACK} USING (symbol, date)""")
def stream_live(spark, sf):
    """Features in, signals out: models, normaliser, disagreement and regimes are applied inside the stream."""
    out, _ = _deliver(spark, sf)
    return spark.read.parquet(f"{out}/signals").withColumn("signal", F.when(~F.isnan("signal"), F.col("signal")))


@register("stream_resume", "symbol date signal:9 w_return:9 w_vol:9 w_regime:9 w_drawdown:9", f"""
SELECT b.* FROM live_bt b JOIN (SELECT symbol, date, {_HALF} AS half FROM live_run_rows) USING (symbol, date) WHERE half = 1""")
def stream_resume(spark, sf):
    """The second half streamed on the state that a batch over the first half left."""
    out, _ = _deliver(spark, sf, halves_from=1)
    return spark.read.parquet(f"{out}/signals").withColumn("signal", F.when(~F.isnan("signal"), F.col("signal")))


@register("stream_store", "symbol last_date seen:b late:b pairs:b returns:b p_total:9", f"""
SELECT symbol, max(date) AS last_date, count(*) AS seen, {qs.LATE_DATES} AS late, least(count(return_pred), 21) AS pairs, 5 AS returns, 1.0 AS p_total
FROM live_run_rows GROUP BY symbol""")
def stream_store(spark, sf):
    """What the RocksDB store holds per symbol after the last delivery, by the state data source."""
    out, _ = _deliver(spark, sf)
    at = f"{out}/checkpoint"
    count = lambda name, to: lv.stored_list(spark, at, name).groupBy("symbol").agg(F.count(F.lit(1)).alias(to))
    held = lv.stored_value(spark, at, "run").select("symbol", "last_date", "seen", "late")
    regime = lv.stored_value(spark, at, "regime").select("symbol", (F.col("p0") + F.col("p1") + F.col("p2")).alias("p_total"))
    return held.join(count("pairs_return", "pairs"), "symbol", "left").join(count("rets", "returns"), "symbol", "left").join(regime, "symbol", "left")


@register("stream_audit", "run_id symbol date return_w:9 vol_w:9 regime_w:9 drawdown_w:9", f"""
SELECT '{RUN}' AS run_id, symbol, date, w_return AS return_w, w_vol AS vol_w, w_regime AS regime_w, w_drawdown AS drawdown_w FROM live_bt""")
def stream_audit(spark, sf):
    """The weights that the loop wrote to the audit log, micro-batch by micro-batch."""
    return _deliver(spark, sf)[1].load(RUN)


@register("stream_counters", "batch_id:i rows:b late:b fallback:b failed:b", f"""
SELECT half AS batch_id, count(*) AS rows, 0 AS late, count(*) FILTER (fallback) AS fallback, 0 AS failed
FROM (SELECT symbol, date, {_HALF} AS half FROM live_run_rows) JOIN {_FALLBACK} USING (symbol, date) GROUP BY half
UNION ALL SELECT 2, 0, count(*), 0, 0 FROM (SELECT dense_rank() OVER (ORDER BY date) AS nth FROM live_run_rows) WHERE nth <= {qs.LATE_DATES}""")
def stream_counters(spark, sf):
    """Rows, late rows, fallbacks and failed scores of every micro-batch, the last of which holds nothing but late rows."""
    out, _ = _deliver(spark, sf)
    return spark.read.parquet(f"{out}/counters")


cte("given_steps", "SELECT symbol, date, p0, p1, p2 FROM given_filter JOIN given_dens USING (symbol, t)")


@register("stream_regime", "symbol date state:i p0:9 p1:9 p2:9", "SELECT * FROM given_steps JOIN given_states USING (symbol, date)")
def stream_regime(spark, sf):
    """The regime filter row by row in three deliveries, the last of which repeats the first dates."""
    out = scratch_dir(spark, "stream-regime")
    rows = qm._scaled(spark, sf)
    rows = write_once(rows.join(qs._places(rows), "date"), "regime-rows")
    last = rows.agg(F.max("_nth")).first()[0] or 0
    plain = rows.select("symbol", "date", *rg.INPUTS)
    with lv.rocks_store(spark):
        for part in range(3):
            again = (F.col("_nth") <= qs.LATE_DATES) if part == 2 else F.lit(False)
            rows.where((F.floor((F.col("_nth") - 1) * 3 / max(1, last)) == part) | again).select(plain.columns).write.mode("append").parquet(f"{out}/inbox")
            stream = spark.readStream.schema(plain.schema).parquet(f"{out}/inbox")
            sink.run_available(sink.write_batches(lv.stream_regime(stream, qm.GIVEN), f"{out}/table", f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/table")


# --- frozen statistics ------------------------------------------------------------------


@register("normalizer_frozen", "symbol date return_pred:9 vol_pred:9 regime_pred:9 drawdown_risk_prob:9", f"SELECT * FROM preds_z WHERE date > DATE '{src.VAL_END}'")
def normalizer_frozen(spark, sf):
    """Statistics fitted on the train period, stored under a version, and applied to rows they have not seen."""
    p = src.preds(spark, sf)
    tables = store.FeatureStore(spark, scratch_dir(spark, "normalizer"))
    version = tables.save(en.fit_normalizer(p, src.TRAIN_END), "normalizer")
    return en.normalize(p.where(F.col("date") > F.lit(src.VAL_END).cast("date")), tables.load("normalizer", version))


@register("disagreement_frozen", "symbol date disagreement:9 in_fit", f"SELECT symbol, date, disagreement, {om.VAL} AS in_fit FROM preds_d WHERE date >= DATE '{src.VAL_START}'")
def disagreement_frozen(spark, sf):
    """Fitted on the validation rows, stored, and applied to these (flagged: they look ahead) and to later rows."""
    z = src.preds_z(spark, sf)
    tables = store.FeatureStore(spark, scratch_dir(spark, "disagreement"))
    version = tables.save(en.fit_disagreement(z, src.VAL_START, src.VAL_END), "disagreement")
    return en.apply_disagreement(z.where(F.col("date") >= F.lit(src.VAL_START).cast("date")), tables.load("disagreement", version))


@register("vol_reference", "symbol vol_reference_to rows_after_train:b", f"""
SELECT symbol, max(date) AS vol_reference_to, count(*) FILTER (date > DATE '{src.TRAIN_END}') AS rows_after_train
FROM (SELECT *, count(vol_pred) OVER ({W}) AS k FROM preds) WHERE k <= 252 AND vol_pred IS NOT NULL GROUP BY symbol""")
def vol_reference(spark, sf):
    """Up to which date the volatility's normaliser reads, and how many of its rows lie after the train period."""
    return en.vol_reference(src.preds(spark, sf), src.TRAIN_END)
