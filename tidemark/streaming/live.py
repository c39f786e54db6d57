"""Online loop from features to signals, on typed state in a RocksDB store.

What was fitted on history comes as stored, frozen tables (one row per symbol, joined stream-static) and saved models:
tree models, normaliser, disagreement statistics, regime scaling and regime labels. The stateless half (``predictions``) is the same code on
a table and on a stream. The keyed half steps the regime filter, finishes the ensemble row and scores it; per symbol it
holds a few lists of at most 21 values and three values, whatever the length of the stream.

Rows not newer than a symbol's last one are dropped and counted. Every key with late rows and no fresh one sends a row
without a date, so the counters of a batch are complete; the sink keeps such rows out of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.scalars import MODELS, PRED_COLS
from tidemark.operators import ensemble as en
from tidemark.operators import regime as rg
from tidemark.operators.meta import WeightModel
from tidemark.operators.trees import model_inputs
from tidemark.sources.store import WeightAudit
from tidemark.streaming import scoring as sc

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Predictions that a table brings to the loop; the regime comes out of the filter.
STATELESS = ("return_pred", "vol_pred", "drawdown_risk_prob")
#: States of a symbol: one value each, or a list.
VALUES = {
    "run": "last_date date, late long, seen long, total double, known long, sign double, direction double",
    "weights": ", ".join(f"w_{m} double" for m in MODELS) + ", failed double",
    "regime": "p0 double, p1 double, p2 double",
}
LISTS = {"rets": "value double", "dis": "value double", "pnl": "ret double, regime double", "pairs_return": "x double, y double", "pairs_vol": "x double, y double"}
RUN = ("last_date", "late", "seen", "total", "known", "sign", "direction")
#: The state of a symbol as a table row, for the start from a batch.
INITIAL = f"symbol string, {sc.STATE}, p0 double, p1 double, p2 double"
OUTPUT = sc.OUTPUT + ", regime_label int, p0 double, p1 double, p2 double, disagreement double, late_now int"

_COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]


@dataclass(frozen=True)
class LiveModels:
    """Saved models and frozen tables of one symbol set; every table has one row per symbol."""

    returns: PipelineModel
    drawdown: PipelineModel
    regime: rg.GivenModel
    weights: WeightModel
    scaling: DataFrame
    labels: DataFrame
    normalizer: DataFrame | None = None
    disagreement: DataFrame | None = None


def label_columns(mapping: DataFrame) -> DataFrame:
    """The state-to-label map as one row per symbol: label_0, label_1, label_2."""
    return mapping.groupBy("symbol").agg(*[F.max(F.when(F.col("state") == j, F.col("label"))).alias(f"label_{j}") for j in range(rg.N_STATES)])


def score_or_null(model: PipelineModel, rows: DataFrame, out: str) -> DataFrame:
    """``rows`` with the model's prediction; unknown where an input is unknown (no row is dropped, on a stream either)."""
    inputs = model_inputs(model)
    known = F.lit(True)
    for c in inputs:
        known = known & F.col(c).isNotNull()
    kept = {f"_in_{c}": F.col(c) for c in inputs}
    filled = rows.withColumn("_known", known).withColumns(kept).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in inputs})
    scored = model.transform(filled)
    value = F.col(out) if out in scored.columns else vector_to_array("probability")[1]
    scored = scored.withColumn(out, F.when(F.col("_known"), value))
    return scored.withColumns({c: F.col(f"_in_{c}") for c in inputs}).select(*rows.columns, out)


def predictions(features: DataFrame, models: LiveModels, vol: str = "vol_21d") -> DataFrame:
    """The predictions that need no state, raw, with the scaled regime inputs (``z_*``), on a table or a stream."""
    rows = score_or_null(models.drawdown, score_or_null(models.returns, features, "return_pred"), "drawdown_risk_prob")
    rows = rows.withColumn("vol_pred", F.col(vol)).join(models.scaling, "symbol", "left")
    z = {
        f"z_{c}": ((F.col(f"regime_{c}") - F.col(f"mu_{c}")) / F.when(F.col(f"sd_{c}") > 0, F.col(f"sd_{c}")).otherwise(1.0)) for c in rg.INPUTS
    }
    return rows.withColumns(z).select("symbol", "date", *STATELESS, "ret_bwd", *z)


def batch_predictions(features: DataFrame, models: LiveModels) -> DataFrame:
    """Raw predictions of whole histories with filtered, labelled regimes: what the stream sees row by row."""
    raw = predictions(features, models)
    scaled = raw.select("symbol", "date", *[F.col(f"z_{c}").alias(c) for c in rg.INPUTS])
    states = rg.filter_probabilities(scaled, models.regime).join(models.labels, "symbol", "left")
    label = F.coalesce(*[F.when(F.col("state") == j, F.col(f"label_{j}")) for j in range(rg.N_STATES)])
    return raw.join(states.select("symbol", "date", label.alias("regime_label"), "p0", "p1", "p2"), ["symbol", "date"], "left")


def batch_rows(raw: DataFrame, models: LiveModels) -> DataFrame:
    """Rows of the backtest from raw predictions, by the frozen statistics."""
    return en.apply_disagreement(en.normalize(raw, models.normalizer), models.disagreement)


def _frozen(models: LiveModels) -> DataFrame:
    """Everything per symbol that the keyed half needs, as one narrow table."""
    norm = models.normalizer.select("symbol", *[F.col(f"{n}_{c}") for c in PRED_COLS for n in ("mu", "sd")])
    dis = models.disagreement.select("symbol", *[F.col(f"{n}_{c}").alias(f"d{n}_{c}") for c in PRED_COLS for n in ("_mu", "_sd")])
    return norm.join(dis, "symbol", "full_outer").join(models.labels, "symbol", "full_outer")


def finish_rows(rows: pd.DataFrame, p: np.ndarray | None, model: rg.GivenModel) -> tuple[pd.DataFrame, np.ndarray | None]:
    """Regime, normalised predictions and disagreement of one symbol's date-ordered rows, and the filter's new state."""
    prob, p = rg.filter_step(rows[[f"z_{c}" for c in rg.INPUTS]].to_numpy(dtype=float), p, model)
    known = ~np.isnan(prob).any(axis=1)
    label = rows[[f"label_{j}" for j in range(rg.N_STATES)]].to_numpy(dtype=float)[np.arange(len(rows)), np.where(known, np.nan_to_num(prob).argmax(axis=1), 0)]
    label = np.where(known, label, np.nan)
    risk = np.select([label == 0, label == 2, label == 1], [0.0, 1.0, 2.0], np.nan)
    z = {}
    for c in PRED_COLS:
        x, mu, sd = (risk if c == "regime_pred" else rows[c].to_numpy(dtype=float)), *(rows[f"{n}_{c}"].to_numpy(dtype=float) for n in ("mu", "sd"))
        z[c] = np.where(np.isnan(sd), x, (x - mu) / sd)
    with np.errstate(invalid="ignore"):
        parts = []
        for c in PRED_COLS:
            sd = rows[f"d_sd_{c}"].to_numpy(dtype=float)
            parts.append((z[c] - rows[f"d_mu_{c}"].to_numpy(dtype=float)) / np.where(sd == 0, 1.0, sd))
        dis = np.stack(parts).std(axis=0, ddof=1)
    done = rows[["symbol", "date", "ret_bwd"]].assign(**z, regime_label=label, disagreement=dis, **{f"p{j}": prob[:, j] for j in range(rg.N_STATES)})
    return done, p


def _state_dict(run: tuple | None, lists: dict[str, list], weights: tuple | None) -> dict:
    s = dict(sc.FRESH) | (dict(zip(RUN, run)) if run else {})
    s |= {"rets": [x for (x,) in lists["rets"]], "dis": [x for (x,) in lists["dis"]], "weights": list(weights or [])}
    for name, key in (("pairs_return", "ret"), ("pairs_vol", "vol")):
        s[f"x_{key}"], s[f"y_{key}"] = [x for x, _ in lists[name]], [y for _, y in lists[name]]
    s["pnl_ret"], s["pnl_reg"] = [a for a, _ in lists["pnl"]], [b for _, b in lists["pnl"]]
    return s


class LiveScorer(StatefulProcessor):
    """Keyed half of the loop: one call per symbol and micro-batch."""

    def __init__(self, regime: rg.GivenModel, weights: WeightModel):
        self.models = (regime, weights)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = {k: handle.getValueState(k, v) for k, v in VALUES.items()}
        self.lists = {k: handle.getListState(k, v) for k, v in LISTS.items()}

    def _get(self, name: str) -> tuple | None:
        return tuple(self.values[name].get()) if self.values[name].exists() else None

    def _put(self, s: dict, p: np.ndarray | None) -> None:
        self.values["run"].update(tuple(s[k] for k in RUN))
        if s["weights"]:
            self.values["weights"].update(tuple(s["weights"]))
        if p is not None:
            self.values["regime"].update(tuple(map(float, p)))
        for name, rows in (
            ("rets", [(x,) for x in s["rets"]]),
            ("dis", [(x,) for x in s["dis"]]),
            ("pnl", list(zip(s["pnl_ret"], s["pnl_reg"]))),
            ("pairs_return", list(zip(s["x_ret"], s["y_ret"]))),
            ("pairs_vol", list(zip(s["x_vol"], s["y_vol"]))),
        ):
            self.lists[name].put(rows) if rows else self.lists[name].clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        regime, weights = self.models
        s = _state_dict(self._get("run"), {k: [tuple(r) for r in v.get()] for k, v in self.lists.items()}, self._get("weights"))
        p = self._get("regime")
        block = pd.concat(rows, ignore_index=True)
        block = block.sort_values(["date", "ret_bwd", *STATELESS], kind="stable", na_position="first")
        late = 0
        if s["last_date"] is not None:
            fresh = block["date"] > s["last_date"]
            late = int((~fresh).sum())
            block = block[fresh]
        s["late"] += late
        block = block.drop_duplicates("date", keep="last")
        if block.empty:
            self._put(s, None)
            yield pd.DataFrame({c: [None] for c in _COLUMNS}).assign(symbol=key[0], late=s["late"], late_now=late)
            return
        done, p = finish_rows(block, None if p is None else np.array(p), regime)
        out, s = sc.score_block(done, s, weights)
        self._put(s, p)
        for c in ("regime_label", "p0", "p1", "p2", "disagreement"):
            out[c] = done[c].to_numpy()
        out["regime_label"] = out["regime_label"].astype("Int32")
        out["late_now"] = [late] + [0] * (len(out) - 1)
        yield out[_COLUMNS]

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        p = None if pd.isna(row["p0"]) else np.array([row[f"p{j}"] for j in range(rg.N_STATES)], dtype=float)
        s = dict(sc.FRESH)
        if not pd.isna(row["seen"]):
            s = {k: ([float(x) for x in row[k]] if row[k] is not None else []) if k in sc.ARRAYS else row[k] for k in sc.NAMES}
            s |= {"late": int(s["late"]), "seen": int(s["seen"]), "known": int(s["known"])}
        self._put(s, p)

    def close(self) -> None:
        pass


def live_signals(features: DataFrame, models: LiveModels, initial: DataFrame | None = None) -> DataFrame:
    """Signals of a stream of feature rows (``OUTPUT``); ``initial`` (``INITIAL``) is the state left by a batch."""
    rows = features.where("symbol IS NOT NULL AND date IS NOT NULL")
    keyed = predictions(rows, models).join(_frozen(models), "symbol", "left").groupBy("symbol")
    start = initial.groupBy("symbol") if initial is not None else None
    return keyed.transformWithStateInPandas(LiveScorer(models.regime, models.weights), OUTPUT, "Update", "None", start)


class RegimeFilter(StatefulProcessor):
    """The regime filter alone: three probabilities per symbol, one step a row."""

    def __init__(self, model: rg.GivenModel):
        self.model = model

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.regime = handle.getValueState("regime", VALUES["regime"])
        self.last = handle.getValueState("last", "date date, late long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        block = pd.concat(rows, ignore_index=True).sort_values(["date", *rg.INPUTS], kind="stable", na_position="first").drop_duplicates("date", keep="last")
        date, late = self.last.get() if self.last.exists() else (None, 0)
        if date is not None:
            fresh = block["date"] > date
            late += int((~fresh).sum())
            block = block[fresh]
        if not block.empty:
            date = block["date"].iloc[-1]
        self.last.update((date, late))
        if block.empty:
            return
        prob, p = rg.filter_step(block[list(rg.INPUTS)].to_numpy(dtype=float), np.array(self.regime.get()) if self.regime.exists() else None, self.model)
        if p is not None:
            self.regime.update(tuple(map(float, p)))
        known = ~np.isnan(prob).any(axis=1)
        state = pd.array(np.where(known, np.nan_to_num(prob).argmax(axis=1), 0), "Int32")
        state[~known] = pd.NA
        yield block[["symbol", "date"]].assign(**{f"p{j}": prob[:, j] for j in range(rg.N_STATES)}, state=state)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.regime.update(tuple(float(row[f"p{j}"]) for j in range(rg.N_STATES)))
        self.last.update((row["date"], 0))

    def close(self) -> None:
        pass


def stream_regime(scaled: DataFrame, model: rg.GivenModel, initial: DataFrame | None = None) -> DataFrame:
    """Streaming twin of ``filter_probabilities``; ``initial`` (symbol, date, p0, p1, p2) goes on from a batch."""
    keyed = scaled.where("symbol IS NOT NULL AND date IS NOT NULL").select("symbol", "date", *rg.INPUTS).groupBy("symbol")
    start = initial.groupBy("symbol") if initial is not None else None
    schema = "symbol string, date date, p0 double, p1 double, p2 double, state int"
    return keyed.transformWithStateInPandas(RegimeFilter(model), schema, "Update", "None", start)


def last_regime(probabilities: DataFrame) -> DataFrame:
    """(symbol, date, p0, p1, p2): the last known probabilities of every symbol."""
    p = [f"p{j}" for j in range(rg.N_STATES)]
    return probabilities.where("p0 IS NOT NULL").groupBy("symbol").agg(F.max("date").alias("date"), *[F.max_by(c, "date").alias(c) for c in p])


def state_after(rows: DataFrame, weights: WeightModel) -> DataFrame:
    """``INITIAL`` rows: what the loop holds after backtest rows (``batch_rows``), so that a stream can go on from there."""
    types = T._parse_datatype_string(INITIAL)

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        _, s = sc.score_block(pdf, dict(sc.FRESH), weights)
        known = pdf[pdf["p0"].notna()]
        p = {f"p{j}": [None if known.empty else float(known[f"p{j}"].iloc[-1])] for j in range(rg.N_STATES)}
        return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], **{k: [s[k]] for k in sc.NAMES}, **p})[types.fieldNames()]

    return rows.select(*sc.INPUT, "p0", "p1", "p2").groupBy("symbol").applyInPandas(replay, types)


def regime_start(probabilities: DataFrame) -> DataFrame:
    """``INITIAL`` rows of a run that starts afresh on a regime filter that has seen history."""
    p = last_regime(probabilities).drop("date")
    names = T._parse_datatype_string(INITIAL)
    return p.select(*[F.col(f.name) if f.name in p.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in names])


# --- sink and store -----------------------------------------------------------------


def write_live(signals: DataFrame, path: str, checkpoint: str, audit: WeightAudit | None = None, run_id: str = "live") -> DataStreamWriter:
    """Signals to ``{path}/signals``, their weights to the audit log, the batch's counters to ``{path}/counters``.

    The signals are written once; everything else of a micro-batch is taken from what was written or observed on the way,
    so its state is stepped once. Each part overwrites what the same micro-batch wrote before.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        seen = Observation(f"live-{batch_id}")
        dated = F.col("date").isNotNull()
        counted = batch.observe(
            seen, F.count_if(dated).alias("rows"), F.coalesce(F.sum("late_now"), F.lit(0)).alias("late"),
            F.count_if(dated & F.col("fallback")).alias("fallback"), F.count_if(dated & F.col("failed")).alias("failed"),
        )
        folder = f"{path}/signals/batch_id={batch_id}"
        counted.where(dated).write.mode("overwrite").parquet(folder)
        spark = batch.sparkSession
        row = {k: int(v) for k, v in seen.get.items()}
        spark.createDataFrame([row], "rows long, late long, fallback long, failed long").write.mode("overwrite").parquet(f"{path}/counters/batch_id={batch_id}")
        if audit is not None:
            audit.append(spark.read.schema(batch.schema).parquet(folder), run_id, batch_id)

    return signals.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save)


def stored_value(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """A value state as the store holds it after the last committed batch."""
    return _stored(spark, checkpoint, name).select("key.symbol", "value.*")


def stored_list(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """A list state, one row per entry."""
    return _stored(spark, checkpoint, name).select("key.symbol", "list_element.*")


def _stored(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()


@contextmanager
def rocks_store(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the session's setting comes back after."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


# --- artefacts ------------------------------------------------------------------------


def save_tables(models: LiveModels, store, prefix: str = "live") -> dict[str, int]:
    """The frozen tables as new versions of a feature store; their version numbers."""
    return {k: store.save(getattr(models, k), f"{prefix}-{k}") for k in ("scaling", "labels", "normalizer", "disagreement")}


def load_tables(store, versions: dict[str, int] | None = None, prefix: str = "live") -> dict[str, DataFrame]:
    return {k: store.load(f"{prefix}-{k}", (versions or {}).get(k, "latest")) for k in ("scaling", "labels", "normalizer", "disagreement")}
