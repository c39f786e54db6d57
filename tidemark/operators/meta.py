"""Rolling track-record features, their training target, and the weights built from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.arrays import rank_correlation
from tidemark.functions.scalars import MODELS, PRED_COLS, WEIGHT_FLOOR, regime_direction, softmax_floor
from tidemark.functions.windows import UNBOUNDED, forward, ordered, rolling
from tidemark.operators import splits
from tidemark.operators.targets import causal_target

WINDOW = 21
META_FEATURES = ("rolling_ic_return", "rolling_ic_vol", "rolling_pnl_return", "rolling_pnl_regime", "rolling_disagreement")
META_ALL = (*META_FEATURES, "rolling_regime_accuracy")
IC_JOBS = (("rolling_ic_return", "return_pred", "tgt_ret_1d"), ("rolling_ic_vol", "vol_pred", "tgt_vol_5d"))


Job = tuple[str, str, str]


def with_rank_ics(df: DataFrame, jobs: list[tuple[str, str, str, WindowSpec]], n: int) -> DataFrame:
    """Spearman correlation over a row frame for each (output, x, y, frame).

    A result is NULL unless all ``n`` pairs of the frame are known.
    """
    pairs = {}
    for out, x, y, frame in jobs:
        known = F.col(x).isNotNull() & F.col(y).isNotNull()
        pairs[f"_x_{out}"] = F.collect_list(F.when(known, F.col(x).cast("double"))).over(frame)
        pairs[f"_y_{out}"] = F.collect_list(F.when(known, F.col(y).cast("double"))).over(frame)
    corr = rank_correlation(n)
    return df.withColumns(pairs).withColumns({out: corr(f"_x_{out}", f"_y_{out}") for out, *_ in jobs}).drop(*pairs)


def with_rolling_ic(df: DataFrame, jobs: tuple[Job, ...], has: Column, n: int = WINDOW) -> DataFrame:
    """Information coefficient of each (output, prediction, past target) over rows [t-n, t-1].

    A row takes part for a model when its prediction is known and ``has`` holds,
    so each model counts its own rows. The flag only subdivides the symbol's
    partition: one shuffle serves all models.
    """
    flags = {f"_in_{out}": has & F.col(pred).isNotNull() for out, pred, _ in jobs}
    framed = [(out, pred, past, ordered("symbol", f"_in_{out}").rowsBetween(-n, -1)) for out, pred, past in jobs]
    df = with_rank_ics(df.withColumns(flags), framed, n)
    return df.withColumns({out: F.when(F.col(f"_in_{out}"), F.col(out)) for out, *_ in jobs}).drop(*flags)


def attach_targets(preds: DataFrame, targets: DataFrame) -> DataFrame:
    """Predictions with the target columns of their date and the ``has_target`` flag.

    Where targets come from the same panel, ``forward_targets(..., carry=..., mark="has_target")``
    yields this table without a join.
    """
    cols = ["tgt_ret_1d", "tgt_vol_5d"]
    return preds.join(targets.select("symbol", "date", *cols, F.lit(True).alias("has_target")), ["symbol", "date"], "left")


def with_ic(df: DataFrame, n: int = WINDOW) -> DataFrame:
    """IC of the return and volatility predictions against targets that are past by then."""
    w = ordered("symbol", "_has")
    has = F.coalesce("has_target", F.lit(False))
    df = df.withColumn("_has", has).withColumns({f"_{t}": F.when(F.col("_has"), causal_target(t, w)) for _, _, t in IC_JOBS})
    jobs = tuple((out, pred, f"_{t}") for out, pred, t in IC_JOBS)
    return with_rolling_ic(df, jobs, F.col("_has"), n).drop("_has", *[j[2] for j in jobs])


def rolling_ic(preds: DataFrame, targets: DataFrame, n: int = WINDOW) -> DataFrame:
    return with_ic(attach_targets(preds, targets), n).select("symbol", "date", *[out for out, _, _ in IC_JOBS])


def centred_sign(w: WindowSpec, pred: str = "return_pred") -> Column:
    """Sign of a prediction against its own expanding (causal) mean."""
    return F.signum(F.col(pred) - F.avg(pred).over(w.rowsBetween(UNBOUNDED, 0)))


def rolling_pnl(df: DataFrame, ret: str = "ret_bwd", n: int = WINDOW) -> DataFrame:
    """Adds the rolling PnL of following the return model and the regime label."""
    w = ordered("symbol")
    df = df.withColumns({"_s_ret": centred_sign(w), "_s_reg": regime_direction(F.col("regime_label"))})
    df = df.withColumns({"_p_ret": F.lag("_s_ret").over(w) * F.col(ret), "_p_reg": F.lag("_s_reg").over(w) * F.col(ret)})
    return df.withColumns(
        {
            "rolling_pnl_return": rolling(F.sum, F.col("_p_ret"), n, w),
            "rolling_pnl_regime": rolling(F.sum, F.col("_p_reg"), n, w),
        }
    ).drop("_s_ret", "_s_reg", "_p_ret", "_p_reg")


def rolling_disagreement(df: DataFrame, n: int = WINDOW) -> DataFrame:
    return df.withColumn("rolling_disagreement", rolling(F.avg, F.col("disagreement"), n, ordered("symbol")))


def regime_hit_rate(df: DataFrame, ret: str = "ret_bwd", n: int = WINDOW) -> DataFrame:
    """Share of directional regime calls that matched the sign of the next return."""
    w = ordered("symbol")
    call = F.lag(regime_direction(F.col("regime_label"))).over(w)
    df = df.withColumn("_call", call)
    hit = F.when((F.col("_call") != 0) & F.col(ret).isNotNull(), (F.col("_call") == F.signum(F.col(ret))).cast("double"))
    df = df.withColumn("_hit", hit)
    return df.withColumn("rolling_regime_accuracy", rolling(F.avg, F.col("_hit"), n, w, min_count=n // 2)).drop("_call", "_hit")


def with_meta_features(df: DataFrame, n: int = WINDOW) -> DataFrame:
    """Appends all track-record features; one hash partitioning by symbol serves every window.

    ``df`` carries the four predictions, the raw ``regime_label``, ``disagreement``,
    the realised return ``ret_bwd``, and target columns as ``attach_targets`` gives them.
    """
    return with_ic(regime_hit_rate(rolling_disagreement(rolling_pnl(df, n=n), n=n), n=n), n)


def meta_features(preds: DataFrame, targets: DataFrame, returns: DataFrame, n: int = WINDOW) -> DataFrame:
    """Track-record features from three separate tables."""
    df = preds.drop("ret_bwd").join(returns.select("symbol", "date", "ret_bwd"), ["symbol", "date"], "left")
    return with_meta_features(attach_targets(df, targets), n).select("symbol", "date", *META_ALL)


def live_features(df: DataFrame, n: int = WINDOW) -> DataFrame:
    """Track record as the online loop sees it: from the run's own predictions and realised returns.

    ``df`` holds the run's rows with predictions, ``regime_label``,
    ``disagreement`` and ``ret_bwd``. The targets are rebuilt from returns already
    realised, so nothing needs a target table and every window shares one shuffle.
    """
    w = ordered("symbol")
    df = df.withColumns(
        {
            "_past_ret": F.lag("ret_bwd").over(w),
            "_past_vol": F.when(
                F.count("ret_bwd").over(w.rowsBetween(-5, -1)) == 5, F.stddev_samp("ret_bwd").over(w.rowsBetween(-5, -1))
            ),
        }
    )
    df = rolling_disagreement(rolling_pnl(df, n=n), n=n)
    jobs = (("rolling_ic_return", "return_pred", "_past_ret"), ("rolling_ic_vol", "vol_pred", "_past_vol"))
    return with_rolling_ic(df, jobs, F.lit(True), n).drop("_past_ret", "_past_vol")


def proxy_target(
    preds: DataFrame, targets: DataFrame | None = None, n: int = WINDOW, zscore: bool = True, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Mean realised PnL of each model's signal over the next ``n`` rows, z-scored per symbol.

    Needs ``n`` rows ahead and at least a quarter of them with both values; rows
    with any unknown score are dropped. Without ``targets``, ``preds`` carries
    ``tgt_ret_1d`` itself. ``carry`` names further columns to keep.
    """
    w = ordered("symbol")
    need = max(5, n // 4)
    df = preds if targets is None else attach_targets(preds, targets)
    sign = {"return": 1.0, "vol": -1.0, "regime": -1.0, "drawdown": -1.0}
    cols = dict(zip(MODELS, PRED_COLS))
    df = df.withColumns({f"_p_{m}": F.lit(sign[m]) * F.col(cols[m]) * F.col("tgt_ret_1d") for m in MODELS})
    ahead = F.count(F.lit(1)).over(w.rowsBetween(1, n))
    df = df.withColumns({f"y_{m}": F.when(ahead == n, forward(F.avg, F.col(f"_p_{m}"), n, w, need)) for m in MODELS})
    ys = [f"y_{m}" for m in MODELS]
    df = df.select("symbol", "date", *carry, *ys).na.drop(subset=ys)
    return zscore_columns(df, ys) if zscore else df


def zscore_columns(df: DataFrame, cols: list[str], on: Column | None = None) -> DataFrame:
    """Sample z-score per symbol; a column without spread stays as it is."""
    w = Window.partitionBy("symbol")
    out = {}
    for c in cols:
        x = F.col(c) if on is None else F.when(on, F.col(c))
        mean, sd = F.avg(x).over(w), F.stddev_samp(x).over(w)
        out[c] = F.when(sd > 0, (F.col(c) - mean) / sd).otherwise(F.col(c))
    return df.withColumns(out)


def meta_prepare(table: DataFrame, train_end: str, val_end: str, zscore: str = "all", share: float = 0.7) -> DataFrame:
    """Training table of the weight learner on the validation period.

    ``table`` holds predictions, meta-features and ``tgt_ret_1d``. It is cut to
    the period first, so no forward window leaves it; complete rows are then
    tagged train / eval. ``zscore`` takes the target's statistics from all rows
    or from the train rows only.
    """
    val = splits.split_rows(table, "val", train_end, val_end)
    y = proxy_target(val, zscore=zscore == "all", carry=META_FEATURES)
    rows = splits.chrono_split(y.na.drop(), share)
    if zscore == "train":
        rows = zscore_columns(rows, [f"y_{m}" for m in MODELS], F.col("part") == "train")
    return rows


@dataclass(frozen=True)
class WeightModel:
    """Linear scores of standardised features, one row of coefficients per base model.

    A saturated model scores 0, so only the softmax of the others moves its weight.
    """

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    coef: dict[str, tuple[float, ...]]
    intercept: dict[str, float]
    saturated: frozenset[str] = frozenset()
    features: tuple[str, ...] = META_FEATURES
    floor: float = WEIGHT_FLOOR


def model_scores(m: WeightModel) -> dict[str, Column]:
    z = [(F.col(f) - F.lit(mu)) / F.lit(sd) for f, mu, sd in zip(m.features, m.mean, m.scale)]
    out = {}
    for name in MODELS:
        score = F.lit(m.intercept[name])
        for zi, ci in zip(z, m.coef[name]):
            score = score + F.lit(ci) * zi
        out[name] = F.lit(0.0) if name in m.saturated else score
    return out


def with_weights(df: DataFrame, model: WeightModel) -> DataFrame:
    """Weight columns from one model shared by all symbols; NULL where a feature is unknown."""
    scores = model_scores(model)
    complete = F.lit(True)
    for f in model.features:
        complete = complete & F.col(f).isNotNull()
    df = df.withColumns({f"_s_{m}": scores[m] for m in MODELS})
    weights = softmax_floor([F.col(f"_s_{m}") for m in MODELS], model.floor)
    return df.withColumns({f"w_{m}": F.when(complete, w) for m, w in zip(MODELS, weights)}).drop(*[f"_s_{m}" for m in MODELS])


def predict_weights(meta: DataFrame, model: WeightModel) -> DataFrame:
    """Weights of every complete meta row."""
    return with_weights(meta.na.drop(subset=list(model.features)), model)


def predict_weights_by_symbol(meta: DataFrame, models: DataFrame, floor: float = WEIGHT_FLOOR) -> DataFrame:
    """Weights from per-symbol fits (see ``ridge.fit_ridge``), joined on the symbol.

    A symbol without a fit, or with too short a history for one, keeps its rows with equal weights and ``fitted`` false.
    """
    rows = meta.na.drop(subset=list(META_FEATURES)).join(models, "symbol", "left")
    rows = rows.withColumn("fitted", F.coalesce("fitted", F.lit(False)))
    z = F.array(*[(F.col(f) - F.col("mean")[i]) / F.col("scale")[i] for i, f in enumerate(META_FEATURES)])
    rows = rows.withColumn("_z", z)
    for m in MODELS:
        linear = F.aggregate(F.zip_with("_z", F.col(f"coef_{m}"), lambda a, b: a * b), F.col(f"intercept_{m}"), lambda s, v: s + v)
        rows = rows.withColumn(f"_s_{m}", F.when(F.col(f"saturated_{m}") | ~F.col("fitted"), F.lit(0.0)).otherwise(linear))
    weights = softmax_floor([F.col(f"_s_{m}") for m in MODELS], floor)
    out = rows.withColumns({f"w_{m}": w for m, w in zip(MODELS, weights)})
    return out.select(*meta.columns, *[f"w_{m}" for m in MODELS], "fitted")

