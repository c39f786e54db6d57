"""Diagnostics and acceptance gates over result tables, reported per symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import MODELS, PRED_COLS, row_std, softmax_floor
from tidemark.functions.windows import ordered
from tidemark.operators.calendar import crisis_rows, in_any_crisis
from tidemark.operators.meta import WINDOW, WeightModel, model_scores, with_rank_ics


def long_columns(df: DataFrame, cols: list[str], keys: list[str], name: str = "feature") -> DataFrame:
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(keys, cols, name, "x")


def graded(value: Column, fail: Column, warn: Column) -> Column:
    return F.when(fail, "FAIL").when(warn, "WARN").when(value.isNotNull(), "PASS")


def scale_share(preds: DataFrame) -> DataFrame:
    """Scale of each prediction and its share of the equally weighted signal magnitude."""
    x = F.col("x")
    stats = long_columns(preds, list(PRED_COLS), ["symbol"], "pred").groupBy("symbol", "pred").agg(
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.avg(F.abs(x)).alias("abs_mean"), F.max(F.abs(x)).alias("abs_max")
    )
    w = Window.partitionBy("symbol")
    stats = stats.withColumn("share", F.try_divide("abs_mean", F.sum("abs_mean").over(w)))
    top = F.max("share").over(w)
    return stats.withColumn("verdict", graded(F.col("share"), top > 0.50, top > 0.35))


def feature_variation(df: DataFrame, cols: list[str]) -> DataFrame:
    """Spread of each feature; near-constant ones give a learner nothing to condition on."""
    x = F.col("x")
    stats = long_columns(df, cols, ["symbol"]).groupBy("symbol", "feature").agg(
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("sd"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        (F.percentile(x, F.lit(0.75)) - F.percentile(x, F.lit(0.25))).alias("iqr"),
        F.avg(F.abs(x)).alias("_abs"),
    )
    cv = F.try_divide(F.col("sd"), F.col("_abs"))
    return stats.withColumns({"cv": cv, "zero_variance": F.col("sd") < 1e-6, "low_signal": (cv > 0) & (cv < 0.10)}).drop("_abs")


def alpha_positions(fits: DataFrame, alphas: tuple[float, ...]) -> DataFrame:
    """Where each fitted penalty sits in its grid, per symbol and model."""
    cells = [F.struct(F.lit(m).alias("model"), F.col(f"alpha_{m}").alias("alpha")) for m in MODELS]
    place = F.when(F.col("alpha").isNull(), "unfitted").when(F.col("alpha") >= max(alphas), "MAX").when(F.col("alpha") <= min(alphas), "min").otherwise("interior")
    long = fits.select("symbol", F.inline(F.array(*cells))).withColumn("position", place)
    n_max = F.count_if(F.col("position") == "MAX").over(Window.partitionBy("symbol"))
    return long.withColumn("verdict", F.when(n_max >= 3, "FAIL").when(n_max >= 1, "WARN").otherwise("PASS"))


def softmax_dispersion(meta: DataFrame, model: WeightModel) -> DataFrame:
    """Spread of the un-floored softmax weights: across models per row, and per model over time."""
    scores = model_scores(model)
    df = meta.na.drop(subset=list(model.features)).withColumns({f"_s_{m}": scores[m] for m in MODELS})
    w = softmax_floor([F.col(f"_s_{m}") for m in MODELS], 0.0)
    df = df.withColumns({f"_w_{m}": c for m, c in zip(MODELS, w)})
    df = df.withColumn("_row", row_std([F.col(f"_w_{m}") for m in MODELS], ddof=0))
    return df.groupBy("symbol").agg(
        F.avg("_row").alias("row_std_mean"),
        F.max("_row").alias("row_std_max"),
        F.min("_row").alias("row_std_min"),
        *[F.stddev_pop(f"_w_{m}").alias(f"std_{m}") for m in MODELS],
    )


def forward_ic(preds: DataFrame, ret: str = "tgt_ret_1d", n: int = WINDOW) -> DataFrame:
    """Rank correlation of each prediction with returns over the next ``n`` rows, and the best model."""
    frame = ordered("symbol").rowsBetween(1, n)
    df = with_rank_ics(preds, [(f"ic_{c}", c, ret, frame) for c in PRED_COLS], n)
    ics = [F.col(f"ic_{c}") for c in PRED_COLS]
    best = F.greatest(*ics)
    winner = F.lit(None).cast("string")
    for c, ic in reversed(list(zip(PRED_COLS, ics))):
        winner = F.when(ic == best, F.lit(c)).otherwise(winner)
    return df.withColumn("winner", winner)


def ic_winner(preds: DataFrame, ret: str = "tgt_ret_1d", n: int = WINDOW) -> DataFrame:
    """Share of dates each model wins, and its mean forward rank correlation."""
    df = forward_ic(preds, ret, n)
    means = long_columns(df, [f"ic_{c}" for c in PRED_COLS], ["symbol"], "model").groupBy("symbol", "model").agg(F.avg("x").alias("mean_ic"))
    wins = df.where("winner is not null").groupBy("symbol", F.concat(F.lit("ic_"), "winner").alias("model")).agg(F.count("*").alias("wins"))
    out = means.join(wins, ["symbol", "model"], "left").withColumn("wins", F.coalesce("wins", F.lit(0)))
    return out.withColumn("share", F.try_divide(F.col("wins"), F.sum("wins").over(Window.partitionBy("symbol"))))


def label_distribution(df: DataFrame, label: str = "regime_label") -> DataFrame:
    """Days and percentage per label; a label under 5% of days fails, under 10% warns."""
    counts = df.where(F.col(label).isNotNull()).groupBy("symbol", label).agg(F.count("*").alias("n"))
    w = Window.partitionBy("symbol")
    counts = counts.withColumn("pct", F.col("n") / F.sum("n").over(w) * 100)
    worst = F.min("pct").over(w)
    return counts.withColumn("verdict", graded(F.col("pct"), worst < 5, worst < 10))


def crisis_labels(df: DataFrame, crises: list[tuple[str, str, str]], label: str = "regime_label") -> DataFrame:
    counts = crisis_rows(df.where(F.col(label).isNotNull()), crises).groupBy("symbol", "crisis", label).agg(F.count("*").alias("n"))
    w = Window.partitionBy("symbol", "crisis")
    counts = counts.withColumn("pct", F.col("n") / F.sum("n").over(w) * 100)
    top = F.max_by(label, F.struct("n", -F.col(label))).over(w)
    bear = F.coalesce(F.max(F.when(F.col(label) == 1, F.col("pct"))).over(w), F.lit(0.0))
    verdict = F.when((top == 1) & (bear >= 50), "PASS").when(top == 1, "WARN").otherwise("FAIL")
    return counts.withColumn("verdict", verdict)


def persistence_gate(runs: DataFrame, transitions: DataFrame, label: str = "label") -> DataFrame:
    """Average run length and stay probability of each label against their thresholds.

    A label that is always left stays with probability 0; one without a row after it has no probability and no verdict.
    """
    stayed = F.max(F.when(F.col("src") == F.col("dst"), F.col("p")))
    stay = transitions.groupBy("symbol", F.col("src").alias(label)).agg(F.coalesce(stayed, F.lit(0.0)).alias("p_stay"))
    df = runs.join(stay, ["symbol", label], "left")
    run, p = F.col("avg_run"), F.col("p_stay")
    return df.withColumns({"run_verdict": graded(run, run < 5, run < 30), "stay_verdict": graded(p, p < 0.70, p < 0.85)})


def crisis_signal(preds: DataFrame, crises: list[tuple[str, str, str]]) -> DataFrame:
    """Behaviour of the predictions inside each crisis against the whole history."""
    base = preds.groupBy("symbol").agg(
        F.avg("drawdown_risk_prob").alias("dd_base"), F.avg("vol_pred").alias("vol_base"), F.avg("disagreement").alias("dis_base")
    )
    inside = crisis_rows(preds, crises).groupBy("symbol", "crisis").agg(
        F.count("*").alias("n"),
        (F.avg(F.coalesce((F.col("return_pred") < 0).cast("double"), F.lit(0.0))) * 100).alias("pct_negative"),
        (F.avg(F.coalesce((F.col("regime_label") == 1).cast("double"), F.lit(0.0))) * 100).alias("pct_bear"),
        F.avg("drawdown_risk_prob").alias("dd_mean"),
        F.avg("vol_pred").alias("vol_mean"),
        F.avg("disagreement").alias("dis_mean"),
    )
    return inside.join(base, "symbol").withColumns(
        {
            "neg_ok": F.col("pct_negative") >= 40,
            "bear_ok": F.col("pct_bear") >= 33,
            "dd_ok": F.col("dd_mean") > F.col("dd_base"),
            "vol_ok": F.col("vol_mean") > F.col("vol_base"),
        }
    )


def distribution_profile(df: DataFrame, col: str) -> DataFrame:
    """Moments, quantiles and extremes of a column (values taken at 9 decimals)."""
    x = F.round(F.col(col), 9)
    return df.where(x.isNotNull()).groupBy("symbol").agg(
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("sd"),
        F.min(x).alias("min"),
        F.percentile(x, F.lit(0.10)).alias("p10"),
        F.percentile(x, F.lit(0.5)).alias("p50"),
        F.percentile(x, F.lit(0.90)).alias("p90"),
        F.max(x).alias("max"),
        F.countDistinct(F.round(x, 6)).alias("n_unique"),
        F.avg((F.abs(x) > 0.5).cast("double")).alias("share_extreme"),
    )


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise-complete correlations: all pairs of columns in one aggregation pass; NULL where one has no spread."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]

    def both(a: str, b: str) -> Column:
        x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
        spread = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
        return F.when(spread, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))

    wide = df.groupBy("symbol").agg(*[both(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = wide.unpivot(["symbol"], [f"`{a}|{b}`" for a, b in pairs], "pair", "corr")
    parts = F.split("pair", r"\|")
    return long.select("symbol", parts[0].alias("a"), parts[1].alias("b"), F.when(~F.isnan("corr"), F.col("corr")).alias("corr"))


def crisis_ic(meta: DataFrame, crises: list[tuple[str, str, str]], col: str = "rolling_ic_return") -> DataFrame:
    """Mean IC inside each crisis against the mean outside all of them."""
    known = meta.where(F.col(col).isNotNull())
    calm = known.where(~in_any_crisis(crises)).groupBy("symbol").agg(F.avg(col).alias("baseline_ic"), F.count("*").alias("n_baseline"))
    inside = crisis_rows(known, crises).groupBy("symbol", "crisis").agg(F.avg(col).alias("crisis_ic"), F.count("*").alias("n"))
    return inside.join(calm, "symbol").withColumn("drops", F.col("crisis_ic") < F.col("baseline_ic"))
