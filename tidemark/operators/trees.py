"""Boosted-tree predictors on MLlib and their evaluation in plain aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import DRAWDOWN_EVENT, drawdown_event
from tidemark.functions.windows import ordered
from tidemark.operators.ensemble import align_predictions
from tidemark.operators.quality import require_columns

# Tree counts, depths, rates, sampling, patience and leaf sizes of the two models.
RETURN_TREES, RETURN_DEPTH, RETURN_RATE = 1000, 3, 0.01
DRAWDOWN_TREES, DRAWDOWN_DEPTH, DRAWDOWN_RATE = 30, 3, 0.05
ROW_SHARE, COLUMN_SHARE, PATIENCE = 0.8, "0.8", 50
RETURN_LEAF, DRAWDOWN_LEAF = 10, 10
SEED = 42
# Rows of a task of the regression, each of whose trees starts several jobs.
TASK_ROWS = 50_000


def training_rows(features: DataFrame, targets: DataFrame, target: str, cols: list[str]) -> DataFrame:
    """Features and targets of the rows with a known target and no unknown feature."""
    joined = features.join(targets, ["symbol", "date"])
    return joined.na.drop(subset=[target, *cols])


def null_drops(rows: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """Rows kept and dropped per key when rows with an unknown value in ``cols`` go; a key that loses all stays."""
    ok = reduce(Column.__and__, [F.col(c).isNotNull() for c in cols])
    return rows.groupBy(*keys).agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


def best_round(errors: list[float], patience: int = PATIENCE) -> int:
    """Number of rounds to keep: those up to the least error that no later one within ``patience`` rounds beats."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def return_fit(rows: DataFrame, cols: list[str], label: str, trees: int = RETURN_TREES, step: float = RETURN_RATE, patience: int = PATIENCE) -> PipelineModel:
    """Regressor trained on split = train, with the number of rounds that split = val likes best, which may be one."""
    return return_rounds(rows, cols, label, trees, step, patience)[0]


def return_rounds(
    rows: DataFrame, cols: list[str], label: str, trees: int = RETURN_TREES, step: float = RETURN_RATE, patience: int = PATIENCE
) -> tuple[PipelineModel, list[float]]:
    """The fit of ``return_fit`` and the validation error of every round tried (none without validation rows).

    All rounds are fitted once, the validation error of each is read off, and the ensemble is fitted again up to the
    round chosen with ``patience``: the same seed grows the same first trees.
    """
    assembler = VectorAssembler(inputCols=cols, outputCol="features")
    train, val = (assembler.transform(_laid_out(rows.where(F.col("split") == s).select(*cols, label))).select("features", label).cache() for s in ("train", "val"))

    def boosted(n: int) -> GBTRegressor:
        return GBTRegressor(
            featuresCol="features", labelCol=label, predictionCol="return_pred", maxIter=n, maxDepth=RETURN_DEPTH, stepSize=step,
            subsamplingRate=ROW_SHARE, featureSubsetStrategy=COLUMN_SHARE, minInstancesPerNode=RETURN_LEAF, seed=SEED,
        )

    errors: list[float] = []
    try:
        model = boosted(trees).fit(train)
        if not val.isEmpty():
            errors = list(model.evaluateEachIteration(val, "squared"))
            kept = best_round(errors, patience)
            if kept < trees:
                model = boosted(kept).fit(train)
    finally:
        train.unpersist()
        val.unpersist()
    return PipelineModel([assembler, model]), errors


def _laid_out(rows: DataFrame) -> DataFrame:
    """Rows placed and sorted by their values: a seeded sample goes by a row's place, and so depends on the rows alone,
    not on the files and cores they came from."""
    return rows.repartition(1 + rows.count() // TASK_ROWS, *rows.columns).sortWithinPartitions(*rows.columns)


def _parts(rows: DataFrame) -> int:
    """Boosting starts several jobs a tree: no more tasks in each than cores."""
    return rows.sparkSession.sparkContext.defaultParallelism


def rounds_kept(model: PipelineModel) -> int:
    return model.stages[-1].getNumTrees


def drawdown_fit(rows: DataFrame, cols: list[str], label: str = "event") -> PipelineModel:
    """Classifier with a fixed number of trees, fitted on split = train.

    Training rows without any event leave nothing to learn and are refused. No class
    weights: they would bias the probabilities.
    """
    assembler = VectorAssembler(inputCols=cols, outputCol="features")
    train = assembler.transform(rows.where("split = 'train'")).select("features", label).coalesce(_parts(rows)).cache()
    gbt = GBTClassifier(
        featuresCol="features", labelCol=label, maxIter=DRAWDOWN_TREES, maxDepth=DRAWDOWN_DEPTH, stepSize=DRAWDOWN_RATE,
        subsamplingRate=ROW_SHARE, featureSubsetStrategy=COLUMN_SHARE, minInstancesPerNode=DRAWDOWN_LEAF, seed=SEED,
    )
    try:
        if train.where(F.col(label) == 1).isEmpty():
            raise ValueError("the train rows hold no drawdown event")
        return PipelineModel([assembler, gbt.fit(train)])
    finally:
        train.unpersist()


def with_event(rows: DataFrame, target: str = "tgt_mdd_21d", threshold: float = DRAWDOWN_EVENT) -> DataFrame:
    return rows.withColumn("event", drawdown_event(F.col(target), threshold))


def model_inputs(model: PipelineModel) -> list[str]:
    return list(model.stages[0].getInputCols())


def score_returns(model: PipelineModel, rows: DataFrame) -> DataFrame:
    require_columns(rows, model_inputs(model))
    return model.transform(rows.na.drop(subset=model_inputs(model))).select(*rows.columns, "return_pred")


def score_drawdown(model: PipelineModel, rows: DataFrame) -> DataFrame:
    require_columns(rows, model_inputs(model))
    scored = model.transform(rows.na.drop(subset=model_inputs(model)))
    return scored.select(*rows.columns, vector_to_array("probability")[1].alias("drawdown_risk_prob"))


# --- evaluation ---------------------------------------------------------------


def average_rank(x: str, w_part: list[str]) -> Column:
    """Average-tie rank of ``x`` within its partition."""
    w = Window.partitionBy(*w_part)
    return F.rank().over(w.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*w_part, x)) - 1) / F.lit(2.0)


def return_eval(rows: DataFrame, y: str, pred: str, keys: list[str]) -> DataFrame:
    """Rank IC, RMSE and sign hit rate per key (a symbol's split: bounded by the calendar)."""
    known = rows.where(F.col(y).isNotNull() & F.col(pred).isNotNull())
    ranked = known.withColumns({"_ry": average_rank(y, keys), "_rp": average_rank(pred, keys)})
    return ranked.groupBy(*keys).agg(
        F.corr("_ry", "_rp").alias("ic"),
        F.sqrt(F.avg(F.pow(F.col(y) - F.col(pred), 2))).alias("rmse"),
        F.avg((F.signum(y) == F.signum(pred)).cast("double")).alias("hit_rate"),
        F.count(F.lit(1)).alias("n"),
    )


def class_balance(rows: DataFrame, keys: list[str], label: str = "event") -> DataFrame:
    known = rows.where(F.col(label).isNotNull())
    return known.groupBy(*keys).agg(
        F.sum(label).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives"), F.avg(label).alias("base_rate")
    )


def score_counts(rows: DataFrame, keys: list[str], label: str = "event", score: str = "drawdown_risk_prob") -> DataFrame:
    """Positives and negatives at each distinct score: ties collapse before any ordering."""
    known = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    return known.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(label).cast("double").alias("pos"), F.sum(1 - F.col(label)).cast("double").alias("neg")
    )


def ranking_metrics(counts: DataFrame, keys: list[str]) -> DataFrame:
    """ROC AUC and average precision from per-score counts, by one descending running sum."""
    w = ordered(*keys, order="score").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumns({"_tp": F.sum("pos").over(w), "_fp": F.sum("neg").over(w)})
    return _finish_ranking(run, keys)


def _finish_ranking(run: DataFrame, keys: list[str]) -> DataFrame:
    precision = F.try_divide("_tp", F.col("_tp") + F.col("_fp"))
    area = F.col("neg") * (F.col("_tp") - F.col("pos") / 2)
    return run.groupBy(*keys).agg(
        F.try_divide(F.sum(area), F.sum("pos") * F.sum("neg")).alias("auc_roc"),
        F.try_divide(F.sum(F.col("pos") * precision), F.sum("pos")).alias("aucpr"),
    )


def pooled_ranking_metrics(counts: DataFrame, slices: int = 1024) -> DataFrame:
    """The same two metrics over all symbols together, without one global sort.

    Ties collapse first, so a score shared by a third of all rows is one row. The
    distinct scores are then cut at their own approximate quantiles into equal
    slices (only the cut points reach the driver); slice totals give each slice
    its starting counts and the running sum is taken inside slices.
    """
    pooled = counts.groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    cuts = sorted(set(pooled.approxQuantile("score", [i / slices for i in range(1, slices)], 1 / (4 * slices))))
    if not cuts:
        return _finish_ranking(pooled.withColumns({"_tp": F.lit(0.0), "_fp": F.lit(0.0), "pool": F.lit("all")}), ["pool"])
    edges = [float("-inf"), *cuts, float("inf")]
    pooled = Bucketizer(splits=edges, inputCol="score", outputCol="slice").transform(pooled)
    totals = pooled.groupBy("slice").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    above = ordered("pool", order="slice").orderBy(F.col("slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("pool", F.lit("all"))
    starts = totals.select("slice", *[F.coalesce(F.sum(c).over(above), F.lit(0.0)).alias(f"{c}0") for c in ("_p", "_n")])
    inside = ordered("slice", order="score").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = pooled.join(F.broadcast(starts), "slice")  # at most ``slices`` rows
    run = run.withColumns({"_tp": F.col("_p0") + F.sum("pos").over(inside), "_fp": F.col("_n0") + F.sum("neg").over(inside)})
    return _finish_ranking(run.withColumn("pool", F.lit("all")), ["pool"])


def drawdown_eval(rows: DataFrame, keys: list[str], label: str = "event", score: str = "drawdown_risk_prob", threshold: float = 0.5) -> DataFrame:
    """ROC AUC, average precision, precision and recall at a threshold, log loss and base rate."""
    known = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    p, y, call = F.col(score), F.col(label), (F.col(score) >= threshold).cast("int")
    eps = 2.220446049250313e-16
    safe = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    hit = F.sum(call * y).cast("double")
    flat = known.groupBy(*keys).agg(
        F.coalesce(F.try_divide(hit, F.sum(call)), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(hit, F.sum(y)), F.lit(0.0)).alias("recall"),
        (-F.avg(y * F.log(safe) + (1 - y) * F.log(1 - safe))).alias("log_loss"),
        F.avg(y).alias("base_rate"),
        F.count(F.lit(1)).alias("n"),
    )
    return flat.join(ranking_metrics(score_counts(rows, keys, label, score), keys), keys)


def predict_all(
    price: DataFrame, joined: DataFrame, return_model: PipelineModel, drawdown_model: PipelineModel, vol: DataFrame, regime: DataFrame
) -> DataFrame:
    """All four base predictions on one (symbol, date) table."""
    return align_predictions(score_returns(return_model, price), score_drawdown(drawdown_model, joined), vol, regime)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
