"""Scalar rules of the panel: buckets, encodings, signals, weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Volatility-index bucket edges (right-closed) and their codes.
VIX_LOW_MAX = 15.0
VIX_MEDIUM_MAX = 25.0
VIX_CODES = {"low": 0.0, "medium": 1.0, "high": 2.0}
# Drawdown event threshold, weight floor, base model names in order.
DRAWDOWN_EVENT = -0.05
WEIGHT_FLOOR = 0.05
MODELS = ("return", "vol", "regime", "drawdown")
PRED_COLS = ("return_pred", "vol_pred", "regime_pred", "drawdown_risk_prob")


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound ``x``; NULL stays NULL (greatest/least would skip it)."""
    y = x
    if low is not None:
        y = F.greatest(y, F.lit(low))
    if high is not None:
        y = F.least(y, F.lit(high))
    return F.when(x.isNotNull(), y)


def vix_bucket(v: Column) -> Column:
    return F.when(v <= VIX_LOW_MAX, "low").when(v <= VIX_MEDIUM_MAX, "medium").when(v.isNotNull(), "high")


def vix_ordinal(bucket: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, code in VIX_CODES.items():
        out = F.when(bucket == name, F.lit(code)).otherwise(out)
    return out


def regime_risk(label: Column) -> Column:
    """Raw label (0 bull, 1 bear, 2 sideways) to risk order (0, 2, 1)."""
    return F.when(label == 0, 0.0).when(label == 2, 1.0).when(label == 1, 2.0)


def regime_direction(label: Column) -> Column:
    """+1 bull, -1 bear, 0 otherwise."""
    return F.when(label == 0, 1.0).when(label == 1, -1.0).otherwise(0.0)


def drawdown_event(mdd: Column, threshold: float = DRAWDOWN_EVENT) -> Column:
    """1 below the threshold, 0 above, NULL for an unknown target."""
    return F.when(mdd.isNotNull(), (mdd < threshold).cast("int"))


def direction_signals(ret="return_pred", vol="vol_pred", regime="regime_pred", dd="drawdown_risk_prob") -> dict[str, Column]:
    """Per-model directional signal; an unknown risk signal counts as 0."""
    return {
        "d_return": F.col(ret),
        "d_vol": F.coalesce(-F.col(vol), F.lit(0.0)),
        "d_regime": F.coalesce(-F.col(regime), F.lit(0.0)),
        "d_drawdown": F.coalesce(-F.col(dd), F.lit(0.0)),
    }


def weighted_signal(weights: dict[str, Column], signals: dict[str, Column]) -> Column:
    out = None
    for m in MODELS:
        term = weights[m] * signals[f"d_{m}"]
        out = term if out is None else out + term
    return out


def equal_signal(signals: dict[str, Column]) -> Column:
    return weighted_signal({m: F.lit(0.25) for m in MODELS}, signals)


def softmax_floor(scores: list[Column], floor: float = WEIGHT_FLOOR) -> list[Column]:
    """Row softmax mixed with a floor so that weights sum to 1 and none is below it.

    Each share is 1 / sum(exp(s_j - s_i)): no score can overflow it and the
    expression stays small when a filter on a weight is pushed into the plan.
    """
    scale = 1.0 - len(scores) * floor
    out = []
    for s in scores:
        total = None
        for t in scores:
            total = F.exp(t - s) if total is None else total + F.exp(t - s)
        out.append(F.lit(scale) / total + F.lit(floor))
    return out


def row_mean(cols: list[Column]) -> Column:
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return total / float(len(cols))


def row_std(cols: list[Column], ddof: int = 1) -> Column:
    m = row_mean(cols)
    ss = None
    for c in cols:
        term = (c - m) * (c - m)
        ss = term if ss is None else ss + term
    return F.sqrt(ss / float(len(cols) - ddof))
