"""Online scoring: predict with the weights known so far, then learn from the realised return.

State per symbol is a few short arrays (the last 21 PnL values and rank pairs,
the last 5 returns), two running sums and the latest weights: bounded whatever
the length of the stream, and exactly what the batch backtest's windows see.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.arrays import spearman_rows
from tidemark.functions.scalars import MODELS
from tidemark.operators.meta import META_FEATURES, WINDOW, WeightModel

INPUT = ("symbol", "date", "return_pred", "vol_pred", "regime_pred", "drawdown_risk_prob", "regime_label", "disagreement", "ret_bwd")
OUTPUT = (
    "symbol string, date date, signal double, "
    + ", ".join(f"w_{m} double" for m in MODELS)
    + ", fallback boolean, failed boolean, seen long, buffered int, late long, "
    + ", ".join(f"{c} double" for c in META_FEATURES)
)
ARRAYS = ("rets", "pnl_ret", "pnl_reg", "dis", "x_ret", "y_ret", "x_vol", "y_vol", "weights")
STATE = "last_date date, late long, seen long, total double, known long, sign double, direction double, " + ", ".join(f"{a} array<double>" for a in ARRAYS)
FRESH = {"last_date": None, "late": 0, "seen": 0, "total": 0.0, "known": 0, "sign": float("nan"), "direction": float("nan"), **{a: [] for a in ARRAYS}}
NAMES = list(FRESH)


def _previous(first: float, x: np.ndarray) -> np.ndarray:
    return np.concatenate([[first], x[:-1]])


def _tail_windows(past: list, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-row window ending at each new row, padded with NaN; the joined values)."""
    joined = np.concatenate([np.asarray(past, dtype=float), x])
    padded = np.concatenate([np.full(max(0, n - 1 - len(past)), np.nan), joined])
    return sliding_window_view(padded, n)[-len(x) :], joined


def _rolling_ic(pred: np.ndarray, past: np.ndarray, xs: list, ys: list, n: int) -> tuple[np.ndarray, list, list]:
    """IC of the n pairs before each new row with a known prediction, and the pairs to keep."""
    use = ~np.isnan(pred)
    out = np.full(len(pred), np.nan)
    x, y = np.concatenate([xs, pred[use]]), np.concatenate([ys, past[use]])
    if use.any():
        lead = n - len(xs)
        px, py = (np.concatenate([np.full(lead, np.nan), v]) for v in (x, y))
        wx, wy = (sliding_window_view(v[:-1], n) for v in (px, py))
        full = ~(np.isnan(wx).any(axis=1) | np.isnan(wy).any(axis=1))
        ic = np.full(len(wx), np.nan)
        if full.any():
            ic[full] = spearman_rows(wx[full], wy[full])
        out[use] = ic
    return out, x[-n:].tolist(), y[-n:].tolist()


def _weights(meta: np.ndarray, model: WeightModel) -> np.ndarray:
    z = (meta - np.array(model.mean)) / np.array(model.scale)
    scores = np.stack([np.zeros(len(z)) if m in model.saturated else model.intercept[m] + z @ np.array(model.coef[m]) for m in MODELS], axis=1)
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return (1 - len(MODELS) * model.floor) * e / e.sum(axis=1, keepdims=True) + model.floor


def _learned(meta: np.ndarray, model: WeightModel) -> np.ndarray:
    """Four weights and a flag for every row: unknown before the track record is complete, equal and flagged where no
    finite weights come of it (a model without a coefficient it needs, or one that overflows)."""
    complete = ~np.isnan(meta).any(axis=1)
    try:
        with np.errstate(all="ignore"):
            w = _weights(np.where(complete[:, None], meta, 0.0), model)
    except (KeyError, ValueError):
        w = np.full((len(meta), len(MODELS)), np.nan)
    failed = ~np.isfinite(w).all(axis=1)
    w = np.column_stack((np.where(failed[:, None], 1 / len(MODELS), w), failed))
    return np.where(complete[:, None], w, np.nan)


def score_block(rows: pd.DataFrame, s: dict, model: WeightModel, n: int = WINDOW) -> tuple[pd.DataFrame, dict]:
    """Score date-ordered rows of one symbol and return the state after them."""
    pred, vol, dis, ret = (rows[c].to_numpy(dtype=float) for c in ("return_pred", "vol_pred", "disagreement", "ret_bwd"))
    label = rows["regime_label"].to_numpy(dtype=float)
    known = ~np.isnan(pred)
    total, count = s["total"] + np.nancumsum(pred), s["known"] + np.cumsum(known)
    with np.errstate(divide="ignore", invalid="ignore"):
        sign = np.sign(pred - total / count)
    direction = (label == 0).astype(float) - (label == 1).astype(float)
    pnl_ret, pnl_reg = _previous(s["sign"], sign) * ret, _previous(s["direction"], direction) * ret

    meta = {}
    wins, all_ret = _tail_windows(s["pnl_ret"], pnl_ret, n)
    meta["rolling_pnl_return"] = wins.sum(axis=1)
    wins, all_reg = _tail_windows(s["pnl_reg"], pnl_reg, n)
    meta["rolling_pnl_regime"] = wins.sum(axis=1)
    wins, all_dis = _tail_windows(s["dis"], dis, n)
    meta["rolling_disagreement"] = wins.mean(axis=1)
    wins, all_rets = _tail_windows(s["rets"], ret, 6)
    past_vol = wins[:, :-1].std(axis=1, ddof=1)
    meta["rolling_ic_return"], x_ret, y_ret = _rolling_ic(pred, wins[:, -2], s["x_ret"], s["y_ret"], n)
    meta["rolling_ic_vol"], x_vol, y_vol = _rolling_ic(vol, past_vol, s["x_vol"], s["y_vol"], n)

    m = np.stack([meta[c] for c in META_FEATURES], axis=1)
    first = pd.DataFrame([s["weights"] or [np.nan] * (len(MODELS) + 1)])
    in_force = pd.concat([first, pd.DataFrame(_learned(m, model))], ignore_index=True).ffill()
    used = in_force.iloc[:-1].to_numpy(dtype=float)
    fallback = np.isnan(used).any(axis=1)
    failed = used[:, -1] == 1
    used = np.where(fallback[:, None], 1 / len(MODELS), used[:, :-1])
    d = np.stack(
        [pred, *[np.nan_to_num(-rows[c].to_numpy(dtype=float)) for c in ("vol_pred", "regime_pred", "drawdown_risk_prob")]], axis=1
    )
    seen = s["seen"] + np.arange(1, len(rows) + 1)
    out = pd.DataFrame(
        {
            "symbol": rows["symbol"].to_numpy(),
            "date": rows["date"].to_numpy(),
            "signal": (used * d).sum(axis=1),
            **{f"w_{k}": used[:, i] for i, k in enumerate(MODELS)},
            "fallback": fallback,
            "failed": failed,
            "seen": seen,
            "buffered": np.minimum(len(s["x_ret"]) + np.cumsum(known), n),
            "late": s["late"],
            **{c: meta[c] for c in META_FEATURES},
        }
    )
    last = in_force.iloc[-1].to_numpy(dtype=float)
    state = {
        "last_date": rows["date"].iloc[-1],
        "late": s["late"],
        "seen": int(seen[-1]),
        "total": float(total[-1]),
        "known": int(count[-1]),
        "sign": float(sign[-1]),
        "direction": float(direction[-1]),
        "rets": all_rets[-5:].tolist(),
        "pnl_ret": all_ret[-(n - 1) :].tolist(),
        "pnl_reg": all_reg[-(n - 1) :].tolist(),
        "dis": all_dis[-(n - 1) :].tolist(),
        "x_ret": x_ret,
        "y_ret": y_ret,
        "x_vol": x_vol,
        "y_vol": y_vol,
        "weights": [] if np.isnan(last).any() else last.tolist(),
    }
    return out, state


def stream_score(rows: DataFrame, model: WeightModel) -> DataFrame:
    """Streaming twin of ``backtest``: signal, weights and track record for every arriving row.

    Rows of a micro-batch arrive unordered and are sorted by date here (of several with one date the one with the
    largest values counts); a row not newer than the symbol's last one is dropped, and ``late`` counts those so far.
    ``buffered`` is the number of prediction pairs that the state holds. Until a complete track record exists the
    equal-weight fallback is used and flagged; equal weights after a failed score are flagged as ``failed``.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = dict(zip(NAMES, state.get)) if state.exists else dict(FRESH)
        s = {k: list(v) if k in ARRAYS else v for k, v in s.items()}
        block = pd.concat(batches, ignore_index=True).sort_values(["date", *INPUT[2:]], kind="stable", na_position="first")
        if s["last_date"] is not None:
            fresh = block["date"] > s["last_date"]
            s["late"] += int((~fresh).sum())
            block = block[fresh]
        block = block.drop_duplicates("date", keep="last")
        if block.empty:
            state.update(tuple(s[k] for k in NAMES))
            return
        out, s = score_block(block, s, model)
        state.update(tuple(s[k] for k in NAMES))
        yield out

    keyed = rows.select(*INPUT).groupBy("symbol")
    return keyed.applyInPandasWithState(step, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)
