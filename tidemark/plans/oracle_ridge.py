"""Oracle SQL of the ridge fits: Gram sums, unrolled elimination, fold scores (DuckDB dialect)."""

from __future__ import annotations

from tidemark.operators.meta import META_FEATURES
from tidemark.operators.ridge import ALPHAS_V2
from tidemark.plans.oracle_meta import _YS
from tidemark.plans.registry import CTES, cte

D = len(META_FEATURES)
ZS, YS = [f"z{i}" for i in range(D)], ["y_return", "y_vol", "y_regime", "y_drawdown"]
TERMS = ["one", *ZS, *YS]
SPLITS, GAP = 5, 21


def _s(a: str, b: str, table: str = "") -> str:
    a, b = sorted((a, b), key=TERMS.index)
    return f"{table}s_{a}_{b}"


_PART = "PARTITION BY symbol"
# The learner's rows: a target without spread stays as it is, a feature without spread is only centred.
cte("learner_proxy", "SELECT symbol, date, " + ", ".join(
    f"CASE WHEN stddev_samp({y}) OVER ({_PART}) > 0 THEN ({y} - avg({y}) OVER ({_PART})) / stddev_samp({y}) OVER ({_PART}) ELSE {y} END AS {y}" for y in _YS) + " FROM proxy_known")
cte("learner_xy", CTES["meta_xy"].replace("JOIN proxy USING", "JOIN learner_proxy USING"))
cte("ridge_rows", "SELECT symbol, date, 1.0 AS one, " + ", ".join(
    f"({c} - avg({c}) OVER ({_PART})) / CASE WHEN stddev_pop({c}) OVER ({_PART}) > 0 THEN stddev_pop({c}) OVER ({_PART}) ELSE 1 END AS {z}" for c, z in zip(META_FEATURES, ZS)
) + f", {', '.join(YS)}, row_number() OVER ({_PART} ORDER BY date) - 1 AS pos, count(*) OVER ({_PART}) AS n FROM learner_xy WHERE part = 'train'")
cte("ridge_fold_rows", f"""
SELECT *, -1 AS fold, 'all' AS role FROM ridge_rows
UNION ALL SELECT r.*, fold, CASE WHEN pos < n - ({SPLITS} - fold) * (n // {SPLITS + 1}) - {GAP} THEN 'train' ELSE 'test' END AS role
FROM ridge_rows r, (SELECT unnest(range({SPLITS})) AS fold)
WHERE pos < n - ({SPLITS} - fold) * (n // {SPLITS + 1}) - {GAP}
  OR (pos >= n - ({SPLITS} - fold) * (n // {SPLITS + 1}) AND pos < n - ({SPLITS} - 1 - fold) * (n // {SPLITS + 1}))""")
cte("ridge_gram", "SELECT symbol, fold, role, " + ", ".join(
    f"sum({a} * {b}) AS {_s(a, b)}" for i, a in enumerate(TERMS) for b in TERMS[i:]) + " FROM ridge_fold_rows GROUP BY symbol, fold, role")
_N = _s("one", "one")
_A = {(i, j): f"a_{i}_{j}" for i in range(D) for j in range(D)}
_B = {(i, m): f"b_{i}_{m}" for i in range(D) for m in range(len(YS))}
cte("ridge_step0", "SELECT symbol, fold, alpha, " + ", ".join(
    f"{_s(ZS[i], ZS[j])} - {_s('one', ZS[i])} * {_s('one', ZS[j])} / {_N}" + (" + alpha" if i == j else "") + f" AS {name}" for (i, j), name in _A.items()
) + ", " + ", ".join(
    f"{_s(ZS[i], YS[m])} - {_s('one', ZS[i])} * {_s('one', YS[m])} / {_N} AS {name}" for (i, m), name in _B.items()
) + ", " + ", ".join(f"{_s('one', z)} / {_N} AS mx_{i}" for i, z in enumerate(ZS)) + ", " + ", ".join(
    f"{_s('one', y)} / {_N} AS my_{m}" for m, y in enumerate(YS)
) + f" FROM ridge_gram, (SELECT unnest([{', '.join(repr(a) for a in ALPHAS_V2)}]) AS alpha) WHERE role <> 'test'")
for k in range(D):
    pivot = _A[k, k]
    cells = {name: f"{name} - {_A[i, k]} * {_A[k, j]} / {pivot}" if i != k else f"{name} / {pivot}" for (i, j), name in _A.items()}
    cells |= {name: f"{name} - {_A[i, k]} * {_B[k, m]} / {pivot}" if i != k else f"{name} / {pivot}" for (i, m), name in _B.items()}
    cte(f"ridge_step{k + 1}", "SELECT * REPLACE (" + ", ".join(f"{e} AS {n}" for n, e in cells.items()) + f") FROM ridge_step{k}")
cte("ridge_fit", "SELECT symbol, fold, alpha, " + ", ".join(_B.values()) + ", " + ", ".join(
    f"my_{m} - " + " - ".join(f"mx_{i} * {_B[i, m]}" for i in range(D)) + f" AS c_{m}" for m in range(len(YS))) + f" FROM ridge_step{D}")


def _sse(m: int) -> str:
    y, c = YS[m], f"c_{m}"
    beta = [_B[i, m] for i in range(D)]
    cross = " + ".join([f"{c} * {_s('one', y)}", *[f"{b} * {_s(z, y)}" for b, z in zip(beta, ZS)]])
    quad = " + ".join(
        [f"{c} * {c} * {_N}", *[f"2 * {c} * {b} * {_s('one', z)}" for b, z in zip(beta, ZS)],
         *[f"{beta[i]} * {beta[j]} * {_s(ZS[i], ZS[j])}" for i in range(D) for j in range(D)]]
    )
    return f"{_s(y, y)} - 2 * ({cross}) + ({quad})"


cte("ridge_scores", " UNION ALL ".join(
    f"SELECT f.symbol, {m} AS model, alpha, avg(1 - ({_sse(m)}) / ({_s(y, y)} - {_s('one', y)} * {_s('one', y)} / {_N})) AS score "
    f"FROM ridge_fit f JOIN ridge_gram t ON f.symbol = t.symbol AND f.fold = t.fold AND t.role = 'test' GROUP BY f.symbol, alpha HAVING count(*) = {SPLITS}"
    for m, y in enumerate(YS)
))
cte("ridge_pick", """
SELECT symbol, model, alpha FROM (SELECT *, row_number() OVER (PARTITION BY symbol, model ORDER BY score DESC, alpha) AS place FROM ridge_scores) WHERE place = 1""")
cte("ridge_models", " UNION ALL ".join(
    f"SELECT p.symbol, '{y[2:]}' AS model, p.alpha, c_{m} AS intercept, " + ", ".join(f"{_B[i, m]} AS coef_{i}" for i in range(D))
    + f", p.alpha >= {max(ALPHAS_V2)!r} AS saturated, true AS fitted FROM ridge_pick p JOIN ridge_fit f ON p.symbol = f.symbol AND p.alpha = f.alpha AND f.fold = -1 WHERE p.model = {m}"
    for m, y in enumerate(YS)
) + f"""
UNION ALL SELECT symbol, unnest(['return', 'vol', 'regime', 'drawdown']) AS model, NULL AS alpha, 0.0 AS intercept, {', '.join(f'0.0 AS coef_{i}' for i in range(D))},
  false AS saturated, false AS fitted FROM (SELECT DISTINCT symbol FROM ridge_rows) WHERE symbol NOT IN (SELECT symbol FROM ridge_pick)""")
