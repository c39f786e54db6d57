import numpy as np
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import ann, queries
from tidemark.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, rank int, score string"


def brute(rows, every, k=5):
    """Query id to its nearest (id, cosine), one row per id."""
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, v in good:
        if q % every == 0 and q not in out:
            v = min((w for i, w in good if i == q), key=list)
            best = {}
            for i, w in good:
                if i != q:
                    best[i] = max(best.get(i, -2), (v * w).sum() / np.sqrt((v * v).sum()) / np.sqrt((w * w).sum()))
            out[q] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def test_recall_and_scores_on_a_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, "/root/testdata/sf0.1", "embeddings").collect()]
    got = queries.op8_ann(spark, "/root/testdata/sf0.1").collect()
    want = brute(rows, 50)
    vectors = {i: np.array(v, float) for i, v in rows}
    hits = 0
    for q, best in want.items():
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        for r in mine:
            v, w = vectors[q], vectors[r.vec_id]
            assert abs(r.score - v @ w / np.linalg.norm(v) / np.linalg.norm(w)) < 1e-12
        hits += len({r.vec_id for r in mine} & {i for i, _ in best})
    assert len(got) == 5 * len(want) and hits >= 0.9 * 5 * len(want)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=8)
    rows = [(i, (base + 0.01 * rng.normal(size=8) * (i % 3)).tolist()) for i in range(40)]  # a third are equal
    rows += [(100, None), (110, [0.0] * 8), (120, [1.0, None] * 4), (130, [float("nan")] * 8), (140, [float("inf")] * 8), (150, [1.0] * 3), (None, base.tolist())]
    rows += [rows[0], (3, (-base).tolist()), (160, (2 * base).tolist())]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)
    got = {}
    for r in sorted(ann.search(df, 10).collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    want = {q: [(i, round(s, 9)) for i, s in best] for q, best in brute([r for r in rows if r[0] != 150], 10).items()}
    assert got == want
    assert ann.search(df.limit(0), 10).count() == 0
    assert ann.search(spark.createDataFrame([(10, [1.0, 2.0], 1, "")], SCHEMA), 10).count() == 0


def test_uneven_density(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 24))
    tight = centres[rng.integers(0, 40, 4000)] + 0.02 * rng.normal(size=(4000, 24))
    vectors = np.concatenate((tight, rng.normal(size=(1000, 24))))
    ids = rng.permutation(5000)
    df = spark.createDataFrame([(int(i), v.tolist(), 0, "") for i, v in zip(ids, vectors)], SCHEMA)
    got = {}
    for r in ann.search(df, 50).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = (vectors / np.linalg.norm(vectors, axis=1)[:, None]).astype(np.float32).astype(float)
    hits = {True: [], False: []}
    for at in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[at]
        score[at] = -2
        best = set(ids[np.argsort(-score)[:5]].tolist())
        assert len(got[int(ids[at])]) == 5
        hits[at < 4000].append(len(best & got[int(ids[at])]) / 5)
    assert np.mean(hits[True]) >= 0.9 and np.mean(hits[False]) >= 0.9


def test_index_reaches_the_target_at_any_block_size():
    for rows in (2, 1000, ann.BLOCK_ROWS[1]):
        assert ann.fit(0.5, 16, rows) is not None
    assert ann.fit(0.5, 16, 1 << 40) is None  # such a level is left out


@settings(max_examples=20, deadline=None)
@given(st.integers(4, 9), st.integers(1, 60))
def test_visiting_order_never_crosses_both_borders(m, n):
    sets = ann.visiting_order(m, n)
    offset = np.random.default_rng(m * n).random((3, 2, m))
    mix = (1 << np.arange(m)) * 1_000_003
    score, order, sign = ann._borders(offset)
    for places in sets:
        used = places[places >= 0]
        for row in order.reshape(-1, 2 * m):
            assert len(set(row[used])) == len(used)
    assert len({tuple(s) for s in sets.tolist()}) == len(sets)
    assert ann._steps(offset, sets, len(sets), mix).shape == (3, 2, len(sets))
