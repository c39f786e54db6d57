"""Product codes against plain NumPy: every distance computed, every row read."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string, l int, n long, heavy boolean, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 1, 2, True, "y") for i, v, y in rows], SCHEMA).repartition(5)


def brute(rows, parts=8, entries=16, rounds=6):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.floor(4096 * np.array([r[1] for r in rows], np.float32).astype(np.float64)).astype(np.int64).reshape(len(rows), parts, -1)
    books = x[[i for i, r in enumerate(rows) if r[0] is not None][:entries]].transpose(1, 0, 2).copy()

    def assign():
        gaps = ((x[:, :, None] - books[None]) ** 2).sum(3)
        return gaps.argmin(2), gaps.min(2)

    for _ in range(rounds):
        at, _ = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                if (mine := x[at[:, p] == e, p]).size:
                    books[p, e] = mine.sum(0) // len(mine)
    at, gap = assign()
    error = gap.sum(1)
    labels = [r[2] for r in rows]
    total = {y: int(sum(e for e, z in zip(error, labels) if z == y)) for y in set(labels)}
    sha = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    key = lambda r: (r[0] is None, r)
    return sorted(((r[0], "".join(f"{k:02x}" for k in c), int(e), total[r[2]], sha) for r, c, e in zip(rows, at, error)), key=key)


def got(df):
    return sorted(map(tuple, V.digests(df).collect()), key=lambda r: (r[0] is None, r))


def test_orchard_is_exact_and_measures_less():
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (40, 6))
    points = centres[rng.integers(0, 40, 3000)] + rng.integers(-60, 60, (3000, 6))
    book = np.concatenate((centres[::-1], centres[:5]))  # repeated entries: ties
    search = V.Orchard(book)
    at, gap = search.nearest(points)
    all_gaps = ((points[:, None] - book[None]) ** 2).sum(2)
    assert (at == all_gaps.argmin(1)).all() and (gap == all_gaps.min(1)).all()
    assert search.measured < all_gaps.size / 4
    small = rng.integers(-2, 3, (500, 3))  # nothing but ties
    at, gap = V.Orchard(small[:16]).nearest(small)
    all_gaps = ((small[:, None] - small[None, :16]) ** 2).sum(2)
    assert (at == all_gaps.argmin(1)).all() and (gap == all_gaps.min(1)).all()


@pytest.mark.parametrize("width", [8, 24])
def test_digests_equal_brute_force(spark, width):
    rng = np.random.default_rng(width)
    rows = [(int(i), rng.normal(0, 0.3, width).astype(np.float32).tolist(), int(y) if y < 90 else None) for i, y in zip(rng.permutation(700), rng.integers(0, 95, 700))]
    rows += [(1000 + i, [0.25] * width, 7) for i in range(400)]  # a hot label, equal vectors
    odd = [(-1, None, 1), (-2, [0.1] * (width - 1) + [None], 1), (-3, [float("nan")] * width, 1), (-4, [float("inf")] + [0.0] * (width - 1), 2), (-5, [], 1)]
    odd += [(-6, [0.5] * 16, 3), (-7, [0.5] * 5, 3), (-8, [3e30] * width, 3)]
    assert got(table(spark, rows + odd)) == brute(rows)


def test_few_rows_repeats_and_null_ids(spark):
    rows = [(3, [0.5, -0.5] * 4, 1), (3, [0.5, -0.5] * 4, 1), (None, [0.1] * 8, None), (1, [0.1] * 8, None)]
    assert got(table(spark, rows)) == brute(rows)
    assert got(table(spark, [])) == [] and got(table(spark, [(1, None, 1), (2, [0.5] * 3, 1)])) == []
    assert got(table(spark, [(None, [0.5] * 8, 1)])) == []  # no id, no entry
    assert V.digests(table(spark, [])).columns == V.digests(table(spark, rows)).columns


def test_decode_gives_the_named_entries(spark):
    rng = np.random.default_rng(1)
    df = table(spark, [(i, rng.normal(0, 0.3, 16).astype(np.float32).tolist(), 0) for i in range(300)])
    books = V.fit(df)
    coded = V.decode(V.encode(df, books), books)
    for r in coded.collect():
        assert r["vector"] == [x / 4096 for p in range(8) for x in books.entries[p, int(r["code"][2 * p : 2 * p + 2], 16)].tolist()]
    bad = coded.withColumn("code", F.lit("zz")).limit(1)
    assert V.decode(bad.drop("vector"), books).first()["vector"] is None
    with pytest.raises(ValueError):
        V.fit(df, entries=257)
