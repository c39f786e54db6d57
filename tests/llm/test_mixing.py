import re
from collections import Counter

import pytest
from check_oracles import compare, connect
from conftest import SF

from tidemark.llm import mixing, queries


def levelled(sizes):
    """Shares by weight with the excess dealt again until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, full, out = 1.5 * sum(sizes.values()), set(), dict.fromkeys(order, 0.0)
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        out = {s: 2.0 * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in open_) for s in order}
        above = {s for s in open_ if out[s] > 2 * sizes[s]}
        if not above:
            return out
        full |= above


def check(rows, docs):
    sizes = Counter()
    words = {}
    for i, text, source in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] += n
        words.setdefault((i, n), source)
    want = levelled(sizes)
    taken = Counter()
    for r in rows:
        s = words[r.doc_id, r.size]
        assert (r.source_size, r.target) == (sizes[s], pytest.approx(want[s]))
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    assert len(rows) == len(docs)
    return taken, want


def test_query_against_oracle_and_levels(spark):
    con = connect(SF)
    got = queries.op4_mixing(spark, SF)
    assert compare(got.toPandas(), con.execute(queries.ORACLES["op4_mixing"]).fetchdf()) is None
    taken, want = check(got.collect(), con.execute("SELECT doc_id, text, source FROM documents").fetchall())
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.2 * t  # ten documents a source
    assert sorted(got.collect()) == sorted(queries.op4_mixing(spark, SF).collect())


def test_odd_rows(spark):
    docs = [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, "s"), (3, "", None), (None, "x y", None), (None, "p q r s", None), (4, "w " * 500, "big"), (5, "é ", "ß")]
    docs += [(i, "one two three", "s") for i in range(10, 60)]
    df = spark.createDataFrame([(*d, 1, True) for d in docs], "doc_id long, text string, source string, size int, open boolean")
    rows = mixing.assign(df).collect()
    taken, want = check(rows, docs)
    words = {i: s for i, _, s in docs}
    for s in want:
        assert abs(taken[s] - want[s]) <= max(n for n, x in ((r.size, words[r.doc_id]) for r in rows) if x == s)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    n = Counter(r.doc_id for r in mixed.collect())
    for r in rows:
        if r.size and r.doc_id not in (None, 1):
            assert n[r.doc_id] * r.size == r.taken
    assert mixing.assign(df.limit(0)).count() == mixing.mix(df.limit(0)).count() == 0


def test_all_texts_empty(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in mixing.assign(df).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
