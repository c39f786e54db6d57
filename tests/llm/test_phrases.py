"""Phrases against a plain count of every gram."""

import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import phrases
from tidemark.llm.common import staged

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, n int, w1 string, phrase string, score double"


def pieces_of(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        if words := re.findall(r"[^\x20\x09]+", piece):
            yield words


def grams(rows):
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        total[lang] += 0
        for ws in pieces_of(text):
            total[lang] += len(ws)
            for k in range(1, 5):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    return f, total


def brute(rows, least, top):
    f, total = grams(rows)
    out = []
    for lang, count in f.items():
        good = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in good.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in good.items()):
                continue
            score, k = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, t, y, 1, "x", "y", 0.5) for i, (t, y) in enumerate(rows)], SCHEMA).repartition(3)


ODD = [
    (None, "en"), ("", "en"), ("...,,;", None), ("a b c d e f g h A B C D E F G H a b c d e f g h", None), ("a b c d e f g h", "und"),
    ("x x x x x x x", "en"), ("the same passage of words stands here", "en"), ("the same passage of words stands here\nthe same passage", "en"),
    ("É é b\tc d\x0be f\x00g h É é b\tc", "fr"), ("one two three. one two three! one two, three one two three four", "en"),
    ("p q r p q r p q r p q r p q", "en"), ("of the of the of the of the of the end of the of", "de"), ("word " * 3000, "en"), ("日本 語 日本 語 日本 語", "ja"),
]


@pytest.mark.parametrize("least", [2, 3])
def test_mine_equals_brute_force(spark, least):
    rows = ODD + ODD[5:9]
    assert sorted(map(tuple, phrases.mine(table(spark, rows), least).collect())) == brute(rows, least, 2000)


def test_top_and_empty_tables(spark):
    assert sorted(map(tuple, phrases.mine(table(spark, ODD), 2, 3).collect())) == brute(ODD, 2, 3)
    assert phrases.mine(table(spark, []), 2).count() == 0 == phrases.mine(table(spark, [(None, None), ("", "en")]), 2).count()


def test_flow_gives_all_counts_and_paths_all_edges(spark):
    graph = staged(phrases.edges(table(spark, ODD), 2), "test-graph")
    counts = staged(phrases.counts(graph, 2), "test-counts")
    f, total = grams(ODD)
    want = {(lang, " ".join(p)): a for lang, c in f.items() for p, a in c.items() if a >= 2}
    assert {(r.lang, r.phrase): r.n for r in counts.collect()} == want
    assert {r.lang: r.n for r in graph.where("w1 IS NULL").collect()} == total
    paths = phrases.paths(counts).collect()
    seen = Counter((r.lang, " ".join(r.words[i : i + 4])) for r in paths for i in range(len(r.words) - 3))
    assert max(seen.values()) == 1
    for r in paths:
        assert all(want[r.lang, " ".join(r.words[i : i + 4])] == r.n for i in range(len(r.words) - 3))
        assert all(want[r.lang, " ".join(r.words[i : i + 3])] == r.n for i in range(1, len(r.words) - 3))
    assert set(seen) == {k for k in want if k[1].count(" ") == 3}
    assert max(len(r.words) for r in paths) > 5  # inner nodes of the repeated passage are compacted


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcde"), max_size=30), max_size=6), st.integers(16, 18), st.integers(1, 4))
def test_counters_never_lose_a_frequent_gram(texts, bits, least):
    import numpy as np

    texts = [" ".join(t).replace("e", ".") for t in texts]
    group = phrases._Group("x", [t.encode() for t in texts], phrases._byte_table())
    counters = np.zeros(1 << bits, np.uint8)
    group.count_into(counters, bits)
    columns, n = group.grams(np.packbits(counters >= least, bitorder="little"), bits)
    got = Counter()
    for *gram, times in zip(*columns, n.tolist()):
        ws = [group.words[i].decode() for i in gram if i]
        for k in range(1, len(ws) + 1):
            got[tuple(ws[:k])] += times
    want = grams([(t, "x") for t in texts])[0]["x"]
    assert all(got[p] == a for p, a in want.items() if a >= least) and all(want[p] >= a for p, a in got.items())


def test_products_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    rows = [("en", "a b", 2, big), ("en", "a", 1, big), ("en", "b", 1, big)]
    got = phrases.scored(spark.createDataFrame(rows, "lang string, phrase string, size int, n long")).collect()
    assert [(r.a, r.k, r.score) for r in got] == [(big, 1, 1_000_000)]
