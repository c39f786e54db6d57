import random

import numpy as np
import xxhash
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import gray_index, queries, simhash
from tidemark.llm.common import table
from tidemark.llm.components import components


def brute_print(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    return sorted((str(i), f"{p:016x}", str(least.get(x))) for (i, _), p, x in zip(rows, prints, label))


def got(df):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in df.collect())


def test_whole_table_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert got(queries.op2_simhash(spark, SF)) == brute(rows)


def test_odd_rows(spark):
    base = "one two three four five six seven eight nine ten"
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A"), (6, base), (6, base), (7, base.upper()), (None, base), (9, "x y"), (None, "é É"), (12, "a b c")]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, code string")
    assert got(simhash.near_duplicates(docs)) == brute(rows)
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "12", "4", "6", "9", "None"]
    assert simhash.near_duplicates(docs.limit(0)).count() == simhash.keep_representatives(docs.limit(0)).count() == 0


def test_links_survive_a_large_cube(spark):
    rng = random.Random(3)
    center = rng.getrandbits(64)
    codes = {center} | {center ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(40)} | {rng.getrandbits(64) for _ in range(500)}
    signed = [(c - (1 << 64) if c >> 63 else c,) for c in codes]
    roots = components(simhash.code_links(spark.createDataFrame(signed, "code long"))).collect()
    assert len(roots) == 1 + 40 * 39 // 2 and len({r.root for r in roots}) == 1


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 200)] + [(300, 300)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(found) == 61 + 100 + 1
    assert len({found[i] for i in range(61)}) == len({found[i] for i in range(100, 200)}) == 1 and len(set(found.values())) == 3
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4095), min_size=1, max_size=60, unique=True), min_size=1, max_size=5), st.integers(0, 3))
def test_gray_index_finds_all_pairs(runs, bits):
    runs = [np.array(r, np.uint64) * np.uint64(0x100200400801) for r in runs]
    runs = [r[np.argsort(gray_index.gray_rank(r))] for r in runs]
    codes, sizes = np.concatenate(runs), np.array([len(r) for r in runs])
    run = np.repeat(np.arange(len(sizes)), sizes)
    found = {(int(i), int(j)) for a, b in gray_index.close_pairs(codes, sizes, bits) for i, j in zip(a, b)}
    want = {(i, j) for j in range(len(codes)) for i in range(j) if run[i] == run[j] and (int(codes[i]) ^ int(codes[j])).bit_count() <= bits}
    assert found == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4095), max_size=90, unique=True), st.lists(st.integers(0, 4095), max_size=300, unique=True), st.integers(0, 3))
def test_gray_index_finds_all_pairs_between_bins(a, b, bits):
    a, b = (np.array(x, np.uint64) * np.uint64(0x100200400801) for x in (a, b))
    a, b = (x[np.argsort(gray_index.gray_rank(x))] for x in (a, b))
    found = [(int(i), int(j)) for p, q in gray_index.close_between(a, b, bits) for i, j in zip(p, q)]
    want = {(i, j) for i in range(len(a)) for j in range(len(b)) if (int(a[i]) ^ int(b[j])).bit_count() <= bits}
    assert len(found) == len(want) and set(found) == want


def test_hierarchy_prunes_whole_groups():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 1 << 63, 1 << 15).astype(np.uint64) * np.uint64(2)
    codes = codes[np.argsort(gray_index.gray_rank(codes))]
    tree = gray_index.Tree(codes)
    seen = [0] * (tree.height + 1)
    list(gray_index.tree_pairs(tree, tree, 2, seen))
    every = [len(x) * (len(x) + 1) // 2 for x, _ in tree.levels]
    assert seen[0] < every[0] / 1000 and sum(seen) < every[0] / 50


def test_links_over_many_bins_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BIN_CODES", 40)
    rng = random.Random(8)
    centers = [rng.getrandbits(64) for _ in range(150)]
    codes = sorted({c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for c in centers for _ in range(5)} | {0, 1, (1 << 64) - 1})
    codes = [c & ((1 << 64) - 1) for c in codes]
    roots = {r.node & ((1 << 64) - 1): r.root & ((1 << 64) - 1) for r in components(simhash.code_links(spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "code long"))).collect()}
    label = {c: c for c in codes}
    for x in codes:
        for y in codes:
            if (x ^ y).bit_count() <= 2 and label[x] != label[y]:
                old, new = label[x], label[y]
                label = {c: new if v == old else v for c, v in label.items()}
    same = lambda f: {frozenset(c for c in codes if f(c) == r) for r in {f(c) for c in codes}}
    assert same(lambda c: roots.get(c, c)) == same(label.get)
