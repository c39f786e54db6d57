import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing, queries
from tidemark.llm.common import table

PATH = public_tokenizers.path("word_bpe_49k.json")


def library_ids(texts):
    t = Tokenizer.from_file(PATH)
    return [e.ids + [2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(pieces, ids_of):
    """Every id of every document lies in exactly one piece; sequences are gapless and as long as a power of two."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(docs) == set(ids_of)
    for d, rows in docs.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            ids = ids_of[d][r.start : r.start + r.length]
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids_of[d])
            assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            assert "ids" not in r or r.ids == ids
            at += r.length
        assert at == len(ids_of[d])
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0 and {r.window for r in rows} == {at} and len({r.step_group for r in rows}) == 1
    return sequences


def test_whole_table(spark):
    rows = table(spark, SF, "documents").select("doc_id", "text").collect()
    sequences = check(queries.op12_packing(spark, SF).collect(), dict(zip([r.doc_id for r in rows], library_ids([r.text for r in rows]))))
    windows = Counter(v[0].window for v in sequences.values())
    assert sum(n for w, n in windows.items() if w not in packing.TIERS) <= 12  # only the last windows of the one block


def test_odd_rows(spark):
    texts = [None, "", " ", "a", "word " * 30_000, "same text", "same text", "é 日本 🙂 <|endoftext|>x"]
    rows = [(i, t, 5, "clash", None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int, ids string, window array<int>")
    check(packing.pack(df, PATH).collect(), dict(enumerate(library_ids(texts))))
    small = packing.pack(df, PATH, tiers=(8, 16), block_tokens=32, group_tokens=64).collect()
    assert all(r.window <= 16 for r in small) and sum(r.length for r in small) == sum(map(len, library_ids(texts)))
    nulls = packing.pack(spark.createDataFrame([(None, "a"), (None, "b"), (1, "a"), (1, "a")], "doc_id long, text string"), PATH).collect()
    assert Counter(r.doc_id for r in nulls) == {None: 2, 1: 2} and sum(r.length for r in nulls) == 8
    assert packing.pack(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, PATH, tiers=(100,))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 700), max_size=60), st.sampled_from([(16, 32, 64), (64,), (1, 128)]))
def test_block(lengths, tiers):
    windows = packing.pack_block(lengths, tiers)
    held = Counter((d, i) for w in windows for d, start, n in w for i in range(start, start + n))
    assert held == Counter((d, i) for d, n in enumerate(lengths) for i in range(n))
    sizes = [sum(p[2] for p in w) for w in windows]
    assert all(n & (n - 1) == 0 and n <= tiers[-1] for n in sizes)
    assert sum(n not in tiers for n in sizes) <= tiers[-1].bit_length()


def test_pieces_stay_whole_where_they_fit():
    # 3000 opens a window of 4096 and takes 1000 and 90 whole; 6 ids of the longest open piece close its gap
    windows = packing.pack_block([3000, 1000, 90, 200, 206])
    assert windows[0] == [(0, 0, 3000), (1, 0, 1000), (2, 0, 90), (4, 0, 6)]
    assert windows[1] == [(4, 6, 200), (3, 0, 56)]


def test_step_groups_are_balanced():
    rng = np.random.default_rng(2)
    windows = packing.pack_block(rng.integers(1, 9000, 900).tolist())
    group = packing.step_groups(windows)
    tokens, cost = defaultdict(int), defaultdict(int)
    for w, g in zip(windows, group):
        tokens[g] += sum(p[2] for p in w)
        cost[g] += sum(p[2] ** 2 for p in w)
    assert max(tokens.values()) - min(tokens.values()) <= 4096
    assert max(cost.values()) <= 1.25 * min(cost.values())
    assert packing.step_groups([]) == []
