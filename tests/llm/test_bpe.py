import copy
import hashlib

import public_tokenizers
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe, queries
from tidemark.llm.common import table

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "hello world", "Hello   WORLD's it'LL  don't!!! 3.14 a1b2", "ΑΣ ΣΑΣ İstanbul ǅ ﬁn", "été café", "日本語テキスト 🙂🙂👩‍👩‍👧",
    "<|startoftext|>abc<|endoftext|> <|x|>", "\x00\x1c\x1d \x85　x​y", "aaaaaaaaaaaaaaaa abababababab bababa", "x" * 3000, "½ ² Ⅷ ٣ १२", "same", "same", "a\x1cb \x1d!\x1e! c", "é́ ́a", "ſ K Å", "<|startoftext|><|endoftext|>x<|startoftext|", "'S don'T we'Ve", "<|STARTOFTEXT|> x<|EndOfText|>y", "<|endoftext|> a<|startoftext|> " * 50,
]


def expected(text):
    t = Tokenizer.from_file(PATH)
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


def test_ids_and_text_equal_the_library(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in bpe.encode(docs, PATH).collect()}
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    for i, t in enumerate(TEXTS):
        assert (got[i], back[i]) == expected(t), t


def test_whole_table_equals_the_library(spark):
    docs = table(spark, SF, "documents").toPandas()
    got = queries.op1_bpe(spark, SF).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, text in zip(docs.doc_id, docs.text):
        ids, back = expected(text)
        assert tuple(got.loc[i]) == (len(ids), sha(" ".join(map(str, ids))), sha(back))


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(open(PATH, encoding="utf-8").read())


def by_hand(vocabulary, merges, word):
    """The lowest rank first, leftmost place first."""
    raw = word.encode()
    ids = [int(vocabulary.plain[b]) for b in raw[:-1]] + [int(vocabulary.last[raw[-1]])]
    ranks = {(a, b): (r, new) for r, (a, b, new) in enumerate(merges)}
    while True:
        found = min(((*ranks[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks), default=None)
        if found is None:
            return ids
        ids[found[2] : found[2] + 2] = [found[1]]


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_index_equals_merging_by_hand(vocabulary, data):
    symbols = [int(vocabulary.plain[97]), int(vocabulary.plain[98]), int(vocabulary.last[97]), int(vocabulary.last[98])]
    merges = []
    for new in range(90_000, 90_000 + data.draw(st.integers(1, 12))):
        pair = data.draw(st.tuples(st.sampled_from(symbols), st.sampled_from(symbols)))
        if pair not in {m[:2] for m in merges}:
            merges.append((*pair, new))
            symbols.append(new)
    words = data.draw(st.lists(st.text("ab", min_size=1, max_size=14), max_size=8))
    other = copy.copy(vocabulary)
    other.set_merges(merges)
    assert other.encode_words(words) == [by_hand(vocabulary, merges, w) for w in words]


def test_memo_starts_anew(spark, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_PIECES", 3)
    encoder = bpe.Encoder(bpe.Vocabulary(open(PATH, encoding="utf-8").read()))
    for part in (TEXTS[:5], TEXTS[3:9], TEXTS, [None, ""], TEXTS[::-1]):
        for t, at in zip(part, encoder.number(t or "" for t in part)):
            assert encoder.ids_of(at).tolist() == expected(t)[0], t


def test_merges_that_use_later_symbols_are_refused(vocabulary):
    with pytest.raises(ValueError, match="later merge"):
        copy.copy(vocabulary).set_merges([(1, 90_001, 90_000), (1, 2, 90_001)])


def test_empty_table_and_unknown_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(none, PATH).count() == bpe.encode(none, PATH).count() == 0
    assert [r.text for r in bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH).collect()] == [""]
    with pytest.raises(KeyError):
        bpe.Vocabulary(open(PATH, encoding="utf-8").read()).decode([10**6])
