from collections import Counter

import corpus_pipeline as pipeline
import numpy as np
from conftest import SF
from test_bpe import expected
from test_mixing import levelled
from test_simhash import brute

from tidemark.llm import langid, toxicity
from tidemark.llm.common import staged, table, word_count


def rows(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_stages_against_brute_force(spark):
    first = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    docs, seen = first, [first]
    for name, stage in pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), name)
        seen.append(docs)
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == first.columns
    start, identified, clean, single, mixed, ids = seen
    model = langid.fit(first)
    assert sorted(rows(identified)) == sorted(r for r in rows(start) if not langid.classify(model, [r[1]])[2][0])
    model = toxicity.fit(first, labels)
    lexicon = toxicity.Lexicon(model.weights)
    assert sorted(rows(clean)) == sorted(r for r in rows(identified) if model.score(np.array([toxicity.findings(r[1], lexicon)]))[0] < 0.5)
    assert clean.count() < identified.count()
    assert sorted(str(r[0]) for r in rows(single)) == sorted({c for _, _, c in brute([r[:2] for r in rows(clean)])})
    size = {r.doc_id: r.n for r in single.select("doc_id", word_count(single.text).alias("n")).collect()}
    taken, sizes = Counter(), Counter()
    for i, _, s in rows(single):
        sizes[s] += size[i]
    for i, _, s in rows(mixed):
        taken[s] += size[i]
    for s, want in levelled(sizes).items():
        assert abs(taken[s] - want) <= 0.3 * want
    assert max(Counter(r[0] for r in rows(mixed)).values()) == 2
    texts = {r[0]: r[1] for r in rows(single)}
    assert Counter(r.doc_id for r in ids.collect()) == Counter(r[0] for r in rows(mixed))
    for r in ids.collect():
        assert (r.n_tokens, r.ids) == (len(r.ids), expected(texts[r.doc_id])[0])
    assert Counter(r.doc_id for r in pipeline.run(spark, SF).collect()) == Counter(r.doc_id for r in ids.collect())


def test_odd_rows_and_empty_tables(spark):
    first = table(spark, SF, "documents")
    text = first.where("lang = 'en'").orderBy("doc_id").first().text
    odd = [(None, text, None, None, None), (1, None, "en", "a", 0), (2, "", None, None, None), (3, " \n", "xx", "b", 1), (4, "12 34", "en", "b", 2), (5, text * 30, "en", None, 3)]
    odd += [(6, text, "en", "b", 4), (6, text, "en", "b", 4), (7, text, "de", "c", 5)]
    docs = spark.createDataFrame(odd, first.schema)
    seen = []
    for rows_in in (docs, docs.limit(0)):
        for name, stage in pipeline.STAGES:
            rows_in = staged(stage(spark, rows_in, SF), name)
            seen.append(sorted({str(r.doc_id) for r in rows_in.collect()}))
    kept = seen[: len(pipeline.STAGES)]
    assert not {"1", "2", "3", "4"} & set(kept[0]) and set(kept[2]) <= set(kept[1]) <= set(kept[0])  # what has no letters is rejected
    assert set(kept[4]) == set(kept[3]) <= set(kept[2]) and not any(seen[len(kept) :])
