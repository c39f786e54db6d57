import zlib

import numpy as np
from conftest import SF

from tidemark.llm import queries
from tidemark.llm import toxicity as tox
from tidemark.llm.common import table


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op7_toxicity(spark, sf).toPandas()
    assert len(got) == 10_000 and got.score.between(0, 1).all() and ((got.score >= 0.5) == got.predicted).all()
    m = got.merge(table(spark, sf, "labels").toPandas(), on="doc_id")
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(m.doc_id, m.held_out))
    m = m[m.held_out]
    assert m.predicted[m.toxic == 1].mean() > 0.85 and m.predicted[m.toxic == 0].mean() < 0.02


def test_scores_equal_one_by_one_and_ignore_held_out_labels(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = tox.fit(docs, labels)
    again = tox.fit(docs, labels.withColumn("toxic", tox.F.when(tox.crc_fold(labels.doc_id, 5) == 0, 1 - labels.toxic).otherwise(labels.toxic)))
    assert model.weights == again.weights and np.allclose(model.coefficients, again.coefficients)
    got = {r.doc_id: r.score for r in tox.score(docs, model).collect()}
    for r in docs.collect():
        z = model.coefficients[0] + model.coefficients[1:] @ tox.findings(r.text, tox.Lexicon(model.weights))
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-z))) < 1e-9


def kinds(text):
    x = np.expm1(tox.findings(text, tox.Lexicon({"idiot": 3.0, "foo*": 4.0, "food": -1.0})))
    return {k: round(float(v), 6) for k, v in enumerate(x[: tox.FINDINGS]) if v > 1e-9}


def test_clause_grammar():
    assert kinds("you idiot. nothing here") == {tox.AIMED: 3}
    assert kinds("an idiot walked by") == {tox.PLAIN: 3}
    assert kinds("idiot that you are") == {tox.AIMED: 3}
    assert kinds("he is not an idiot; he said idiot") == {tox.NEGATED: 3, tox.REPORTED: 3}
    assert kinds("not one two three four idiot") == {tox.PLAIN: 3}
    assert kinds("you FOOBAR, the food is good") == {tox.AIMED: 4}
    assert kinds("I will kill you. we kill time") == {4 + tox.AIMED: 1, 4 + tox.PLAIN: 1}
    assert kinds("the food is good") == kinds("") == kinds(None) == {}
    assert len(tox.MACHINE) == 16 * 6


def test_odd_rows(spark):
    bad, fine = "you are an utter vlork today", "you are an utter friend today"
    docs = [(i, bad if i % 4 == 0 else fine, "x") for i in range(400)] + [(1000, None, "x"), (1001, "", "x"), (None, bad, "x"), (0, bad, "x"), (1002, "word " * 60_000 + "vlork", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    model = tox.fit(df, labels)
    got = {r.doc_id: r for r in tox.score(df, model).collect()}
    assert all(got[i].predicted == (i % 4 == 0) for i in range(400)) and got[None].predicted == 1
    assert got[1000].score == got[1001].score < min(0.5, got[1002].score)  # one finding in 60,000 words counts for something
    kept = tox.keep_clean(df, model)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.score < 0.5)
    one = tox.fit(df, labels.where("toxic = 0"))
    assert {r.score for r in tox.score(df, one).collect()} == {0.0}
    assert tox.score(df.limit(0), model).count() == 0


def test_a_stem_goes_whose_exceptions_do_not_fit(spark, monkeypatch):
    rows = [(f"vlork{c} today", 1) for c in "abcdef" for _ in range(4)] + [(f"grimp{c} today", 1) for c in "abcdef" for _ in range(4)]
    rows += [(f"vlork{c * 3} day", 0) for c in "mnopqrst" for _ in range(9)] + [("grimpzz day", 0)] * 9
    df = spark.createDataFrame(rows, "text string, toxic int")
    full = tox._learn_patterns(df, 48, 81)
    stems = [p for p in full if p.endswith("*") and full[p] > 0]
    monkeypatch.setattr(tox, "PATTERNS", 12)
    less = tox._learn_patterns(df, 48, 81)
    kept = [p for p in less if p.endswith("*") and less[p] >= tox.LEAST_WEIGHT]
    assert stems and set(kept) <= set(stems)
    for p, w in full.items():  # all exceptions below a stem that stays are there
        if w < tox.LEAST_WEIGHT and any(p != s and p.startswith(s[:-1]) for s in kept):
            assert p in less
