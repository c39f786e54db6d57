import zlib

import numpy as np
from conftest import SF

from tidemark.llm import langid, queries
from tidemark.llm.common import table


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op10_langid(spark, sf).toPandas().merge(table(spark, sf, "documents").toPandas(), on="doc_id")
    assert len(got) == 1000
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(got.doc_id, got.held_out))
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98 and got.score.between(0, 1).all() and got.rejected.mean() < 0.01


def test_classification_equals_one_by_one(spark):
    docs = table(spark, SF, "documents")
    model = langid.fit(docs)
    got = {r.doc_id: (r.lang_pred, round(r.score, 9), r.rejected) for r in langid.predict(docs, model).collect()}
    for r in docs.collect():
        v = langid.ngram_counts(r.text) * model.idf
        cosine = [float(v @ c / np.linalg.norm(v)) for c in model.centroids]
        best = int(np.argmax(cosine))
        level = min(23, int(np.log2(langid.ngram_counts(r.text).sum())))
        assert got[r.doc_id] == (model.languages[best], round(min(1, cosine[best]), 9), cosine[best] < model.floors[best][level])


def test_learns_only_from_its_fold_and_text(spark):
    docs = table(spark, SF, "documents").drop("source", "n_chars")
    held = langid.held_out(docs.doc_id)
    from pyspark.sql import functions as F

    changed = docs.withColumn("lang", F.when(held, "zz").otherwise(docs.lang)).withColumn("text", F.when(held, "qqq").otherwise(docs.text))
    a, b = langid.fit(docs), langid.fit(changed)
    assert a.languages == b.languages and np.allclose(a.idf, b.idf) and np.allclose(a.centroids, b.centroids)


def test_rejects_unlearned_languages_code_and_noise(spark):
    rng = np.random.default_rng(3)
    letters = lambda alphabet, n: "".join(rng.choice(list(alphabet), n))
    foreign = {
        "it": "Quando il vento soffia dalle colline gli abitanti del paese chiudono le finestre e aspettano che passi la pioggia. Nessuno ricorda più chi abbia costruito il vecchio ponte, ma tutti lo attraversano ogni giorno per andare al mercato.",
        "pt": "Quando o vento sopra das colinas os moradores da aldeia fecham as janelas e esperam que a chuva passe. Ninguém se lembra de quem construiu a velha ponte, mas todos a atravessam todos os dias para ir à feira.",
        "nl": "Wanneer de wind van de heuvels waait sluiten de bewoners van het dorp hun ramen en wachten zij tot de regen voorbij is. Niemand weet nog wie de oude brug heeft gebouwd, maar iedereen steekt haar elke dag over.",
        "pl": "Kiedy wiatr wieje ze wzgórz mieszkańcy wsi zamykają okna i czekają aż przejdzie deszcz. Nikt już nie pamięta kto zbudował stary most, ale wszyscy codziennie przez niego przechodzą w drodze na targ.",
        "fi": "Kun tuuli puhaltaa kukkuloilta kylän asukkaat sulkevat ikkunansa ja odottavat sateen menevän ohi. Kukaan ei enää muista kuka rakensi vanhan sillan, mutta kaikki kulkevat sen yli joka päivä.",
        "c": "static int cmp(const void *p, const void *q) { return *(const int *)p - *(const int *)q; } int main(void) { int v[64]; for (int i = 0; i < 64; i++) v[i] = rand() % 97; qsort(v, 64, sizeof *v, cmp); printf(\"%d\\n\", v[0]); }",
        "base64": letters("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 600),
        "random": " ".join(letters("abcdefghijklmnopqrstuvwxyz", 7) for _ in range(80)),
    }
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.fit(docs)
    _, score, rejected = langid.classify(model, list(foreign.values()))
    assert rejected.all(), dict(zip(foreign, score))
    held = docs.where(langid.held_out(docs.doc_id)).toPandas()
    assert langid.classify(model, held.text.tolist())[2].mean() < 0.03
    assert len({tuple(f) for f in model.floors}) >= len(set(model.languages))


def test_odd_rows(spark):
    rows = [(i, f"the cat and the dog number{i} are here", "en", 1) for i in range(40)] + [(100 + i, f"der hund und die katze {i} sind da", "de", 1) for i in range(40)]
    rows += [(200, None, "en", 1), (201, "", None, 1), (202, "123 !!! $$", "de", 1), (203, "漢字仮名", None, 1), (None, "the cat", "en", 1), (0, "the dog", "en", 1), (204, "the cat " * 50_000, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = langid.fit(df)
    got = {(r.doc_id, r.lang_pred, r.rejected) for r in langid.predict(df, model).collect()}
    assert {(200, "und", True), (201, "und", True), (202, "und", True), (None, "en", False), (204, "en", False), (100, "de", False)} <= got
    assert next(r for r in got if r[0] == 203)[2]
    kept = langid.keep_identified(df, model)
    assert kept.columns == df.columns and sorted(r.doc_id or -1 for r in kept.collect()) == sorted((r[0] or -1) for r in rows if r[0] not in (200, 201, 202, 203))
    none = langid.fit(df.where("lang = 'xx'"))
    assert {(r.lang_pred, r.score, r.rejected) for r in langid.predict(df, none).collect()} == {("und", 0.0, True)}
    assert langid.predict(df.limit(0), model).count() == 0


def test_numbers_are_no_letters():
    for text in ("½ ²", "①", "Ⅷ", "٣ 12 _", "", None):
        assert not langid.ngram_counts(text).any(), text
    assert langid.ngram_counts("ª é 語").any()
