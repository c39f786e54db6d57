import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import importance, queries
from tidemark.llm import quality_rules as qr
from tidemark.llm.common import table, top_by


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def mcd(rows):
    """Concentration steps over rows in memory."""
    x = np.array(rows)
    spread = np.maximum((np.quantile(x, 0.75, axis=0) - np.quantile(x, 0.25, axis=0)) / 1.349, qr.FLOOR)
    mean, inverse = np.median(x, axis=0), np.diag(1 / spread**2)
    core = qr.CORE / qr.chi2_cdf(qr.chi2_quantile(qr.CORE, qr.P), qr.P + 2)
    distance = lambda: np.einsum("ni,ij,nj->n", x - mean, inverse, x - mean)
    for step in range(qr.STEPS + 1):
        last = step == qr.STEPS
        limit = qr.chi2_quantile(0.975, qr.P) if last else np.quantile(distance(), qr.CORE)
        near = x[distance() <= limit]
        mean = near.mean(axis=0)
        cov = np.cov(near.T, bias=True) * (0.975 / qr.chi2_cdf(limit, qr.P + 2) if last else core)
        cov[np.diag_indices(qr.P)] = np.maximum(np.sqrt(np.diag(cov)), qr.FLOOR) ** 2
        value, vector = np.linalg.eigh(cov)
        inverse = vector / np.maximum(value, 1e-4) @ vector.T
    return np.sqrt(distance())


def test_statistics_of_a_whole_table(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    got = queries.op9_quality_rules(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id])
        assert not (r.kept and r.base_failed)


def test_estimates_equal_those_in_memory_and_reject_junk(spark):
    stats = qr.base(table(spark, "/root/testdata/sf0.01", "documents")).toPandas()
    got = queries.op9_quality_rules(spark, "/root/testdata/sf0.01").toPandas()
    sound = stats[~stats.base_failed & (stats.lang == "de")]
    small = sound.groupby("source").filter(lambda g: len(g) < qr.MIN_ROWS)
    mine = dict(zip(sound.doc_id, mcd(sound[list(qr.FEATURES)].to_numpy())))
    both = got.set_index("doc_id").distance
    assert np.median([abs(both[i] / mine[i] - 1) for i in small.doc_id]) < 0.1
    labels = table(spark, "/root/testdata/sf0.01", "labels").toPandas()
    kept = got.merge(labels, on="doc_id").groupby("quality").kept.mean()
    assert kept[1] > 0.95 and kept[0] < 0.4


def test_junk_that_passes_the_base_rules_is_rejected(spark):
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels")
    got = queries.op9_quality_rules(spark, sf).where("not base_failed").join(labels, "doc_id").toPandas()
    kept = got.groupby("quality").kept.mean()
    assert (got.quality == 0).sum() > 250 and kept[0] < 0.05 and kept[1] > 0.98


def test_odd_rows_and_large_source(spark):
    rng = random.Random(1)
    good = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(2, 8) + str(rng.randint(0, 999)) for _ in range(rng.randint(80, 200))), "x", "big") for i in range(150)]
    odd = [(200, None, None, None), (201, "", "x", None), (202, "one two", "y", "s"), (203, " ".join(f"|w{i}|###&&&" for i in range(120)), "x", "big"), (203, "é " * 50, None, "s")]
    df = spark.createDataFrame([(*r, 1, True) for r in good + odd], "doc_id long, text string, lang string, source string, n_words int, kept boolean")
    got = qr.apply_rules(df).collect()
    assert len(got) == 155 and sum(r.kept for r in got) == 150 and not any(r.kept for r in got if r.doc_id >= 200)
    tiny = {r.doc_id: (r.kept, r.distance) for r in qr.apply_rules(df.where("doc_id < 20")).collect()}
    assert set(tiny.values()) == {(True, None)}  # too few rows for an estimate
    assert qr.apply_rules(df.limit(0)).count() == 0


def test_chi_squared():
    assert qr.chi2_quantile(0.975, 5) == pytest.approx(12.8325, abs=1e-4) and qr.chi2_cdf(11.0705, 5) == pytest.approx(0.95, abs=1e-5)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_repeated_words(ids):
    assert qr.repeated_words(np.array(ids, np.int64)) == brute(" ".join(map(str, ids)))[4]


def test_importance_separates_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op3_importance(spark, sf)
    pdf = got.toPandas()
    docs = table(spark, sf, "documents").toPandas()
    assert len(pdf) == len(docs)
    ratio, share = importance.fit(table(spark, sf, "documents"), table(spark, sf, "labels"))
    assert pdf.kept.sum() >= round(share * len(docs)) and pdf.noisy[pdf.kept].min() >= pdf.noisy[~pdf.kept].max()
    hashes = importance.WordHashes()
    text = docs.set_index("doc_id").text
    for r in pdf.head(30).itertuples():
        assert r.log_weight == pytest.approx(sum(ratio[b] for b in importance.ngram_buckets(text[r.doc_id].encode(), hashes)))
    labels = table(spark, sf, "labels").withColumn("held", importance.crc_fold(F.col("doc_id"), 5) == 0).toPandas()
    m = pdf.merge(labels[labels.held], on="doc_id")
    assert m[m.quality == 1].kept.mean() > 0.9 and m[m.quality == 0].kept.mean() < 0.4


def test_importance_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = [(1, "good plain words", "z"), (2, "$$$ ###", "z"), (3, "good words again", "z"), (4, None, "z"), (5, "", "z"), (None, "good", "z"), (1, "good plain words", "z")]
    df = spark.createDataFrame(docs, "doc_id long, text string, target string")
    got = importance.resample(df, labels).collect()
    assert len(got) == 7 and {r.log_weight for r in got if r.doc_id in (4, 5)} == {0.0}
    assert all(r.kept for r in importance.resample(df, labels.where("quality = 0")).collect())
    assert importance.resample(df.limit(0), labels).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-(1 << 63), (1 << 63) - 1), min_size=1, max_size=30), st.integers(1, 30))
def test_kth_largest(spark, values, k):
    df = spark.createDataFrame([(v,) for v in values], "x long").coalesce(1)
    assert top_by(df, "x", k) == (sorted(values, reverse=True)[k - 1] if k <= len(values) else None)
