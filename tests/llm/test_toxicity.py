"""Toxicity: accuracy on rows that training never saw."""

import random
import zlib

import pytest

from tallyforge.llm import toxicity

BAD = ["blorgish", "snarkwit", "grumbledolt"]


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(4)
    vocab = ["".join(rnd.choices(["ta", "re", "mo", "li", "ne", "su"], k=rnd.randint(1, 4))) for _ in range(500)]
    docs, labels = [], []
    for i in range(900):
        words = rnd.choices(vocab, k=rnd.randint(5, 200))
        toxic = i % 5 == 0
        if toxic:
            words[rnd.randrange(len(words))] = rnd.choice(BAD)
        docs.append((i, " ".join(words), "en", 1))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    docs += [(900, None, "en", 1), (901, "", "en", 1), (None, "no id " + BAD[0], "en", 1), (902, "ta " * 50000 + BAD[1], None, 0), (0, docs[0][1], "en", 1)]
    labels += [(903, 1, 1), (1, 1, None), (None, 1, 1), (2, 0, 5)]
    return spark.createDataFrame(docs, "doc_id long, text string, toxic string, score int").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def right(rows):
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.predicted == int(r.doc_id in (None, 902) or (r.doc_id < 900 and r.doc_id % 5 == 0)), r


def test_held_out_rows_are_right(tables):
    docs, labels = tables
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count()
    right(rows)


def test_bounded_sample_and_shuffled_labels(tables):
    docs, labels = tables
    right(toxicity.toxicity(docs, labels, sample=60, broadcast_rows=10).collect())


def test_labels_never_reach_a_score(tables, spark):
    """Labels of held-out rows change nothing."""
    docs, labels = tables
    turned = spark.createDataFrame([(r.doc_id, r.quality, 1 - r.toxic if r.toxic in (0, 1) and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1 else r.toxic) for r in labels.collect()], labels.schema)
    score = lambda y: sorted((str(r.doc_id), round(r.score, 9)) for r in toxicity.toxicity(docs, y).collect())
    assert score(labels) == score(turned)


def test_without_labels_or_rows(tables, spark):
    docs, labels = tables
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    one = toxicity.toxicity(docs, labels.filter("toxic = 1")).collect()
    assert len({r.score for r in one}) == 1 and one[0].score > 0.5


def test_every_significant_ngram_is_kept():
    """No cap on features drops n-grams that stand out; buckets grow with the training texts."""
    import numpy as np

    n = 1 << 17
    p, q = np.zeros(n, np.int64), np.zeros(n, np.int64)
    p[:40_000], q[60_000:] = 130, 400
    kept, r = toxicity.ratios(p, q, 50_000, 400_000, toxicity.LEAST_Z)
    assert {*range(40_000)} <= {*kept.tolist()} and len(r) == len(kept)
    assert [toxicity.bits_for(x) for x in (0, 1 << 25, 232_000_000, 1 << 40)] == [20, 20, 22, 24]


def test_model_recomputed_from_strings(tables, spark):
    """Counts, ratios, selection, fit and scores from n-grams as strings, without the operator's arrays."""
    import math

    docs, labels = tables
    docs = docs.unionByName(spark.createDataFrame([(i, f"1d10t @SS f*ck no {i % 3}", "en", 1) for i in range(1000, 1040)] + [(i, f"ok \u00c9t\u00e9 no\t {i % 3}", "en", 1) for i in range(1040, 1080)], docs.schema))
    labels = labels.unionByName(spark.createDataFrame([(i, 1, int(i < 1040)) for i in range(1000, 1080)], labels.schema))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    least_z, bits, ridge = 3.5, 24, 0.1

    def ngrams(t):
        t = " " + " ".join(t.lower().split()) + " "
        return {t[i : i + n] for n in (4, 5, 6) for i in range(len(t) - n + 1)}

    truth = {}
    for r in labels.collect():
        if r.toxic in (0, 1) and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.doc_id in texts:
            truth[r.doc_id] = max(r.toxic, truth.get(r.doc_id, 0))
    rows = [r.doc_id for r in docs.collect() if r.doc_id in truth]  # repeated rows count each
    size = [sum(truth[i] == k for i in rows) for k in (0, 1)]
    count = {}
    for i in rows:
        for g in ngrams(texts[i]):
            count.setdefault(g, [0, 0])[truth[i]] += 1
    ratio = {}
    for g, (q, p) in count.items():
        r = math.log((p + 1) / (size[1] + 1)) - math.log((q + 1) / (size[0] + 1))
        if abs(r) >= least_z * math.sqrt(1 / (p + 1) + 1 / (q + 1)):
            ratio[g] = r
    assert "1d10t" in ratio and "*ck " in ratio
    weights, intercept = toxicity.train(docs, labels, bits=bits, least_z=least_z, ridge=ridge)
    by_bucket = {}
    for g in ratio:
        by_bucket.setdefault(int(bucket_of(g, bits)), []).append(g)
    alone = {b: g[0] for b, g in by_bucket.items() if len(g) == 1}
    assert len(alone) > 0.99 * len(ratio)
    # at the weights, w = weight / ratio for each n-gram, the loss is flat beside what it is at zero
    w = {g: weights[b] / ratio[g] for b, g in alone.items()}
    score = lambda i: intercept + sum(float(weights[b]) for b, g in by_bucket.items() if any(x in grams[i] for x in g))
    grams = {i: ngrams(texts[i]) for i in texts}
    z = {i: score(i) for i in texts}
    error = {i: (1 / (1 + math.exp(-z[i])) - truth[i]) * 0.5 / size[truth[i]] for i in truth}
    first = {i: (0.5 - truth[i]) * 0.5 / size[truth[i]] for i in truth}
    steep = max(abs(ratio[g] * sum(first[i] for i in rows if g in grams[i])) for g in sorted(w)[:: max(1, len(w) // 200)])
    assert abs(sum(error[i] for i in rows)) < 0.01 * steep
    for g in sorted(w)[:: max(1, len(w) // 200)]:
        gradient = ratio[g] * sum(error[i] for i in rows if g in grams[i]) + ridge / len(rows) * w[g]
        assert abs(gradient) < 0.01 * steep, g
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels, bits=bits, least_z=least_z, ridge=ridge).collect()}
    assert all(abs(got[i] - 1 / (1 + math.exp(-z[i]))) < 1e-3 for i in got)


def bucket_of(gram, bits):
    """The bucket of one n-gram, by plain integers."""
    h = 0
    for c in gram:
        h = (h * 0x01000193 + ord(c) + 1) % 2**32
    return ((h ^ h >> 15) * 0x9E3779B1 + len(gram) * 0x85EBCA6B) % 2**32 >> 32 - bits


def test_fit_in_parts_is_the_fit_at_once(monkeypatch):
    import numpy as np

    rnd = np.random.default_rng(2)
    rows = [np.unique(rnd.integers(0, 50, rnd.integers(0, 20))).astype(np.int32) for _ in range(80)]
    y, r = np.arange(80) % 2, rnd.normal(size=50)
    whole = toxicity.fit(rows, y, r, 0.1)
    monkeypatch.setattr(toxicity, "_TOGETHER", 30)
    parts = toxicity.fit(rows, y, r, 0.1)
    assert np.allclose(whole[0], parts[0], atol=1e-4) and abs(whole[1] - parts[1]) < 1e-4
