"""LM scoring against counts made directly."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyforge.llm import lm_score

END = None


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w.encode() for w in re.findall("[^\x20\x09-\x0d]+", low)] + [END]


def brute(rows, mu=20.0):
    """As the operator, with exact quantised counts in place of the filter."""
    one, two = Counter(), Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            w = tokens(t)
            one.update(w)
            two.update(zip([END, *w], w, strict=False))
    n, v = sum(one.values()), len(one)
    out = []
    for i, t in rows:
        w, base, score = tokens(t), 0.0, 0.0
        for h, x in zip([END, *w], w, strict=False):
            p1 = (one[x] + 1) / (n + v + 1)
            c = two[h, x]
            q = c.bit_length()
            c = (2 ** (q - 1) + 2**q - 1) / 2 if q else 0
            base += math.log10(p1)
            score += math.log10((min(c, one[h]) + mu * p1) / (one[h] + mu))
        out.append((i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(one[x] > 0 for x in w), n, base, score))
    return sorted(out, key=lambda r: (str(r[0]), r[2], r[5]))


def corpus():
    rnd = random.Random(3)
    vocab = ["".join(rnd.choices("abcdé", k=4)) for _ in range(150)]
    rows = [(i, " ".join(rnd.choices(vocab, weights=range(1, 151), k=rnd.randint(0, 120)))) for i in range(150)]
    return rows + [(200, None), (201, ""), (202, " \t\n"), (None, "No id HERE"), (3, rows[3][1]), (203, "new\x0bwords\xa0here É"), (204, "long text " * 20000)]


def close(got, want):
    got = sorted(map(tuple, got), key=lambda r: (str(r[0]), r[2], r[5]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-12)
    assert np.allclose([r[6] for r in got], [r[6] for r in want], rtol=1e-9)


@pytest.mark.parametrize("max_bytes", [1 << 26, 1 << 13])
def test_equal_to_direct_counts(spark, max_bytes):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, score int, bucket string").repartition(3)
    close(lm_score.lm_scores(docs, bits=64, hashes=8, max_bytes=max_bytes).collect(), brute(rows))


def test_one_slice_is_live_at_a_time(spark, monkeypatch):
    from pyspark import SparkContext
    from pyspark.core.broadcast import Broadcast

    live, most, sent = set(), [], []
    broadcast, destroy = SparkContext.broadcast, Broadcast.destroy

    def made(self, value):
        b = broadcast(self, value)
        if isinstance(value, lm_score.Filter):
            live.add(id(b))
            sent.append((b, len(value.data)))
            most.append(len(live))
        return b

    def gone(self, blocking=False):
        live.discard(id(self))
        return destroy(self, blocking)

    monkeypatch.setattr(SparkContext, "broadcast", made)
    monkeypatch.setattr(Broadcast, "destroy", gone)
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    assert lm_score.lm_scores(docs, max_bytes=1 << 11).count() == len(corpus())
    assert len(sent) > 3 and max(most) == 1 and all(size <= 1 << 11 for _, size in sent)


def test_repeated_chunks(spark):
    """A chunk that the table holds several times gives its rows as often."""
    rows = [(i, f"a b c{i}") for i in range(20)]
    at = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    docs = at.unionByName(at).unionByName(at)
    close(lm_score.lm_scores(docs, bits=64, hashes=8).collect(), brute(rows * 3))


def test_default_filter_is_near_and_beats_the_base(spark):
    """Pairs that follow each other make the model better than single words on held-out rows."""
    rnd = random.Random(8)
    vocab = ["".join(rnd.choices("abcdefg", k=4)) for _ in range(60)]
    rows = []
    for i in range(300):
        k, words = rnd.randrange(60), []
        for _ in range(60):
            words.append(vocab[k])
            k = (k * 7 + rnd.randrange(3)) % 60
        rows.append((i, " ".join(words)))
    got = lm_score.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {r[0]: r for r in brute(rows)}
    held = [r for r in got if r.held_out]
    assert held and all(r.score > r.base_score for r in held)
    assert all(abs(r.score - want[r.doc_id][6]) < 0.02 * abs(r.score) for r in got)


def test_empty_table_and_no_training_rows(spark):
    assert lm_score.lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    i = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    close(lm_score.lm_scores(spark.createDataFrame([(i, "a b")], "doc_id long, text string")).collect(), brute([(i, "a b")]))


def test_filter_never_loses_a_level():
    rnd = np.random.default_rng(5)
    h, n = rnd.integers(0, 2**63, 5000, dtype=np.uint64), rnd.integers(1, 5000, 5000)
    level = lm_score.levels(n)
    f = lm_score.Filter(1, {0: lm_score._bitmap(h, level, 6, 3)}, 3)
    found, here = f.level(h)
    assert here.all() and (found >= level).all() and (found > level).mean() < 0.12
    strange, _ = f.level(rnd.integers(0, 2**63, 5000, dtype=np.uint64))
    assert (strange > 0).mean() < 0.12


def test_default_filter_seldom_finds_what_is_not_there():
    rnd = np.random.default_rng(6)
    h, n = rnd.integers(0, 2**63, 20000, dtype=np.uint64), rnd.integers(1, 50, 20000)
    f = lm_score.Filter(1, {0: lm_score._bitmap(h, lm_score.levels(n), lm_score.BITS, lm_score.HASHES)}, lm_score.HASHES)
    strange = rnd.integers(0, 2**63, 20000, dtype=np.uint64)
    assert (f.level(strange)[0] > 0).mean() < 0.01
    assert not f.level(h, np.zeros(len(h), np.int64))[0].any()
    assert (f.level(h, lm_score.levels(n))[0] == lm_score.levels(n)).all()


def test_unknown_words_never_make_a_known_pair(spark):
    """Even a filter that says yes to half of all pairs gives words never seen in training no count."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(40))) for i in range(60)]
    got = lm_score.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), bits=1, hashes=1).collect()
    want = {r[0]: r[6] for r in brute(rows)}
    held = [r for r in got if r.held_out]
    assert held and all(abs(r.score - want[r.doc_id]) < 1e-6 for r in held)
