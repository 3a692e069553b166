"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the character n-grams of the lower-cased text with a blank before and after it, letters, digits and signs of
any script alike; only a run of blanks counts as one. They are hashed into 2**bits buckets; what counts is whether a text
has one. For each bucket the labelled training texts of either class that have it are counted over all of them, which
gives its log-count ratio r = log((p + 1) / (P + 1) / ((q + 1) / (Q + 1))). Buckets whose ratio stands out from its
sampling error by `least_z` are kept, all of them; the number of buckets grows with the bytes of the training texts, from
2**20 to 2**24. A logistic regression is fitted on these features, each scaled by its ratio, on a bounded sample of the
training texts: the `sample` texts of each class with the least hash of their id. Every text is then scored whole.

The counts of a task are one array of 2**bits pairs, summed by section; ratios and weights are as many numbers, and the
sample is bounded by parameters, so nothing that the driver sees grows with the corpus.

Nulls: a null text is empty; its score is what the absence of all features gives. A null label, or one beside 0 and 1,
is no label; a document with several labels is toxic if one says so. Without both classes every score is the share of
toxic labels (0.5 without labels). Repeated rows each give a row. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, text_of

ORDERS, BITS, MOST_BITS, LEAST_Z, SAMPLE, RIDGE, THRESHOLD = (4, 5, 6), 20, 24, 3.5, 2048, 0.1, 0.7
#: Training bytes for each bucket, between BITS and MOST_BITS.
BUCKET_BYTES = 64
#: Features of the sample that a step of the fit looks at together.
_TOGETHER = 1 << 20
_SECTIONS = 16
_GAPS = re.compile(r"\s{2,}|[^\S ]")  # a single blank stays as it is
#: Label rows up to which they are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def grams(text: str) -> str:
    """The text whose windows are the n-grams."""
    return f" {_GAPS.sub(' ', text.lower()).strip()} "


def buckets(text: str, orders=ORDERS, bits: int = BITS) -> np.ndarray:
    """The bucket of each n-gram of the text, of each order in turn."""
    b = np.frombuffer(grams(text).encode("utf-32-le", "surrogatepass"), np.uint32)
    h, out = np.zeros(len(b), np.uint32), []
    for n in range(1, max(orders) + 1):
        if len(b) < n:
            break
        h = h[: len(b) - n + 1] * np.uint32(0x01000193) + b[n - 1 :] + np.uint32(1)
        if n in orders:
            out.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def bits_for(size: int) -> int:
    """Bits of a bucket for training texts of so many bytes."""
    return min(MOST_BITS, max(BITS, (size // BUCKET_BYTES).bit_length()))


def once(found: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Each bucket of found once; seen: a scratch array with a place for every bucket."""
    at = np.arange(len(found), dtype=np.int32)
    seen[found] = at
    return found[seen[found] == at]


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, text, toxic of the documents that have a label and aren't held out."""
    y = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).filter(~held_out(F.col("doc_id")))
    few = labels.limit(broadcast_rows + 1).count() <= broadcast_rows
    return rows.join(F.broadcast(y) if few else y, "doc_id")


def class_counts(train: DataFrame, bits: int, orders) -> DataFrame:
    """section, counts: how many texts of either class have each bucket, 2**bits / sections pairs at a time."""
    schema, size = "section int, counts binary", 1 << bits

    def count(batches):
        counts, n, seen = np.zeros((2, size), np.int32), np.zeros(2, np.int64), np.zeros(size, np.int32)
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[y, once(buckets(text, orders, bits), seen)] += 1
                n[y] += 1
        if n.any():
            yield out([*np.split(counts, _SECTIONS, axis=1), n])

    def out(parts):
        z = zstandard.ZstdCompressor(level=1)
        return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([z.compress(np.ascontiguousarray(x, np.int64).tobytes()) for x in parts])], ["section", "counts"])

    def add(batches):
        total = {}
        for b in batches:
            for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.int64)
                total[s] = total[s] + x if s in total else x
        z = zstandard.ZstdCompressor(level=1)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array([z.compress(x.tobytes()) for x in total.values()])], ["section", "counts"])

    return train.select("text", "toxic").mapInArrow(count, schema).repartition(_SECTIONS + 1, "section").mapInArrow(add, schema)


def ratios(p: np.ndarray, q: np.ndarray, n_p: int, n_q: int, least_z: float) -> tuple[np.ndarray, np.ndarray]:
    """The kept buckets and their log-count ratios."""
    r = np.log((p + 1) / (n_p + 1)) - np.log((q + 1) / (n_q + 1))
    z = np.abs(r) / np.sqrt(1 / (p + 1) + 1 / (q + 1))
    kept = np.flatnonzero(z >= least_z)
    return kept, r[kept]


def fit(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, ridge: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights of the ratio-scaled features and the intercept: logistic loss, both classes weighed alike, ridge penalty."""
    n, lengths = len(rows), np.array([len(x) for x in rows])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    r32, parts = r.astype(np.float32), []
    some = np.flatnonzero(lengths)  # texts without any feature only meet the intercept
    for own in np.split(some, np.flatnonzero(np.diff(np.cumsum(lengths[some]) // _TOGETHER)) + 1):
        if len(own):
            parts.append((own, lengths[own], np.cumsum(lengths[own]) - lengths[own], np.concatenate([rows[i] for i in own])))
    w, b, v, vb, t = np.zeros(len(r)), 0.0, np.zeros(len(r)), 0.0, 1.0
    norm = np.ones(n)
    for own, _, starts, index in parts:
        norm[own] += np.add.reduceat(r32[index] ** 2, starts)
    step = 1 / (0.25 * float((weight * norm).sum()) + ridge / n)  # from a bound of the loss's curvature
    for _ in range(steps):  # accelerated gradient
        rv, z = (r * v).astype(np.float32), np.full(n, vb)
        for own, _, starts, index in parts:
            z[own] += np.add.reduceat(rv[index], starts)
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gw = np.zeros(len(r))
        for own, many, _, index in parts:
            gw += np.bincount(index, np.repeat(g[own], many), len(r))
        gw = r * gw + ridge / n * v
        w2, b2 = v - step * gw, vb - step * g.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


def train(docs: DataFrame, labels: DataFrame, orders=ORDERS, bits: int | None = None, least_z: float = LEAST_Z, sample: int = SAMPLE, ridge: float = RIDGE, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> tuple[np.ndarray, float]:
    """(weight of each bucket, intercept). bits: by default as many as the training texts ask for."""
    rows = labelled(docs, labels, id_col, text_col, broadcast_rows)
    if bits is None:
        bits = bits_for(rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0])
    unpack = lambda x: np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(x)), np.int64)
    sections = {r.section: bytes(r.counts) for r in class_counts(rows, bits, orders).collect()}  # 2**bits pairs
    weights = np.zeros(1 << bits, np.float32)
    if not sections:
        return weights, 0.0
    n_q, n_p = (int(x) for x in unpack(sections[_SECTIONS]))
    if not n_p or not n_q:
        share = (n_p + 1) / (n_p + n_q + 2)
        return weights, float(np.log(share / (1 - share)))
    found = []
    for k in range(_SECTIONS):
        q, p = unpack(sections.pop(k)).reshape(2, -1)
        at, own = ratios(p, q, n_p, n_q, least_z)
        found.append((at + k * len(p), own))
    kept, r = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(kept):
        return weights, float(np.log(n_p / n_q))
    place = np.full(1 << bits, -1, np.int32)
    place[kept] = np.arange(len(kept))
    sent = docs.sparkSession.sparkContext.broadcast(place)

    def present(batches):
        for b in batches:
            found = [(lambda x: np.unique(x[x >= 0]).tobytes())(sent.value[buckets(t, orders, bits)]) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(found, pa.binary())], ["toxic", "found"])

    hashed = rows.withColumn("h", F.xxhash64("doc_id"))
    chosen, y = [], []
    for kind, n in ((1, n_p), (0, n_q)):
        own = hashed.filter(F.col("toxic") == kind)
        if n > sample:
            last = own.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
            own = own.filter(F.col("h") <= last)
        found = own.select("text", "toxic").mapInArrow(present, "toxic int, found binary").limit(sample).toArrow().column("found")
        chosen += [np.frombuffer(x.as_buffer(), np.int32) for x in found]
        y += [kind] * len(found)
    w, b = fit(chosen, np.array(y), r, ridge)
    weights[kept] = w * r
    return weights, float(b)


class Model:
    """The kept buckets with their weights, and the intercept; workers make the tables that a look-up needs."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.bits, self.intercept = len(weights).bit_length() - 1, intercept
        self.kept = np.flatnonzero(weights).astype(np.uint32)
        self.weights = weights[self.kept].astype(np.float64)

    def tables(self):
        """(a bit a bucket: whether it is kept; places of kept buckets; a scratch array)."""
        if "_tables" not in self.__dict__:
            marks, place = np.zeros(1 << self.bits, bool), np.zeros(1 << self.bits, np.int32)
            marks[self.kept], place[self.kept] = True, np.arange(len(self.kept))
            self._tables = np.packbits(marks, bitorder="little"), place, np.zeros(max(1, len(self.kept)), np.int32)
        return self._tables

    def score(self, text: str, orders=ORDERS) -> float:
        marks, place, seen = self.tables()  # the bits fit a processor's cache, the places are read for what is kept
        found = buckets(text, orders, self.bits)
        hit = (marks[found >> np.uint32(3)] >> (found & np.uint32(7)).astype(np.uint8)) & 1 == 1
        z = self.intercept + float(self.weights[once(place[found[hit]], seen)].sum())
        return 1 / (1 + np.exp(-z)) if z > -700 else 0.0


def scorer(spark, model: tuple[np.ndarray, float], orders=ORDERS):
    """A function from a text column to the column of its scores."""
    sent = spark.sparkContext.broadcast(Model(*model))

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series([sent.value.score(t or "", orders) for t in text], dtype="float64")

    return score


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted."""
    score = scorer(docs.sparkSession, train(docs, labels, id_col=id_col, text_col=text_col, **how), how.get("orders", ORDERS))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score(text_of(text_col)).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def kept_rows(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows predicted toxic; all columns stay."""
    score = scorer(docs.sparkSession, train(docs, labels, id_col=id_col, text_col=text_col))
    return docs.filter(score(text_of(text_col)) < threshold)


def op9_toxicity(spark, sf_dir):
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
