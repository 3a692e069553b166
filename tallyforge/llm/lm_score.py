"""LM scoring with a log-frequency Bloom filter.

The model is a bigram model learned from the training documents. Counts of word pairs are quantised to levels,
1 + floor(log2 count), and a pair of level q is put into a Bloom filter q times, as (pair, 1) ... (pair, q). A probe asks
for (pair, 1), (pair, 2) ... until one is absent; the level reached stands for the mean of the counts it covers. The
filter has `bits` bits an entry, so its error rate doesn't depend on the corpus.

    p1(w)     = (c(w) + 1) / (N + V + 1)
    p(w | h)  = (min(c~(h w), c(h)) + mu * p1(w)) / (c(h) + mu)          c~: the filter's count

A pair is never more frequent than either of its words, so its level is at most that of min(c(h), c(w)).

A document is its words and then one end, which is a token; the end is also what precedes the first word. `score` is the
sum of log10 p, `base_score` that of log10 p1.

The texts are read once. Chunks of documents become numbers of distinct words; the exact counts of these words come by the
distinct-word exchange. From then on there are only numbers. Pairs are dealt into groups by hash, each with a bitmap of
its own, and the filter is broadcast in slices of whole groups: at most `max_bytes`, or one group, is on the driver and
broadcast at a time. A slice's share of the scores is written before the next slice is sent. A pair lies in one slice, so
the shares add up to the score. There are as many groups as hold the bitmaps to about GROUP_BYTES each.

Nulls: a null text is empty (the end alone); a null id counts as training. Repeated rows each count and each give a row.
Long texts are a chunk of their own. No training documents: all counts are 0. Empty table: empty result. Other columns
are ignored.
"""

from __future__ import annotations

import gc
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .common import Scratch, read, width

FOLDS, FOLD, MU, BITS, HASHES, MAX_BYTES = 7, 2, 20.0, 12, 8, 64 << 20
#: Pairs that a task gathers before it combines them; bytes that a group's bitmap is meant to have.
FLUSH, GROUP_BYTES = 1 << 22, 1 << 20
#: Tokens of a chunk that are scored together.
PIECE = 1 << 17
_TOTAL = -2
_END = np.uint64(xxhash.xxh64_intdigest(b"end of text", 7))


def words(text: str) -> list[bytes]:
    """Lower-cased (A-Z) runs of anything but ASCII blanks."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def is_held_out(doc_id: int | None, folds: int = FOLDS, fold: int = FOLD) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def mixed(x: np.ndarray) -> np.ndarray:
    """Stirs the bits of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pairs(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The hash of each pair of word hashes."""
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + after)


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(counts)).astype(np.int64)


def level_count(level: np.ndarray) -> np.ndarray:
    """The mean of the counts 2**(level-1) .. 2**level - 1; 0 for level 0."""
    return np.where(level > 0, (np.exp2(level - 1.0) + np.exp2(1.0 * level) - 1) / 2, 0.0)


def _start(h: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the places of (pair, level) begin, and the step between them."""
    g = mixed(h + np.uint64(level * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
    return g >> np.uint64(32), (g & np.uint64(0xFFFFFFFF)) | np.uint64(1)


class Filter:
    """A slice of the filter: some of the groups that pairs are dealt into, each with bits of its own."""

    def __init__(self, groups: int, parts: dict[int, bytes], hashes: int):
        self.groups, self.hashes = groups, hashes
        self.bits, self.offset = np.zeros(groups, np.uint64), np.zeros(groups, np.uint64)
        at = 0
        for k in sorted(parts):
            self.bits[k], self.offset[k] = 8 * len(parts[k]), at
            at += 8 * len(parts[k])
        self.data = np.frombuffer(b"".join(parts[k] for k in sorted(parts)), np.uint8)

    def level(self, h: np.ndarray, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(level of each pair, whether its group is in this slice). most: the level that each pair can have at most."""
        group = (h % np.uint64(self.groups)).astype(np.int64)
        bits, offset = self.bits[group], self.offset[group]
        out, live, level = np.zeros(len(h), np.int64), np.flatnonzero(bits > 0), 1
        while level < 64:
            live = live if most is None else live[most[live] >= level]
            if not len(live):
                break
            for probe in range(self.hashes):  # what one probe rules out isn't probed again
                if probe == 0:
                    ok, start = live, _start(h[live], level)
                at = (start[0] + np.uint64(probe) * start[1]) % bits[ok] + offset[ok]
                there = (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                ok, start = ok[there], (start[0][there], start[1][there])
            live = ok
            out[live] = level
            level += 1
        return out, bits > 0


def _bitmap(h: np.ndarray, level: np.ndarray, bits: int, hashes: int) -> bytes:
    """The bits of one group's pairs."""
    size = -(-max(1024, int(level.sum()) * bits) // 8) * 8  # on fewer bits, places coincide too often
    flags = np.zeros(size, bool)
    for k in range(1, int(level.max(initial=0)) + 1):
        a, b = _start(h[level >= k], k)
        for probe in range(hashes):
            flags[((a + np.uint64(probe) * b) % np.uint64(size)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 7)


def _combined(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n, first) if len(first) else n


def numbered(docs: DataFrame, buckets: int, folds: int, fold: int) -> DataFrame:
    """bucket, chunk, payload, n. Each chunk sends its distinct words to their buckets (the words, their counts in training
    documents), and as bucket -1 itself: ids, words of each document, the numbers of the words from 1 on in the order in
    which the buckets have them, and their hashes; n: its training documents."""

    def run(batches):
        for key, ids, texts in exchange.chunked(batches):
            split = [words(t) for t in texts]
            lengths = np.array([len(s) for s in split], np.int64)
            by_bucket = exchange.dealt(chain.from_iterable(split), buckets)
            place, out = {}, []
            for own in by_bucket.values():
                place.update(zip(own, range(len(place) + 1, len(place) + len(own) + 1), strict=True))
            numbers = np.fromiter(map(place.__getitem__, chain.from_iterable(split)), np.uint32, int(lengths.sum()))
            train = np.array([not is_held_out(i, folds, fold) for i in ids])
            counts = np.bincount(numbers[np.repeat(train, lengths)], minlength=len(place) + 1)
            at = 1
            for k, own in by_bucket.items():
                out.append((k, key, exchange.pack((own, counts[at : at + len(own)].tolist())), 0))
                at += len(own)
            hashes = np.fromiter(map(_hash, place), np.uint64, len(place))
            small = numbers.astype(np.uint16) if len(place) < 1 << 16 else numbers
            out.append((-1, key, exchange.pack((ids, train, lengths.astype(np.uint32), small, hashes)), int(train.sum())))
            b, c, p, n = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(c, pa.binary()), pa.array(p, pa.binary()), pa.array(n, pa.int64())], ["bucket", "chunk", "payload", "n"])

    return docs.mapInArrow(run, exchange.REQUEST + ", n long")


def word_counts(asked: DataFrame, parts: int) -> DataFrame:
    """bucket, chunk, payload. Each chunk's words of a bucket answered with their counts in the whole corpus; and a row of a
    chunk of its own for each bucket: its distinct training words and its training words."""

    def run(batches):
        bucket, held = None, []

        def done():
            total: dict[bytes, int] = {}
            for _, payload in held:
                for w, c in zip(*exchange.unpack(payload), strict=True):
                    total[w] = total.get(w, 0) + c
            for chunk, payload in held:
                yield exchange.rows([(bucket, chunk, exchange.pack(np.array([total[w] for w in exchange.unpack(payload)[0]], np.int64)))])
            yield exchange.rows([(_TOTAL, b"%d" % bucket, exchange.pack((sum(c > 0 for c in total.values()), sum(total.values()))))])

        gc.disable()
        for b in batches:
            for k, chunk, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != bucket and held:
                    yield from done()
                    held = []
                bucket = k
                held.append((chunk, payload))
        if held:
            yield from done()

    return asked.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, exchange.REQUEST)


def counted(chunks: DataFrame, answers: DataFrame, parts: int) -> DataFrame:
    """payload: ids, training marks, words of each document, numbers, hashes and corpus counts of each chunk; or v, n: what a
    bucket has in all."""

    def run(batches):
        key, held, got = None, [], []
        for b in batches:
            for k, chunk, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if chunk != key:
                    yield from _with_counts(held, got)
                    key, held, got = chunk, [], []
                if k == _TOTAL:
                    yield _row(None, *exchange.unpack(payload))
                else:
                    (held if k < 0 else got).append((k, payload))
        yield from _with_counts(held, got)

    both = chunks.unionByName(answers).repartition(parts, "chunk").sortWithinPartitions("chunk", "bucket")
    return both.mapInArrow(run, "payload binary, v long, n long")


def _row(payload, v, n):
    return pa.RecordBatch.from_arrays([pa.array([payload], pa.binary()), pa.array([v], pa.int64()), pa.array([n], pa.int64())], ["payload", "v", "n"])


def _with_counts(held: list, got: list):
    """Rows of a chunk, as often as the table holds it. got: answers, a bucket's as often too."""
    answers = dict(got)
    counts = [exchange.unpack(answers[k]) for k in sorted(answers)]
    for _, payload in held:
        own = exchange.unpack(payload)
        yield _row(exchange.pack((*own, np.concatenate([np.zeros(0, np.int64), *counts]))), 0, 0)


def tokens_of(lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of what precedes each token, of each token, where each document starts); the end has number 0."""
    sizes = lengths.astype(np.int64) + 1
    starts = np.cumsum(sizes) - sizes
    after = np.zeros(int(sizes.sum()), np.int64)
    inner = np.ones(len(after), bool)
    inner[starts + sizes - 1] = False
    after[inner] = numbers
    before = np.concatenate(([0], after[:-1]))
    before[starts] = 0
    return before, after, starts


def filter_parts(chunks: DataFrame, groups: int, bits: int, hashes: int, parts: int) -> DataFrame:
    """bucket, chunk (empty), payload: the bitmap of each group of word pairs. chunks: as counted() gives them."""

    def count(batches):
        held, size = [], 0

        def flush():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            group = (h % np.uint64(groups)).astype(np.uint16)
            order = np.argsort(group, kind="stable")
            cuts = np.searchsorted(group[order], np.arange(groups + 1))
            out = []
            for k in np.flatnonzero(np.diff(cuts)):
                own = order[cuts[k] : cuts[k + 1]]
                out.append((int(k), b"", exchange.pack((h[own].tobytes(), n[own].astype(np.uint32).tobytes()))))
            return exchange.rows(out)

        for b in batches:
            for payload in b.column(0):
                _, train, lengths, numbers, hashes, _ = exchange.unpack(payload.as_py())
                before, after, _ = tokens_of(lengths, numbers)
                h = np.concatenate(([_END], hashes))
                own = np.repeat(train, lengths.astype(np.int64) + 1)
                held.append(pairs(h[before[own]], h[after[own]]))
                size += len(held[-1])
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def build(batches):
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[int, list] = {}

        def combine(k):
            parts = waiting.pop(k) + ([total[k]] if k in total else [])
            total[k] = _combined(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

        def made(k):
            combine(k) if k in waiting else None
            h, n = total.pop(k)
            return exchange.rows([(k, b"", _bitmap(h, levels(n), bits, hashes))])

        at = None
        for b in batches:
            for k, payload in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if at is not None and k != at:  # one group at a time
                    yield made(at)
                at = k
                h, n = exchange.unpack(payload)
                waiting.setdefault(k, []).append((np.frombuffer(h, np.uint64), np.frombuffer(n, np.uint32).astype(np.int64)))
                if sum(len(p[0]) for p in waiting[k]) > max(FLUSH, len(total[k][0]) if k in total else 0):
                    combine(k)
        if at is not None:
            yield made(at)

    dealt = chunks.mapInArrow(count, exchange.REQUEST).repartition(min(groups, parts), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(build, exchange.REQUEST)


def scored(chunks: DataFrame, model: dict, sent, empty: np.ndarray, first: bool, last: bool) -> DataFrame:
    """no, share (of the score of each document of a chunk, by one slice of the filter); the last slice also gives ids,
    held_out, n_tokens, n_known and base."""
    n, v, mu, train_docs = (model[k] for k in ("n", "v", "mu", "train_docs"))
    groups = np.uint64(len(empty))

    def of(words, lengths, numbers):
        """(share, known tokens, base) of some documents; words: hash, count, level and p1 by number."""
        h, c, most, p1 = words
        before, after, starts = tokens_of(lengths, numbers)
        pair = pairs(h[before], h[after])
        group = (pair % groups).astype(np.int64)
        here = np.flatnonzero(sent.value.bits[group] > 0)
        x, y = before[here], after[here]
        level, _ = sent.value.level(pair[here], np.minimum(most[x], most[y]))
        log = np.zeros(len(pair))
        log[here] = np.log10((np.minimum(level_count(level), c[x]) + mu * p1[y]) / (c[x] + mu))
        if first:  # it also has the groups that hold no pair
            here = np.flatnonzero(empty[group])
            log[here] = np.log10(mu * p1[after[here]] / (c[before[here]] + mu))
        share = np.add.reduceat(log, starts)
        if not last:
            return (share,)
        return share, np.add.reduceat(c[after] > 0, starts, dtype=np.int64), np.add.reduceat(np.log10(p1)[after], starts)

    def run(batches):
        for b in batches:
            for no, payload in zip(b.column(0), b.column(1), strict=True):
                ids, train, lengths, numbers, hashes, counts = exchange.unpack(payload.as_py())
                c = np.concatenate(([train_docs], counts))
                own = np.concatenate(([_END], hashes)), c, np.where(c > 0, levels(np.maximum(c, 1)), 0), (c + 1) / (n + v + 1)
                ends = np.cumsum(lengths, dtype=np.int64)
                cuts = [0, *(np.flatnonzero(np.diff(ends // PIECE)) + 1).tolist(), len(ids)]  # some documents at a time bound what is held
                at = np.concatenate(([0], ends))
                found = [of(own, lengths[i:j], numbers[at[i] : at[j]]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                share, *rest = (np.concatenate(x) for x in zip(*found, strict=True))
                columns, names = [pa.array([no.as_py()], pa.int64()), pa.array([share])], ["no", "share"]
                if last:
                    columns += [pa.array([ids], pa.list_(pa.int64())), pa.array([~train]), pa.array([lengths.astype(np.int64) + 1]), *[pa.array([x]) for x in rest]]
                    names += ["ids", "held", "sizes", "known", "base"]
                yield pa.RecordBatch.from_arrays(columns, names)

    more = ", ids array<long>, held array<boolean>, sizes array<long>, known array<long>, base array<double>"
    return chunks.mapInArrow(run, "no long, share array<double>" + more * last)


def slices_of(sizes: dict[int, int], max_bytes: int) -> list[list[int]]:
    """Groups, in order, put together to slices of at most max_bytes, or one group."""
    slices: list[list[int]] = [[]]
    room = max_bytes
    for k in sorted(sizes):
        if slices[-1] and sizes[k] > room:
            slices.append([])
            room = max_bytes
        slices[-1].append(k)
        room -= sizes[k]
    return slices


def lm_scores(docs: DataFrame, folds: int = FOLDS, fold: int = FOLD, mu: float = MU, bits: int = BITS, hashes: int = HASHES, max_bytes: int = MAX_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A document is held out if crc32 of its id as text modulo `folds` is `fold`.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = exchange.id_and_text(docs, id_col, text_col)
    buckets, parts = exchange.buckets_for(docs), max(width(docs), 8)
    made = scratch.table(numbered(docs, buckets, folds, fold))
    train_docs = made.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    columns = ["bucket", "chunk", "payload"]
    answers = word_counts(made.filter("bucket >= 0").select(*columns), min(buckets, parts))
    chunks = counted(made.filter("bucket < 0").select(*columns), answers, parts)
    chunks = scratch.table(chunks.withColumn("no", F.monotonically_increasing_id()))
    scratch.drop(made)
    v, n = chunks.agg(F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    model = {"n": n + train_docs, "v": v + (train_docs > 0), "mu": mu, "train_docs": train_docs}
    chunks = chunks.filter("payload IS NOT NULL").select("no", "payload")
    groups = int(min(1 << 15, max(64, (model["n"] * bits // 8 // GROUP_BYTES))))
    filters = scratch.table(filter_parts(chunks.select("payload"), groups, bits, hashes, parts), few=True)
    sizes = {r[0]: r[1] for r in filters.select("bucket", F.length("payload")).collect()}  # a row for each of the groups
    slices, shares = slices_of(sizes, max_bytes), []
    empty = np.array([k not in sizes for k in range(groups)])
    for i, ks in enumerate(slices):
        own = {r.bucket: bytes(r.payload) for r in filters.filter(F.col("bucket").isin(ks)).select("bucket", "payload").collect()} if ks else {}
        sent = spark.sparkContext.broadcast(Filter(groups, own, hashes))  # max_bytes, or one group, at most
        del own
        last = i == len(slices) - 1
        out = scored(chunks, model, sent, empty, i == 0, last)
        if not last:
            shares.append(scratch.table(out))
            sent.destroy()
    parts_of = [F.col(c) for c in ("ids", "held", "sizes", "known", "base", "share")]
    if shares:
        other = shares[0]
        for x in shares[1:]:
            other = other.unionByName(x)
        add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
        other = other.groupBy("no").agg(F.collect_list("share").alias("others"))
        parts_of[-1] = F.aggregate("others", F.col("share"), add)
        out = out.join(other, "no")
    rows = out.select(F.explode(F.arrays_zip(*[c.alias(a) for c, a in zip(parts_of, "abcdef", strict=True)])).alias("x"))
    return rows.select(
        F.col("x.a").alias("doc_id"), F.col("x.b").alias("held_out"), F.col("x.c").alias("n_tokens"), F.col("x.d").alias("n_known"), F.lit(model["n"]).cast("long").alias("train_tokens"),
        F.col("x.e").alias("base_score"), F.col("x.f").alias("score"),
    )


def op4_lm_score(spark, sf_dir):
    return lm_scores(read(spark, sf_dir, "documents"))
