"""Duplicated code: windows of 50 normalised tokens that occur more than once, and the maximal runs they cover.

Files come as codes, one number a token, equal where the normalised tokens are equal. File scope needs no shuffle: a
file's task hashes its windows, counts them and measures the runs.

Project scope exchanges hashes in packed form, since a row a window would be many times the input:

    request   a task cuts its files into chunks; each sends its distinct window hashes, dealt into buckets   (by bucket)
    answer    a bucket's task finds the hashes that occur twice and answers each chunk with one bit a hash   (by chunk)
    measure   the chunk's codes, compressed, meet the answers; a row for each file with duplicates

A chunk's codes travel through the same two shuffles, so the input is read once. A window that is everywhere arrives once a
chunk, so none is hot. A window is known by 64 bits and its bucket, which is dealt by bits of another hash.
"""

from __future__ import annotations

import pickle
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 50
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Windows and files of a chunk; windows that a bucket is meant for.
CHUNK_WINDOWS, CHUNK_FILES, BUCKET_WINDOWS = 1 << 20, 10_000, 1 << 22
RUNS = "project string, path string, blocks long, covered long, longest long"
_MOVED = "at int, bucket int, chunk binary, payload binary"


def normalised(kind: Column, text: Column) -> Column:
    """What a token counts as: names and literals are alike, whatever they are."""
    return F.when(kind == "identifier", "$id").when(kind == "literal", "$lit").otherwise(text)


def codes(tokens: DataFrame) -> DataFrame:
    """project, path, codes of token rows (project, path, pos, kind, text). parse.facts() gives the same without a shuffle."""
    word = F.xxhash64(normalised(F.col("kind"), F.col("text")))
    rows = tokens.filter("kind <> 'comment'").groupBy("project", "path").agg(F.sort_array(F.collect_list(F.struct("pos", word.alias("w")))).alias("t"))
    return rows.select("project", "path", F.transform("t", lambda x: x["w"]).alias("codes"))


def _codes(x: pa.Scalar) -> np.ndarray:
    """A file's codes: an array of longs, or a string that has one character a token."""
    if pa.types.is_string(x.type):
        return np.frombuffer(x.as_py().encode("utf-32-le"), np.uint32).astype(np.uint64)
    return x.values.to_numpy().view(np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def window_hashes(c: np.ndarray, window: int = WINDOW, base: int = _BASES[0]) -> np.ndarray:
    """The hash of each window of codes: a polynomial, put together from windows of 1, 2, 4, ... codes."""
    n = len(c) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    part, width, power = _mixed((c + np.uint64(1)) * np.uint64(base | 1)), 1, base
    out, done = None, 0
    while True:
        if window & width:
            out = part if out is None else out[: len(part) - done] * np.uint64(power) + part[done:]
            done += width
        if done == window:
            return _mixed(out[:n])
        part = part[: len(part) - width] * np.uint64(power) + part[width:]
        width, power = 2 * width, power * power % 2**64


def occurrences(h: np.ndarray) -> np.ndarray:
    """How often each value of h occurs in it."""
    _, at, n = np.unique(h, return_inverse=True, return_counts=True)
    return n[at]


def runs(twice: np.ndarray, window: int) -> tuple[int, int, int]:
    """(runs, tokens they cover, longest) of the windows that are marked."""
    starts = np.flatnonzero(twice)
    if not len(starts):
        return 0, 0, 0
    opens = np.flatnonzero(np.diff(starts, prepend=starts[0] - window - 1) > window)
    lengths = starts[np.append(opens[1:] - 1, len(starts) - 1)] - starts[opens] + window
    return len(lengths), int(lengths.sum()), int(lengths.max())


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    columns = zip(*found, strict=True) if found else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["project", "path", "blocks", "covered", "longest"])


def _named(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in ("blocks", "covered", "longest")], F.col("blocks").cast("double").alias("duplication_duplicate_block_count"), F.col("covered").cast("double").alias("duplication_duplicate_token_count"), F.col("longest").cast("double").alias("duplication_max_duplicate_length"))


def by_file(coded: DataFrame, window: int = WINDOW) -> DataFrame:
    """The duplicates within each file that has any. coded: project, path, codes."""

    def run(batches):
        for b in batches:
            out = []
            for project, path, c in zip(*b.columns, strict=True):
                found = runs(occurrences(window_hashes(_codes(c), window)) > 1, window) if c.is_valid else (0, 0, 0)
                if found[0]:
                    out.append((project.as_py(), path.as_py(), *found))
            yield _rows(out)

    return _named(coded.select("project", "path", "codes").mapInArrow(run, RUNS))


def buckets_for(coded: DataFrame) -> int:
    """Buckets, a power of two, from the table's size in bytes as the optimizer estimates it."""
    size = int(str(coded._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    windows = size // 3 if size < 1 << 58 else 0  # else it isn't known
    return min(1 << 14, max(64, 1 << max(0, windows // BUCKET_WINDOWS).bit_length()))


@lru_cache(maxsize=1024)
def _salt(project: str | None) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest((project or "").encode("utf-8", "surrogatepass"), 11 + (project is None)))


def _dealt(files: list[tuple], buckets: int, window: int):
    """Of a chunk's files: (windows of each file; windows in the order of their buckets; where each bucket begins; hashes)."""
    hashes, deal = [], []
    for project, _, c in files:
        hashes.append(_mixed(window_hashes(c, window) + _salt(project)))
        deal.append(_mixed(window_hashes(c, window, _BASES[1]) ^ _salt(project)) >> np.uint64(40))
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    bucket = (np.concatenate(deal) if deal else h).astype(np.uint32) % np.uint32(buckets)
    order = np.argsort(bucket.astype(np.uint16), kind="stable")
    cuts = np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=buckets))))
    return [len(x) for x in hashes], order, cuts, h


def _requests(coded: DataFrame, buckets: int, window: int, chunk_windows: int) -> DataFrame:
    def chunk(files):
        key = xxhash.xxh3_128()
        for project, path, c in files:
            key.update(repr((project, path, len(c))).encode("utf-8", "surrogatepass"))
            key.update(c.tobytes())
        key = key.digest()
        body = zstandard.ZstdCompressor(level=1).compress(pickle.dumps([(project, path, _small(c)) for project, path, c in files], protocol=5))
        rows = [(int.from_bytes(key[:4], "little") % buckets, -1, key, body)]
        _, order, cuts, h = _dealt(files, buckets, window)
        for k in np.flatnonzero(np.diff(cuts)):
            u, n = np.unique(h[order[cuts[k] : cuts[k + 1]]], return_counts=True)
            rows.append((int(k), int(k), key, u.tobytes() + np.packbits(n > 1).tobytes()))
        return _moved(rows)

    def run(batches):
        files, size = [], 0
        for b in batches:
            for project, path, c in zip(*b.columns, strict=True):
                c = _codes(c) if c.is_valid else ()
                if len(c) < window:
                    continue
                if files and (size + len(c) > chunk_windows or len(files) >= CHUNK_FILES):
                    yield chunk(files)
                    files, size = [], 0
                files.append((project.as_py(), path.as_py(), c))
                size += len(c)
        if files:
            yield chunk(files)

    return coded.select("project", "path", "codes").mapInArrow(run, _MOVED)


def _small(c: np.ndarray) -> np.ndarray:
    return c.astype(np.uint32) if c.max(initial=0) < 1 << 32 else c


def _moved(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"at": pa.int32(), "bucket": pa.int32(), "chunk": pa.binary(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))


def _hashes(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, whether each is repeated within its chunk) of a request: 64 bits and one bit a hash."""
    n = len(payload) * 8 // 65
    return np.frombuffer(payload, np.uint64, n), np.unpackbits(np.frombuffer(payload, np.uint8, offset=8 * n), count=n).astype(bool)


def _answer(batches):
    """Rows sorted by at and bucket: chunks' codes go on, requests become answers."""
    bucket, held = None, []

    def done():
        every = np.sort(np.concatenate([h for _, h, _ in held]))
        for key, h, repeated in held:
            after = np.minimum(np.searchsorted(every, h) + 1, len(every) - 1)
            first = np.searchsorted(every, h)
            yield _moved([(0, bucket, key, np.packbits(repeated | ((every[after] == h) & (after > first))).tobytes())])

    for b in batches:
        for k, key, payload in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            if k != bucket and held:
                yield from done()
                held = []
            bucket = k
            if k < 0:
                yield _moved([(0, k, key, payload)])
            else:
                held.append((key, *_hashes(payload)))
    if held:
        yield from done()


def repeated_in_project(coded: DataFrame, window: int = WINDOW, chunk_windows: int = CHUNK_WINDOWS) -> DataFrame:
    """RUNS: the files that hold windows which occur more than once in their project. coded: project, path, codes."""
    buckets = buckets_for(coded)
    parts = max(8, int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))

    def measure(batches):
        key, files, once, lengths, order, cuts, h, twice = None, [], [], [], None, None, None, None

        def done():
            out, at = [], 0
            for (project, path, _), n in zip(files, lengths, strict=True):
                found = runs(twice[at : at + n], window)
                at += n
                if found[0]:
                    out.append((project, path, *found))
            return _rows(out)

        for b in batches:
            for k, chunk, payload in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if k < 0:
                    if chunk == key:  # a chunk that the table holds again: all its windows are there twice
                        files, lengths = files + files[: len(once)], lengths + once
                        twice = np.ones(sum(lengths), bool)
                        continue
                    if key is not None:
                        yield done()
                    key, files = chunk, [(p, q, c.astype(np.uint64)) for p, q, c in pickle.loads(zstandard.ZstdDecompressor().decompress(payload))]
                    once, order, cuts, h = _dealt(files, buckets, window)
                    lengths = once
                    twice = np.zeros(len(h), bool)
                    continue
                if chunk != key:
                    raise RuntimeError("answers without their chunk: the input must give the same rows in the same order when it is read again")
                own = order[cuts[k] : cuts[k + 1]]
                u, at = np.unique(h[own], return_inverse=True)
                twice[own] |= np.unpackbits(np.frombuffer(payload, np.uint8), count=len(u)).astype(bool)[at]
        if key is not None:
            yield done()

    moved = _requests(coded, buckets, window, chunk_windows).repartition(min(buckets, parts), "at").sortWithinPartitions("at", "bucket")
    moved = moved.mapInArrow(_answer, _MOVED).repartition(parts, "chunk").sortWithinPartitions("chunk", "bucket")
    return moved.mapInArrow(measure, RUNS)


def by_project(coded: DataFrame, window: int = WINDOW) -> DataFrame:
    """The duplicates of each project that has any. coded: project, path, codes."""
    per_file = repeated_in_project(coded, window)
    return _named(per_file.groupBy("project").agg(F.sum("blocks").alias("blocks"), F.sum("covered").alias("covered"), F.max("longest").alias("longest")))
