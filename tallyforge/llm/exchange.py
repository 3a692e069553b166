"""Distinct-word exchange: a value for each distinct word of a corpus, computed once, brought back to the documents.

Rows move as chunks of documents (bounded in bytes), not as one row a word:

    request   each chunk sends its distinct words, dealt into buckets by a hash of the word        (shuffle by bucket)
    answer    a bucket's task computes the value of each distinct word once and answers each chunk (shuffle by chunk)
    assemble  a chunk's texts, compressed, meet the answers; words are replaced by position

A frequent word arrives once for each chunk, so no word is a hot key; a bucket's task holds the distinct words of its
bucket only. Chunks are keyed by a digest of what they hold. The table is read twice (for requests and for texts); if
a source gave its rows in another order the second time, the keys would not meet and the job fails instead of
answering wrongly.

A splitter maps a text to its words; it runs in the workers and must be picklable.
"""

from __future__ import annotations

import gc
import pickle
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, width

#: Text bytes and documents in a chunk; a longer document is a chunk of its own.
CHUNK_BYTES, CHUNK_DOCS = 6 << 20, 10000
REQUEST = "bucket int, chunk binary, payload binary"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("chunk", pa.binary()), ("payload", pa.binary())])


def pack(x) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(x, protocol=5))


def unpack(x: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(x))


def buckets_for(docs: DataFrame) -> int:
    """Buckets from the table's size in bytes, as the optimizer estimates it: vocabularies grow more slowly than texts."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 58:  # not known
        return 256
    return int(min(8192, 64 + 16 * (size / 1e9) ** 0.6))


def chunked(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bytes, list, list[str]]]:
    """(key, ids, texts) of each chunk."""
    gc.disable()  # the worker holds many strings and no cycles: walking them costs more than the rest
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (size + len(t) > CHUNK_BYTES or len(ids) >= CHUNK_DOCS):
                yield key_of(ids, texts), ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t)
    if ids:
        yield key_of(ids, texts), ids, texts


def key_of(ids: list, texts: list[str]) -> bytes:
    h = xxhash.xxh3_128(repr(ids).encode())
    for t in texts:
        b = t.encode("utf-8", "surrogatepass")
        h.update(b"%d;" % len(b))
        h.update(b)
    return h.digest()


def dealt(words: Iterable[str | bytes], buckets: int) -> dict[int, list]:
    """Distinct words by bucket, in their order: the request and the assembly both derive this order."""
    lists: list[list] = [[] for _ in range(buckets)]
    crc = zlib.crc32
    for w in dict.fromkeys(words):
        lists[crc(w if type(w) is bytes else w.encode("utf-8", "surrogatepass")) % buckets].append(w)
    return {k: x for k, x in enumerate(lists) if x}


def rows(data: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    b, c, p = zip(*data, strict=True) if data else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(c, pa.binary()), pa.array(p, pa.binary())], schema=_SCHEMA)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))


def requests(docs: DataFrame, words_of: Callable, buckets: int) -> DataFrame:
    """asked(), dealt by bucket, one bucket after the other."""
    return asked(docs, words_of, buckets).repartition(min(buckets, max(width(docs), 8)), "bucket").sortWithinPartitions("bucket")


def asked(docs: DataFrame, words_of: Callable[[list, list[str]], tuple[dict, object]], buckets: int) -> DataFrame:
    """words_of(ids, texts): (the chunk's words, each with what the bucket shall know of it or None; anything for assembled())."""

    def run(batches):
        for key, ids, texts in chunked(batches):
            known = words_of(ids, texts)[0]
            out = []
            for k, words in dealt(known, buckets).items():
                extra = [known[w] for w in words]
                out.append((k, key, pack((words, extra if any(x is not None for x in extra) else None))))
            yield rows(out or [(0, key, pack(([], None)))])

    return docs.mapInArrow(run, REQUEST)


def texts(docs: DataFrame) -> DataFrame:
    """Each chunk's documents, as bucket -1."""

    def run(batches):
        for key, ids, texts in chunked(batches):
            yield rows([(-1, key, pack((ids, texts)))])

    return docs.mapInArrow(run, REQUEST)


def answered(dealt_out: DataFrame, value: Callable) -> DataFrame:
    """value(): made once in each task; gives a function from a word to its value, which is called once a word. A bucket's
    words are held while it lasts. dealt_out: as requests() gives it."""

    def run(batches):
        gc.disable()
        of, known, at = value(), {}, None
        for batch in batches:
            for k, key, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != at:
                    at, known = k, {}
                words = unpack(payload)[0]
                for w in words:
                    if w not in known:
                        known[w] = of(w)
                yield rows([(k, key, pack([known[w] for w in words]))])

    return dealt_out.mapInArrow(run, REQUEST)


def assembled(docs_texts: DataFrame, answers: DataFrame, buckets: int, words_of: Callable, result: Callable, schema: str) -> DataFrame:
    """result(ids, texts, values, made): a pyarrow RecordBatch for a chunk; values: the value of each of its words; made:
    what words_of gave besides."""

    def run(batches):
        gc.disable()
        key, held, got = None, [], {}

        def done():
            for body in held:
                ids, texts = unpack(body)
                values, (words, made) = {}, words_of(ids, texts)
                for k, words in dealt(words, buckets).items():
                    if k not in got:
                        raise RuntimeError("a chunk lacks answers: the input must give the same rows in the same order when it is read again")
                    values.update(zip(words, unpack(got[k]), strict=True))
                yield result(ids, texts, values, made)

        for batch in batches:
            for k, c, payload in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != key:
                    yield from done()
                    key, held, got = c, [], {}
                if k < 0:
                    held.append(payload)
                else:
                    if not held:
                        raise RuntimeError("answers without their chunk: the input must give the same rows in the same order when it is read again")
                    got[k] = payload
        yield from done()

    both = docs_texts.unionByName(answers).repartition(width(docs_texts, 8), "chunk").sortWithinPartitions("chunk", "bucket")
    return both.mapInArrow(run, schema)
