"""Byte-level BPE encoding and decoding over a global distinct-word shuffle.

Pre-tokens (the matches of the vocabulary's pattern) are exploded by chunk, each distinct one is encoded once in the
task of its bucket, and the ids come back to the chunk, where they take the pre-tokens' positions. Decoding joins the
token-byte table, whose size is that of the vocabulary.

The pattern never matches across the edges of a span, a non-blank run with at most one leading space or a run of blanks,
so a chunk cuts texts into spans by a cheap pattern and applies the vocabulary's own once for each distinct span.

Nulls: a null text is empty and has no ids; a null id stays null. Repeated rows and ids each give a row. Long texts are a
chunk of their own. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange
from .common import read

#: Unicode's White_Space, which \s means in the vocabulary's pattern.
BLANK = "\t-\r \x85\xa0  -     　"
_SPANS = re.compile(rf" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def _pattern(pattern: str):
    import regex

    return regex.compile(pattern)


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """The token-byte table, by id."""
    table = ranks(path)
    out = [b""] * (max(table.values(), default=-1) + 1)
    for b, i in table.items():
        out[i] = b
    return out


def spans(text: str) -> list[str]:
    return _SPANS.findall(text)


#: Marks that are neither letters, numbers nor blanks, and start no contraction.
_MARKS = ".,;:!?()\"|"


def splitter(pattern: str, plain: bool):
    """A function from a span to its pre-tokens. plain: the pattern is the usual one, under which a word, alone or with
    closing marks, needs no matching."""
    split = _pattern(pattern).findall

    def of(span: str) -> list[str]:
        core = span.rstrip(_MARKS)
        if core and (core[1:] if core[0] == " " else core).isalpha():
            return [span] if len(core) == len(span) else [core, span[len(core) :]]
        return split(span)

    return of if plain else split


#: Fixed value: the pattern for which spans and the shortcut hold.
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(path: str, pattern: str):
    """A function from a pre-token to its ids, little-endian unsigned 32-bit."""
    encode = _encoding(path, pattern).encode_ordinary
    return lambda word: struct.pack(f"<{len(ids := encode(word))}I", *ids)


def decode(ids: bytes, path: str) -> bytes:
    return b"".join(map(token_bytes(path).__getitem__, memoryview(ids).cast("I")))


def encode_corpus(docs: DataFrame, path: str, pattern: str, result, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """result(ids, texts, encoded): a RecordBatch for a chunk; encoded: each text's token ids as bytes."""
    docs = exchange.id_and_text(docs, id_col, text_col)
    usual = pattern == USUAL
    cut = spans if usual else (lambda text: [text])

    def words_of(_, texts):
        split = splitter(pattern, usual)
        parts = [cut(t) for t in texts]
        seen = {s: split(s) for s in dict.fromkeys(chain.from_iterable(parts))}
        return dict.fromkeys(chain.from_iterable(seen.values())), (parts, seen)

    def assemble(ids, texts, values, made):
        parts, seen = made
        known = {s: b"".join([values[w] for w in words]) for s, words in seen.items()}
        return result(ids, texts, [b"".join(map(known.__getitem__, p)) for p in parts])

    buckets = exchange.buckets_for(docs)
    answers = exchange.answered(exchange.requests(docs, words_of, buckets), lambda: encoder(path, pattern))
    return exchange.assembled(exchange.texts(docs), answers, buckets, words_of, assemble, schema)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, ids."""

    def result(ids, _, encoded):
        values = np.frombuffer(b"".join(encoded), "<u4").astype(np.int32)
        ends = np.cumsum([0] + [len(e) // 4 for e in encoded]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["doc_id", "ids"])

    return encode_corpus(docs, path, pattern, result, "doc_id long, ids array<int>", id_col, text_col)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def result(ids, _, encoded):
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(e) // 4 for e in encoded], pa.int64()), pa.array([sha(e) for e in encoded]), pa.array([sha(decode(e, path)) for e in encoded])],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return encode_corpus(docs, path, pattern, result, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col)


def op10_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
