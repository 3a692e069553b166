"""Token counts and byte-level BPE against the libraries on whole texts."""

import base64
import hashlib
import struct

import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from tallyforge.llm import byte_bpe, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [
    None, "", " ", "   ", "\n", "\n\n a", "Plain words, and marks... (so)", "it's we'll 'tis don''t", "tab\tand\r\nfeed  double   triple ",
    "\x1c\x85\xa0　▁x y▁▁z", "日本語 テスト 漢字。", "😀 a​b é ﬁ", "x" * 20000, "word " * 5000, "<s> </s> <unk> <|endoftext|>", "a\x00b", "12345 6789.0", "'s's 's", "same", "same",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "x", 1), (3, "repeated id", None, None), (3, "repeated id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, chunk int").repartition(3)


def test_token_counts_equal_the_library(docs):
    m = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = sorted((-1 if r.doc_id is None else r.doc_id, len((r.text or "").encode()), len(m.encode(r.text or "")), len(m.encode(r.text or "")) > 4096) for r in docs.collect())
    for limit in (4096,):
        got = token_counts.token_counts(docs, MODEL, limit)
        assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got.collect()) == want


def test_byte_bpe_equals_the_library_and_comes_back(docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in docs.collect():
        text = r.text or ""
        ids = enc.encode_ordinary(text)
        want.append((-1 if r.doc_id is None else r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = byte_bpe.digests(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == sorted(want)


def test_another_pattern_is_matched_on_whole_texts(spark):
    pattern = r"\s*\w+|\W"
    ranks = byte_bpe.ranks(RANKS)
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    docs = spark.createDataFrame([(1, "two  words\n here"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in byte_bpe.encode(docs, RANKS, pattern).collect()}
    assert got == {1: enc.encode_ordinary("two  words\n here"), 2: []}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(docs, MODEL).count() == 0
    assert byte_bpe.digests(docs, RANKS, public_tokenizers.PATTERN).count() == 0
