"""Token counts without token ids: pieces are counted once for each distinct pre-token.

A pre-token is a run of the word mark (the escaped blank) with what follows up to the next mark, or a line feed. No piece
of the vocabulary crosses such a boundary (checked when the model is loaded), so BPE merges don't either and a text's
count is the sum over its pre-tokens. Each document's pre-token frequencies meet the counts by the distinct-word
exchange; no ids are made. A vocabulary with pieces across these boundaries is counted text by text.

Nulls: a null text is empty and has no tokens; a null id stays null. Repeated rows and ids each give a row. Long texts are
a chunk of their own. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange
from .common import read

MARK = "▁"
LIMIT = 4096
_PRE = re.compile(rf"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")


@lru_cache(maxsize=4)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def splits(path: str) -> bool:
    """Whether pre-tokens can be counted apart: pieces hold the mark at their front only and line feeds alone, and the
    normaliser does no more than to escape blanks and put one mark in front."""
    m = _model(path)
    pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
    apart = not any(MARK in p.lstrip(MARK) or ("\n" in p and p != "\n") for p in pieces)
    plain = m.normalize("  a  ﬁ\tb　\n ") == f"{MARK * 3}a{MARK * 2}ﬁ\tb　\n{MARK}"
    return apart and plain


def pre_tokens(text: str) -> list[str]:
    return _PRE.findall((MARK + text).replace(" ", MARK)) if text else []


def piece_counter(path: str):
    """A function from a pre-token to its number of pieces; the line feed, which stands alone, fences it off."""
    encode = _model(path).encode
    feed = len(encode("a\n")) - len(encode("a"))

    def count(word: str) -> int:
        if word == "\n":
            return feed
        if word[0] == MARK:
            return len(encode(word[1:] + "\n")) - feed
        return len(encode("\n" + word)) - len(encode("\n"))

    return count


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_tokens, over_limit."""
    docs = exchange.id_and_text(docs, id_col, text_col)
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

    def batch(ids, texts, counts):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    if not splits(model):

        def whole(batches):
            m = _model(model)
            for _, ids, texts in exchange.chunked(batches):
                yield batch(ids, texts, [len(m.encode(t)) for t in texts])

        return docs.mapInArrow(whole, schema)

    def words_of(_, texts):
        counts = [Counter(pre_tokens(t)) for t in texts]
        return dict.fromkeys(chain.from_iterable(counts)), counts

    def result(ids, texts, pieces, counts):
        return batch(ids, texts, [sum([n * pieces[w] for w, n in c.items()]) for c in counts])

    buckets = exchange.buckets_for(docs)
    answers = exchange.answered(exchange.requests(docs, words_of, buckets), lambda: piece_counter(model))
    return exchange.assembled(exchange.texts(docs), answers, buckets, words_of, result, schema)


def op1_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
