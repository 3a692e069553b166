"""A corpus pipeline: toxic documents go, exact copies go, near copies go, what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`.

Nulls: a null text is empty and stays unless another row of its stage equals it; of rows that a stage holds to be copies a
null id is kept only if there is no other. Ties go as the operators say; rows equal in id and text are copies. An empty
table stays empty in every stage. Columns beside doc_id and text are carried along, whatever their names.
"""

from __future__ import annotations

import public_tokenizers

from tallyforge.llm import exact_dedup, near, packing, toxicity
from tallyforge.llm.common import Scratch, read


def toxic(spark, docs, sf_dir):
    """Drops the documents that the classifier, trained on the labelled ones, predicts to be toxic."""
    return toxicity.kept_rows(docs, read(spark, sf_dir, "labels"))


def exact(spark, docs, sf_dir):
    """Keeps, of equal texts, the document with the largest id."""
    return exact_dedup.kept_rows(docs)


def near_copies(spark, docs, sf_dir):
    """Keeps, of each group linked by a 5-word shingle similarity of 0.8 or more, the document with the least id. SimHash
    blocks propose pairs, and min-hash bands those whose fingerprints lie too far apart."""
    return near.kept_rows(docs)


def packed(spark, docs, sf_dir):
    """Packs the documents' tokens into sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("simhash_near_dedup", near_copies), ("best_fit_packing", packed)]

#: SQL can't express the classifier, the hashes or the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over `documents`, each written as Parquet and read again by the next."""
    scratch, docs = Scratch(spark), read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
