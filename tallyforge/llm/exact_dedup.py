"""Exact dedup: skew-safe combining in three stages, each comparing the full text.

1. Each map task combines its own equal texts (the partial aggregation of stage 2 runs before any shuffle).
2. Rows of one digest meet in salted groups. The salt is the input partition modulo `salts`, so a group of copies that
   fills a third of the table is merged by up to `salts` tasks.
3. The salts' winners, at most `salts` rows for each text, are combined.

The grouping key of every stage is (digest, text): two texts with one digest stay two groups. What comes out is narrow
(digest, winner, size) and is joined back by digest; a digest that two texts share is joined on the text too.

Nulls: a null text is the empty text; a null id loses to any other, and stays only where a group has no other.
Repeated rows: of rows equal in id and text one is kept. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, attach, only, text_of

SALTS = 16


def groups(docs: DataFrame, text: Column, id_col: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """One row for each distinct text: digest, text, keep_id (the largest id), group_size."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    salted = rows.groupBy("digest", "text", (F.spark_partition_id() % salts).alias("salt")).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None, salts: int = SALTS) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    normalise: a function from Column to Column applied before texts are compared; none by default.
    """
    text = text_of(text_col)
    text = normalise(text) if normalise else text
    scratch = Scratch(docs.sparkSession)
    found = groups(docs, text, id_col, salts)
    found = scratch.table(found.select("digest", "keep_id", "group_size"))
    shared = found.groupBy("digest").count().filter("count > 1")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    total = found.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    if shared.isEmpty():
        out = attach(rows, found, "digest", total, "group_size")
    else:  # two texts with one SHA-256: the join needs the texts themselves
        full = groups(docs, text, id_col, salts)
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text"))
        out = rows.join(full, ["digest", "text"])
    out = out.select("doc_id", "keep_id", "group_size", F.lower(F.hex("digest")).alias("text_sha256"))
    # rows equal in id and text: the first stays
    again = F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy("keep_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (again == 1)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops; all columns stay, whatever their names. Of rows equal in id and text
    one stays."""
    scratch = Scratch(docs.sparkSession)
    won = exact_dedup(docs, id_col, text_col).filter("kept").select("doc_id", F.unhex("text_sha256").alias("place"))
    return only(docs, scratch.table(won), F.col(id_col).cast("long"), F.unhex(F.sha2(text_of(text_col).cast("binary"), 256)))


def op3_exact_dedup(spark, sf_dir):
    from .common import read

    return exact_dedup(read(spark, sf_dir, "documents"))


OP3_SQL = """
SELECT doc_id, keep_id, group_size,
       doc_id = keep_id AND row_number() OVER (PARTITION BY text, doc_id) = 1 AS kept, sha256(text) AS text_sha256
FROM (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text,
             CAST(max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS BIGINT) AS keep_id,
             count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size
      FROM documents)
"""
