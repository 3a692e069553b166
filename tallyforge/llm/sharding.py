"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has `positions` places. Every shard owns `replicas` virtual nodes on it; a key's home is the first virtual node
at or after its place. Each shard has a capacity. Keys that find their home shard full go on clockwise to the next
virtual node whose shard has room, so no shard exceeds its bound, and a new shard moves few other keys.

Spark counts keys per ring position (at most `positions` rows, a parameter, whatever the table's size). The driver walks
the ring over these counts and writes a plan of rank ranges: position p, ranks a..b -> shard s, slots from t. Rows take
their slot by a join on (position, rank), so no task ever sees all rows of a position: ranks are dealt within salted
parts of a position and shifted by the parts before. The plan has at most 2 * positions + shards * replicas rows.

Nulls: a null text has 0 bytes; a null key is a key like any other. Repeated rows each get a slot of their own. Empty
table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import json

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, read, text_of, utf8_bytes

SALTS = 64


def ring(shards: int, replicas: int, positions: int) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node, in ring order. A shard's nodes don't depend on the number of shards."""
    return sorted((xxhash.xxh64_intdigest(f"shard {s} node {r}") % positions, s) for s in range(shards) for r in range(replicas))


def capacities(total: int, shards: int, slack: float) -> list[int]:
    """Rows that each shard takes: with no slack they sum to the total and differ by one at most."""
    if slack:
        return [-(-int(total * (1 + slack) * 1_000_000) // (shards * 1_000_000)) + 1] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def plan(counts: dict[int, int], shards: int, replicas: int, positions: int, slack: float = 0.0) -> list[tuple[int, int, int, int, int]]:
    """Runs (position, first rank, ranks' end, shard, slot of the first rank)."""
    nodes = ring(shards, replicas, positions)
    places = [p for p, _ in nodes]
    room, used, runs = capacities(sum(counts.values()), shards, slack), [0] * shards, []
    left: dict[int, int] = {}

    def put(p: int, s: int) -> None:
        done = counts[p] - left[p]
        n = min(left[p], room[s])
        if n:
            runs.append((p, done, done + n, s, used[s]))
            room[s] -= n
            used[s] += n
            left[p] -= n

    for p in sorted(counts):  # homes first
        left[p] = counts[p]
        put(p, nodes[bisect.bisect_left(places, p) % len(nodes)][1])
    for p in sorted(counts):  # then what overflows goes on clockwise
        at = bisect.bisect_left(places, p)
        step = 0
        while left[p]:
            put(p, nodes[(at + step) % len(nodes)][1])
            step += 1
    return runs


def shard(docs: DataFrame, shards: int = 24, replicas: int = 64, positions: int = 1 << 14, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    slack 0: every shard holds total / shards rows, rounded up or down (law "rows"). A larger slack moves fewer keys
    when a shard is added; a shard then holds (1 + slack) * total / shards rows at most.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (utf8_bytes(text) + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(positions)).cast("int").alias("position"),
        (F.spark_partition_id() % SALTS).alias("salt"),
    )
    rows = scratch.table(rows)  # fixes the salt; what follows may run again
    parts = rows.groupBy("position", "salt").agg(F.count(F.lit(1)).alias("n"))
    counts = {r[0]: r[1] for r in parts.groupBy("position").agg(F.sum("n").alias("n")).collect()}  # <= positions rows
    runs = plan(counts, shards, replicas, positions, slack) if counts else []
    before = F.sum("n").over(Window.partitionBy("position").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("position", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("position", "salt").orderBy("doc_id", "size", "text_crc32")) - 1
    ranked = rows.withColumn("within", within).join(parts, ["position", "salt"])
    ranked = ranked.withColumn("rank", F.col("within") + F.col("before"))
    kind = "array<struct<p:int,lo:bigint,hi:bigint,shard:int,slot:bigint>>"
    text_plan = json.dumps([dict(zip(("p", "lo", "hi", "shard", "slot"), r, strict=True)) for r in runs])
    table = spark.range(1).select(F.inline(F.from_json(F.lit(text_plan), kind)).alias("p", "lo", "hi", "shard", "first"))
    out = ranked.join(F.broadcast(table), (F.col("position") == F.col("p")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    law = "rows" if not slack else "bounded"
    return out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("first") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark, sf_dir):
    return shard(read(spark, sf_dir, "documents"))
