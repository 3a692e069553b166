"""SimHash near-dedup: fingerprints cut into blocks, joined on blocks, verified by Hamming distance.

Fingerprints that differ in at most `distance` bits agree on all but `distance` of `blocks` blocks, whichever way the 64
bits are cut. So each distinct fingerprint is keyed by every choice of blocks - distance blocks, close pairs share a key,
and what shares a key is verified. The number of blocks grows with the number of distinct fingerprints: a key then has
enough bits that unrelated fingerprints rarely share it. It changes the cost, not the result.

Equal fingerprints are one node from the start. Within a key, a search from node to node over the fingerprints not yet
reached emits a spanning forest of the verified links, never all pairs. Keys with more than `crowd` fingerprints take
another exact way: each of their fingerprints is sent to every value within distance / 2 bits of it (a hub). Two
fingerprints are within `distance` bits exactly if one reaches a hub in distance / 2 bits, rounded down, and the other in
as many, rounded up; the work is linear in their number. Heavy keys are found beforehand by counting, at most HEAVY for
each choice of blocks, and never gathered in one task.

Nulls: a null text is empty, its fingerprint zero. A null id has a component as any other row; the component's id is the
least that isn't null. Repeated rows each give a row. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HEAVY, Scratch, attach, read, text_of, width
from .components import components

WORDS, DISTANCE, CROWD = 4, 4, 4096
_SLICE = 1 << 14


def shingle_hashes(text: str, words: int):
    """The XXH64 of each shingle of the text in order, repeats included, some at a time; one with fewer words is one
    shingle, one without words gives nothing. Holds a few bytes a byte of the text and a slice of the hashes."""
    joined = b" ".join(text.encode("utf-8", "surrogatepass").lower().split())  # bytes: A-Z and ASCII blanks only
    if not joined:
        return
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))
    h = xxhash.xxh64_intdigest
    if len(ends) <= words:
        yield np.array([h(joined, 42)], np.uint64)
        return
    starts = np.concatenate(([0], ends[:-words] + 1))
    ends = ends[words - 1 :]
    for i in range(0, len(ends), _SLICE):
        own = zip(starts[i : i + _SLICE].tolist(), ends[i : i + _SLICE].tolist(), strict=True)
        yield np.array([h(joined[a:b], 42) for a, b in own], np.uint64)


def fingerprint_of(slices) -> int:
    """The 64-bit fingerprint of slices of hashes: bits that more than half of them have."""
    n, ones = 0, np.zeros(64, np.int64)
    for hashes in slices:
        n += len(hashes)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">u8")[0])


def fingerprint(text: str, words: int = WORDS) -> int:
    """The fingerprint of a text's shingles; zero without words."""
    return fingerprint_of(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def blocks_for(n: int, distance: int) -> int:
    """Blocks such that a key of blocks - distance of them has about one fingerprint among n unrelated ones."""
    blocks = distance + 2
    while blocks < 3 * distance and 2 ** (64 * (blocks - distance) / blocks) < n:
        blocks += 1
    return blocks


def masks(blocks: int, distance: int) -> list[int]:
    """For each choice of blocks - distance blocks, the bits in them, as signed longs."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [int(np.uint64(sum(block[i] for i in kept)).view(np.int64)) for kept in combinations(range(blocks), blocks - distance)]


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join the same fingerprints as all pairs within distance do."""
    out, rest = [], fps.view(np.uint64)  # of signed numbers, bitwise_count counts the bits of the absolute value
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            u = queue.pop()
            near = np.bitwise_count(rest ^ u) <= distance
            if near.any():
                found = rest[near]
                out += [(int(u.view(np.int64)), int(v)) for v in found.view(np.int64)]
                queue += list(found)
                rest = rest[~near]
    return out


def _links(keyed: DataFrame, distance: int, crowd: int) -> DataFrame:
    """a, b: verified links; b null where a stands under a crowded key. keyed: sorted by (t, v) within its partitions."""

    def run(batches):
        key, held, crowded = None, [], False

        def done():
            if len(held) > 1:
                yield from forest(np.array(held, np.int64), distance)

        def batch(links):
            a, b = zip(*links, strict=True) if links else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for rb in batches:
            links = []
            t, v, fp = (c.to_numpy() for c in rb.columns)
            cuts = np.flatnonzero((t[1:] != t[:-1]) | (v[1:] != v[:-1])) + 1
            for part in np.split(np.arange(len(t)), cuts) if len(t) else []:
                k = (t[part[0]], v[part[0]])
                if k != key:
                    links += done()
                    key, held, crowded = k, [], False
                if crowded:
                    links += [(int(x), None) for x in fp[part]]
                else:
                    held += fp[part].tolist()
                    if len(held) > crowd:
                        links += [(x, None) for x in held]
                        held, crowded = [], True
            yield batch(links)
        yield batch(list(done()))

    return keyed.mapInArrow(run, "a long, b long")


def hubs(crowded: DataFrame, distance: int) -> DataFrame:
    """a, b: fingerprints of crowded keys, each linked to the least one that is in reach of a hub of its own."""

    def flips(most: int) -> list[int]:
        return [int(np.uint64(sum(1 << i for i in bits)).view(np.int64)) for k in range(most + 1) for bits in combinations(range(64), k)]

    near, reach = len(flips(distance // 2)), flips(distance - distance // 2)

    def run(batches):
        f = np.array(reach, np.int64)
        inner = pa.array(np.arange(len(f)) < near)
        for rb in batches:
            for x in rb.column(0).to_numpy():
                yield pa.RecordBatch.from_arrays([pa.array(f ^ x), pa.array(np.full(len(f), x)), inner], ["hub", "fp", "inner"])

    at = crowded.mapInArrow(run, "hub long, fp long, inner boolean")
    least = at.groupBy("hub").agg(F.min(F.when(F.col("inner"), F.col("fp"))).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND least IS NOT NULL")
    return at.join(least, "hub").select(F.col("fp").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()


def links_of(nodes: DataFrame, n: int, distance: int, crowd: int, scratch: Scratch, parts: int) -> DataFrame:
    """a, b: links that join the fingerprints of nodes (distinct fp, n rows) as all pairs within distance do."""
    choices = masks(blocks_for(n, distance), distance)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(choices)]))
    keyed = nodes.select("fp", keys.alias("k")).select("k.t", "k.v", "fp")
    heavy = keyed.groupBy("t", "v").count().filter(F.col("count") > max(crowd, n // HEAVY)).select("t", "v")
    heavy = scratch.table(heavy, HEAVY * len(choices))
    if heavy.isEmpty():
        light, direct = keyed, None
    else:  # fewer than HEAVY rows for each choice
        light = keyed.join(F.broadcast(heavy), ["t", "v"], "left_anti")
        direct = keyed.join(F.broadcast(heavy), ["t", "v"], "left_semi").select("fp").distinct()
    light = light.select("t", "v", "fp").repartition(parts, "t", "v").sortWithinPartitions("t", "v")
    links = scratch.table(_links(light, distance, crowd).distinct(), n * len(choices))
    crowded = links.filter("b IS NULL").select(F.col("a").alias("fp"))
    if direct is not None:
        crowded = crowded.unionByName(direct).distinct()
    edges = links.filter("b IS NOT NULL")
    crowded = scratch.table(crowded, n)
    if not crowded.isEmpty():
        edges = edges.unionByName(hubs(crowded, distance))
    return edges


def near_dedup(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable)."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table(fingerprints(docs, words, id_col, text_col))
    total = rows.count()
    nodes = scratch.table(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies")), total)
    n = nodes.count()
    roots = components(links_of(nodes, n, distance, crowd, scratch, width(docs)), scratch)
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least_id", "copies", F.coalesce("root", "fp").alias("root"))
    named = scratch.table(named, n)
    scratch.release(rows, named)
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    named = attach(named.select("fp", "copies", "root"), ids, "root", n, "members").select("fp", "copies", "component_id")
    out = attach(rows, named, "fp", total, "copies")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash(spark, sf_dir):
    return near_dedup(read(spark, sf_dir, "documents"))
