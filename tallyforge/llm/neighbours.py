"""Approximate nearest neighbours by largest inner product, on robust-pruned directed graphs.

Vectors are dealt into shards by hash. Each shard's task builds a directed graph: a greedy search from the entry
proposes neighbours for a vector, relaxed distance pruning keeps diverse ones, reverse links are pruned alike, and every
vector is made reachable. The index, one row a vector with its links, is written to the shared folder. A query goes to
every shard; the shard's task loads its graph, then streams through the queries in batches with a beam search. Scores of
what the beam holds are computed in double precision from the original vectors, and the shards' best are merged.

Equal vectors are one node, which carries the k + 1 least ids: no query needs more of them, and copies can't fill the
graph. A shard holds about `shard_rows` vectors, so a task's memory is bounded.

A graph compares single-precision distances, so vectors of very different magnitude go to different shards: one for each
BAND powers of two of the largest component. Shards and queries are scaled by powers of two before the search, so no
finite numbers overflow. Scores are those of the original vectors; where a sum of products leaves the range of doubles, it
is what the scaled vectors give (an infinity of the right sign, or zero), and such ties are ranked by the scaled score.

Vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take no part, nor
do rows without an id. Ties in score go to the smaller id. Rows repeated in id and vector count once. With fewer
candidates than k all are returned. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph
from .common import Scratch, read

K, BEAM, SHARD_ROWS, LEAST_SHARDS, EVERY, BAND = 20, 96, 25_000, 16, 20, 8
INDEX = "shard int, node int, ids array<long>, vec array<double>, links array<int>, entry int"


def usable(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, vec of the rows that take part."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0))
    usual = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("vec") == (usual["n"] if usual else 0))


def nodes(rows: DataFrame, k: int) -> DataFrame:
    """vec, ids: the distinct vectors, each with its k + 1 least ids."""
    first = rows.distinct().withColumn("_n", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).filter(F.col("_n") <= k + 1)
    return first.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def shards_of(rows: DataFrame, shard_rows: int, least_shards: int) -> tuple[int, Column]:
    """(number of shards, the column that deals vec into them). A band of magnitudes has shards of its own, as many as its
    rows ask for; there are at most 2100 / BAND bands."""
    band = F.floor(F.log2(F.array_max(F.transform("vec", F.abs))) / BAND).cast("int")
    counts = {r[0]: r[1] for r in rows.groupBy(band.alias("band")).count().collect()}
    total, first, found = max(1, sum(counts.values())), 0, []
    for b, n in sorted(counts.items()):
        own = max(-(-n // shard_rows), -(-n * least_shards // total))
        found += [F.lit(b), F.struct(F.lit(first).alias("first"), F.lit(own).alias("n"))]
        first += own
    if not found:
        return 1, F.lit(0)
    own = F.element_at(F.create_map(*found), band)
    return first, (own["first"] + F.pmod(F.xxhash64("vec"), own["n"])).cast("int")


def build_index(rows: DataFrame, shards: int, shard: Column, k: int = K, degree: int = graph.DEGREE, beam: int = graph.BUILD_BEAM, alpha: float = graph.ALPHA) -> DataFrame:
    """The index over rows (as usable() gives them)."""
    dealt = nodes(rows, k).withColumn("shard", shard)
    dealt = dealt.select("shard", "ids", "vec").repartition(shards, "shard").sortWithinPartitions("shard", "vec")

    def run(batches):
        for shard, table in _by_shard(batches):
            vecs = _matrix(table.column("vec").combine_chunks(), np.float64)
            links, entry = graph.build(graph.lifted(vecs), degree, beam, alpha)
            n = len(table)
            for lo in range(0, n, 4096):
                part, own = table.slice(lo, 4096), [x[x >= 0] for x in links[lo : lo + 4096]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), shard, np.int32)), pa.array(np.arange(lo, lo + len(own), dtype=np.int32)), part.column("ids").combine_chunks(), part.column("vec").combine_chunks(), pa.array(own, pa.list_(pa.int32())), pa.array(np.full(len(own), entry, np.int32))],
                    ["shard", "node", "ids", "vec", "links", "entry"],
                )

    return dealt.mapInArrow(run, INDEX)


def _by_shard(batches):
    """(shard, table) of rows sorted by shard."""
    held, at = [], None
    for b in batches:
        t = pa.Table.from_batches([b])
        s = t.column("shard").to_numpy()
        for part in np.split(np.arange(len(s)), np.flatnonzero(s[1:] != s[:-1]) + 1) if len(s) else []:
            if s[part[0]] != at:
                if held:
                    yield at, pa.concat_tables(held)
                held, at = [], s[part[0]]
            held.append(t.slice(part[0], len(part)))
    if held:
        yield at, pa.concat_tables(held)


class _Shard:
    def __init__(self, table: pa.Table):
        self.ids = table.column("ids").to_pylist()
        self.vecs = _matrix(table.column("vec").combine_chunks(), np.float64)
        links = table.column("links").to_pylist()
        self.links = np.full((len(links), max(map(len, links)) or 1), -1, np.int64)
        for i, x in enumerate(links):
            self.links[i, : len(x)] = x
        self.x = graph.lifted(self.vecs)
        self.entry = table.column("entry")[0].as_py()

    def best(self, ids: list[int], q: np.ndarray, k: int, beam: int):
        """(query's place, vec_id, score, rank among equal scores beyond the range of doubles) of the k best of each query."""
        small, e = graph.scaled(q)
        lifted = np.concatenate([small, np.zeros((len(q), 1))], axis=1).astype(np.float32)
        found, _ = graph.search(self.x, np.zeros(len(self.x), np.float32), self.links, self.entry, lifted, beam)  # all norms are equal
        for i, near in enumerate(found):
            near = near[near >= 0]
            vecs, exponents = graph.scaled(self.vecs[near])
            scores, far = (vecs * small[i]).sum(axis=1), exponents + e[i]
            with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
                plain = (self.vecs[near] * q[i]).sum(axis=1)
                plain = np.where(np.isfinite(plain) & (np.abs(far) < 900), plain, np.ldexp(scores, far))
                beyond = np.where(np.isinf(plain) | ((plain == 0) & (scores != 0)), np.sign(scores) * np.exp2((np.log2(np.abs(scores)) + far) / 4), 0.0)
            pairs = sorted((-s, -b, v) for s, b, n in zip(plain.tolist(), beyond.tolist(), near, strict=True) for v in self.ids[n] if v != ids[i])
            yield from ((i, v, -s, -b) for s, b, v in pairs[:k])


def search_index(index: DataFrame, queries: DataFrame, shards: int, k: int = K, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score. queries: vec_id, vec."""
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("links", "array<int>"), ("entry", "int"))]
    asked = queries.distinct().select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(-1).alias("node"), F.array("vec_id").alias("ids"), "vec", *nothing)
    both = index.withColumn("asks", F.lit(0)).unionByName(asked.withColumn("asks", F.lit(1)))
    both = both.repartition(shards, "shard").sortWithinPartitions("shard", "asks", "node")

    def run(batches):
        at, held, shard = None, [], None
        for b in batches:
            t = pa.Table.from_batches([b])
            key = t.column("shard").to_numpy().astype(np.int64) * 2 + t.column("asks").to_numpy()
            for part in np.split(np.arange(len(key)), np.flatnonzero(key[1:] != key[:-1]) + 1) if len(key) else []:
                s, asks = divmod(int(key[part[0]]), 2)
                own = t.slice(part[0], len(part))
                if s != at:
                    at, held, shard = s, [], None
                if not asks:
                    held.append(own)
                    continue
                if held:
                    shard, held = _Shard(pa.concat_tables(held)), []
                if shard is None:  # a shard without vectors
                    continue
                ids, q = [x[0] for x in own.column("ids").to_pylist()], _matrix(own.column("vec").combine_chunks(), np.float64)
                marks = q.view(np.int64).sum(axis=1).tolist()  # tells queries of one id apart
                out = list(shard.best(ids, q, k, beam))
                i, v, score, beyond = zip(*out, strict=True) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in i], pa.int64()), pa.array([marks[x] for x in i], pa.int64()), pa.array(v, pa.int64()), pa.array(score, pa.float64()), pa.array(beyond, pa.float64())], ["query_id", "q", "vec_id", "score", "beyond"])

    found = both.mapInArrow(run, "query_id long, q long, vec_id long, score double, beyond double")
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(table: DataFrame, every: int = EVERY, k: int = K, beam: int = BEAM, shard_rows: int = SHARD_ROWS, least_shards: int = LEAST_SHARDS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest of each row whose id is divisible by `every`, among all other rows."""
    rows = usable(table, id_col, vec_col)
    shards, shard = shards_of(rows, shard_rows, least_shards)
    index = Scratch(table.sparkSession).table(build_index(rows, shards, shard, k))
    return search_index(index, rows.filter(F.col("vec_id") % every == 0), shards, k, max(beam, k + 1))


def op2_neighbours(spark, sf_dir):
    return nearest(read(spark, sf_dir, "embeddings"))
