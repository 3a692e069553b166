"""Near-dedup by the similarity of word shingles: SimHash blocks and min-hash bands propose, the whole sets decide.

A text is the set of its shingles of `words` lower-cased (A-Z) words; one with fewer words is a single shingle, one without
words the empty set. Equal sets are one node from the start. Candidates are

1. nodes whose SimHash fingerprints share a block key and differ in at most `distance` bits (simhash.links_of), and nodes
   of one fingerprint;
2. nodes that share one of BANDS keys of ROWS min-hashes each. Fingerprints of texts of similarity 0.8 differ in about 10
   bits, which no choice of blocks finds; two texts of that similarity share a min-hash key with probability
   1 - (1 - 0.8**ROWS)**BANDS = 0.9998.

A link always comes from a check of the whole sets. First, within a min-hash key, each node is compared with the `window`
nodes before it, in an order that is another for each band. These comparisons are of sketches, a byte of each of the 64
min-hashes; of a pair of similarity 0.8 fewer than AGREE agree with probability 3e-4. The whole sets of each node and the
one most like it by sketch are checked, one pair a node and key. Where that leaves nodes of a key in different components,

- all pairs of a key of up to window + 1 nodes that agree in AGREE bytes are compared once more, by the LOW least hashes of
  either set: that is exact for sets of up to LOW shingles and misses one of larger ones with probability 3e-6. So what
  reaches the check grows with the links, not with the square of a key;
- the nodes of wider keys are joined by the rarest shingles of their sets (_by_prefix), which loses no pair, whatever the
  key's width: nodes meet only in shingles that are rare for both. A shingle that many nodes have among their rarest is
  cut into blocks that other tasks compare; only there the work may grow with the square of the nodes.

Nulls: a null text is empty; all empty texts are one node. A null id has a component as any other row; the component's id is
the least that isn't null. Repeated rows each give a row. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import Scratch, attach, only, text_of, width
from .components import components

WORDS, SIMILARITY, BANDS, ROWS, WINDOW, AGREE, LOW = 5, 0.8, 16, 4, 1024, 40, 256
#: Buckets of shingles whose sets are counted; nodes of a shingle that a task compares with as many; bits of a set's bitmap.
BUCKETS, BLOCK, BITS = 1 << 19, 4096, 512
_MULTIPLY = np.random.default_rng(17).integers(0, 2**63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(18).integers(0, 2**63, (BANDS * ROWS, 1), np.uint64)
_SLICE = 1 << 12


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The hashes of the text's shingles, each once, in order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *simhash.shingle_hashes(text, words)]))


def bands(found: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(the key of each band, the sketch)."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(found), _SLICE):
        least = np.minimum(least, (found[i : i + _SLICE] * _MULTIPLY + _ADD).min(axis=1))
    keys = np.array([xxhash.xxh64_intdigest(b.tobytes(), 3) for b in least.reshape(BANDS, ROWS)], np.uint64).view(np.int64)
    return keys, (least >> np.uint64(20)).astype(np.uint8).tobytes()


def least_agreement(similar: float) -> int:
    """How many bytes of the sketches of a pair must agree: AGREE at 0.8, as many standard deviations below the mean else."""
    mean = similar + (1 - similar) / 256
    off = (0.8008 * BANDS * ROWS - AGREE) / (BANDS * ROWS * 0.8008 * 0.1992) ** 0.5
    return max(0, int(BANDS * ROWS * mean - off * (BANDS * ROWS * mean * (1 - mean)) ** 0.5))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def may_be_similar(low: np.ndarray, others: np.ndarray, size: int, sizes: np.ndarray, similar: float) -> np.ndarray:
    """Which of the others (rows of least hashes in order, filled up with the largest number) may be so similar to low."""
    top = np.uint32(0xFFFFFFFF)
    last = np.where(sizes > others.shape[1], others[:, -1], top)  # up to here either set is known whole
    last = np.minimum(last, low[-1] if size > len(low) else top)[:, None]
    at = np.minimum(np.searchsorted(low, others), len(low) - 1)
    both = ((low[at] == others) & (others <= last) & (others < top)).sum(axis=1)
    union = ((others <= last) & (others < top)).sum(axis=1) + np.searchsorted(low, last[:, 0], side="right") - both
    whole = (sizes <= others.shape[1]) & (size <= others.shape[1])
    slack = np.where(whole, 0.02, 4.5 * np.sqrt(similar * (1 - similar) / np.maximum(union, 1)))
    return both >= (similar - slack) * union


def _node(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 5)).view(np.int64))


def _rows(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, place (a digest of the text), node, size, fp, bands and sketch of each row."""

    def run(batches):
        for b in batches:
            node, size, fp, keys, sketch = [], [], [], [], []
            for t in b.column(2):
                hashes = list(simhash.shingle_hashes(t.as_py(), words))
                found = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))
                node.append(_node(found))
                size.append(len(found))
                fp.append(simhash.fingerprint_of(hashes))
                key, own = bands(found)
                keys.append(key)
                sketch.append(own)
            columns = [b.column(0), b.column(1), pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "place", "node", "size", "fp", "bands", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), place_of(text_col).alias("place"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, place binary, node long, size int, fp long, bands array<long>, sketch binary")


def place_of(text_col: str):
    return F.unhex(F.md5(text_of(text_col).cast("binary")))


def _in_windows(keyed: DataFrame, window: int, similar: float, best: bool, parts: int) -> DataFrame:
    """a, b: nodes near each other in a key's order that stand under different roots and may be similar; best: for each node
    only the likeliest before it. keyed: t, v, node, size, root, sketch and, unless best, low (the LOW least hashes, their upper halves)."""
    least, step = least_agreement(similar), 256

    def compared(node, size, root, sketch, low, first):
        """Pairs of the rows from `first` on with rows before them."""
        out = []
        for lo in range(first, len(node), step):
            hi, back = min(lo + step, len(node)), max(0, lo - window)
            agree = (sketch[lo:hi, None, :] == sketch[None, back:hi, :]).sum(axis=2, dtype=np.int16)
            far = np.arange(lo, hi)[:, None] - np.arange(back, hi)[None]
            may = (far > 0) & (far <= window) & (root[lo:hi, None] != root[None, back:hi]) & (agree >= least)
            may &= np.minimum(size[lo:hi, None], size[None, back:hi]) >= similar * np.maximum(size[lo:hi, None], size[None, back:hi])
            i, j = np.nonzero(may)
            if not best and len(i):
                fits = np.zeros(len(i), bool)
                starts = np.flatnonzero(np.diff(i, prepend=-1))
                for a, b in zip(starts, np.append(starts[1:], len(i)), strict=True):
                    x, y = lo + i[a], back + j[a:b]
                    fits[a:b] = may_be_similar(low[x][: min(size[x], LOW)], low[y], size[x], size[y], similar)
                i, j = i[fits], j[fits]
            if best:
                i = np.flatnonzero(may.any(axis=1))
                j = np.where(may[i], agree[i], -1).argmax(axis=1)
            out.append(np.stack([node[lo:hi][i], node[back:hi][j]]))
        return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)

    def run(batches):
        key, held = None, None
        for rb in batches:
            t, v, node, size, root = (c.to_numpy() for c in rb.columns[:5])
            sketch = np.frombuffer(b"".join(rb.column(5).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
            low = np.zeros((len(t), 0 if best else LOW), np.uint32)
            if not best:
                low[:] = 0xFFFFFFFF
                for k, x in enumerate(rb.column(6)):
                    own = np.frombuffer(x.as_buffer(), np.uint32)
                    low[k, : len(own)] = own
            cuts = np.concatenate(([0], np.flatnonzero((t[1:] != t[:-1]) | (v[1:] != v[:-1])) + 1, [len(t)]))
            found = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = [c[lo:hi] for c in (node, size, root, sketch, low)]
                if hi > lo and (t[lo], v[lo]) == key:  # what goes on from the batch before
                    first = len(held[0])
                    part = [np.concatenate(c) for c in zip(held, part, strict=True)]
                else:
                    first = 0
                if hi - lo + first > 1:
                    found.append(compared(*part, first))
                if hi > lo:
                    key, held = (t[lo], v[lo]), [c[-window:] for c in part]
            pairs = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], ["a", "b"])

    keyed = keyed.select("t", "v", "node", "size", "root", "sketch", *["low"] * (not best)).repartition(parts, "t", "v").sortWithinPartitions("t", "v", F.xxhash64("t", "node"))
    return keyed.mapInArrow(run, "a long, b long")


def _held(sets: DataFrame) -> np.ndarray:
    """How many sets hold a shingle of each bucket."""

    def run(batches):
        n = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for x in b.column(0):
                np.add.at(n, np.frombuffer(x.as_buffer(), np.uint64) % BUCKETS, 1)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(n[own], pa.int64())], ["bucket", "n"])

    held = sets.select("found").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(BUCKETS, np.int64)
    n[held["bucket"].to_numpy()] = held["n"].to_numpy()
    return n


def bitmap(found: np.ndarray) -> bytes:
    """For each of BITS bits whether an odd number of shingles falls on it: sets whose bitmaps differ in d bits differ in at
    least d shingles."""
    return np.packbits(np.bincount((found >> np.uint64(40)) % BITS, minlength=BITS) & 1).tobytes()


def _by_prefix(sets: DataFrame, similar: float, scratch: Scratch, parts: int) -> DataFrame:
    """a, b: all pairs of nodes under different roots whose sets are so similar, and some that are less. sets: node, root, found.

    With its shingles in one order for all sets, rarest first, a set of n shares one of its first n - ceil(similar * n) + 1
    with any set so similar. From the first that a pair shares on, both must have enough left for the overlap it needs.
    The order is by the count of a shingle's bucket, then by hash; a coarse count costs time and no pair. Bitmaps then rule
    out pairs that differ in too many shingles; that loses none either."""
    sent = sets.sparkSession.sparkContext.broadcast(_held(sets))
    share, block = similar / (1 + similar), BLOCK

    def rarest(batches):
        for b in batches:
            node, root = b.column(0).to_numpy(), b.column(1).to_numpy()
            rows, size = [], 0
            for k, x in enumerate(b.column(2)):
                found = np.frombuffer(x.as_buffer(), np.uint64)
                n, held = len(found), sent.value[found % BUCKETS]
                first = np.argsort(held, kind="stable")[: n - int(np.ceil(similar * n - 1e-9)) + 1]
                left = n - np.arange(len(first))
                own = held[first] > 1  # a shingle alone in its bucket is in no other set
                rows.append((found[first[own]].view(np.int64), np.full(own.sum(), node[k]), np.full(own.sum(), root[k]), np.full(own.sum(), n), left[own]))
                size += own.sum()
                if size > 1 << 16 or k == len(b) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.int32()] * 2, strict=True)], ["h", "node", "root", "size", "left"])
                    rows, size = [], 0

    def bits(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bitmap(np.frombuffer(x.as_buffer(), np.uint64)) for x in b.column(1)], pa.binary())], ["node", "bits"])

    def compared(cols):
        """Pairs within the groups (h, cell) of rows in order, some at a time. Within a group left - share * size falls, so
        what a row can be paired with ends where that falls below share * its size."""
        h, cell, side, node, root, size, left, bit = cols
        end = np.append(np.flatnonzero((h[1:] != h[:-1]) | (cell[1:] != cell[:-1])) + 1, len(h))
        group = np.repeat(np.arange(len(end)), np.diff(end, prepend=0)) * 2.0**30
        end = np.minimum(np.repeat(end, np.diff(end, prepend=0)), np.searchsorted(group - (left - share * size), group - share * size + 0.1, side="right"))
        within = cell // (1 << 31) == cell % (1 << 31)  # else only the pairs of two blocks
        found, many, d, i = [], 0, 1, np.arange(len(h))
        while len(i := i[end[i] - i > d]):
            j = i + d
            need = share * (size[i] + size[j]) - 1e-6
            may = (root[i] != root[j]) & (within[i] | (side[i] != side[j])) & (np.minimum(left[i], left[j]) >= need)
            x, y = i[may], j[may]
            fit = np.bitwise_count(bit[x] ^ bit[y]).sum(axis=1) <= size[x] + size[y] - 2 * need[may]
            found.append(np.stack([np.minimum(node[x[fit]], node[y[fit]]), np.maximum(node[x[fit]], node[y[fit]])]))
            many += fit.sum()
            if many > 1 << 18:
                yield np.unique(np.concatenate(found, axis=1), axis=1)
                found, many = [], 0
            d += 1
        yield np.unique(np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1), axis=1)

    def run(batches):
        held = None
        for rb in batches:
            if not len(rb):
                continue
            cols = [c.to_numpy() for c in rb.columns[:7]]
            cols.append(np.frombuffer(b"".join(rb.column(7).to_pylist()), np.uint64).reshape(-1, BITS // 64))
            if held is not None:
                cols = [np.concatenate(c) for c in zip(held, cols, strict=True)]
            last = int(np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1])).max(initial=-1)) + 1
            held = [c[last:] for c in cols]  # may go on in the next batch
            for pairs in compared([c[:last] for c in cols]):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pairs], ["a", "b"])
        for pairs in compared(held) if held else ():
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pairs], ["a", "b"])

    rare = scratch.table(sets.select("node", "root", "found").mapInArrow(rarest, "h long, node long, root long, size int, left int"))
    seen = rare.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("n > 1 AND low <> high")
    rare = attach(rare, seen.select("h", "n"), "h", rare.count(), "n").filter("n IS NOT NULL")
    rare = rare.withColumn("cuts", F.ceil(F.col("n") / block)).withColumn("side", F.pmod(F.xxhash64("node"), F.col("cuts")))
    rare = rare.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
    cell = F.shiftleft(F.least("side", "other"), 31) + F.greatest("side", "other")
    rare = rare.select("h", cell.alias("cell"), "side", "node", "root", "size", "left")
    rare = rare.join(sets.select("node", "found").mapInArrow(bits, "node long, bits binary"), "node").select("h", "cell", "side", "node", "root", "size", "left", "bits")
    return rare.repartition(parts, "h", "cell").sortWithinPartitions("h", "cell", F.col("size") * share - F.col("left")).mapInArrow(run, "a long, b long")


def _sets(needed: DataFrame, rows: DataFrame, docs: DataFrame, words: int, text_col: str, scratch: Scratch) -> DataFrame:
    """node, root, found (the whole set), low (its LOW least hashes, their upper halves) of the nodes needed (node, root)."""
    places = needed.join(rows.groupBy("node").agg(F.min("place").alias("place")), "node").select("node", "root", "place")

    def of(batches):
        for b in batches:
            lo, found, low, size = 0, [], [], 0
            for k, text in enumerate(b.column(2)):
                own = shingles(text.as_py(), words)
                found.append(own.tobytes())
                low.append((own[:LOW] >> np.uint64(32)).astype(np.uint32).tobytes())
                size += len(found[-1])
                if size > 4 << 20 or k == len(b) - 1:  # bounds what a batch holds
                    part = b.slice(lo, len(found))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.binary()), pa.array(low, pa.binary())], ["node", "root", "found", "low"])
                    lo, found, low, size = k + 1, [], [], 0

    texts = docs.select(text_of(text_col).alias("text"), place_of(text_col).alias("place"))
    texts = texts.join(places, "place").dropDuplicates(["place"]).select("node", "root", "text")
    return scratch.table(texts.mapInArrow(of, "node long, root long, found binary, low binary"))


def _pairs(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    return scratch.table(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), few=True)


def _ends(pairs: DataFrame) -> DataFrame:
    """node, n: how many pairs name it."""
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))


def _similar(pairs: DataFrame, sets: DataFrame, similar: float, scratch: Scratch) -> DataFrame:
    """a, b: the pairs whose sets are at least so similar. pairs: as _pairs() gives them."""
    total = pairs.count()
    sets = sets.select("node", "found").join(_ends(pairs), "node")

    def check(batches):
        for rb in batches:
            whole = [np.frombuffer(x.as_buffer(), np.uint64) for x in rb.column(2)], [np.frombuffer(x.as_buffer(), np.uint64) for x in rb.column(3)]
            near = pa.array([similarity(x, y) >= similar for x, y in zip(*whole, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([rb.column(0).filter(near), rb.column(1).filter(near)], ["a", "b"])

    both = attach(pairs, sets.select(F.col("node").alias("a"), "n", F.col("found").alias("own")), "a", total, "n").drop("n")
    both = attach(both, sets.select(F.col("node").alias("b"), "n", F.col("found").alias("other")), "b", total, "n")
    return scratch.table(both.select("a", "b", "own", "other").mapInArrow(check, "a long, b long"), total)


def _named(docs: DataFrame, scratch: Scratch, words: int, similar: float, window: int, distance: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, place, component_id, root of each row."""
    rows = scratch.table(_rows(docs, words, id_col, text_col))
    total = rows.count()
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = scratch.table(nodes, 8 * total)  # wide rows
    n = nodes.count()
    prints = scratch.table(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")), n)
    links = simhash.links_of(prints, prints.count(), distance, simhash.CROWD, scratch, width(docs))
    at = lambda end: prints.select(F.col("fp").alias(end), F.col("first").alias(f"node_{end}"))
    by_print = links.join(at("a"), "a").join(at("b"), "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    alike = attach(nodes.select("node", "fp"), prints, "fp", n, "n").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    keyed = nodes.select("node", F.posexplode("bands").alias("t", "v"))
    keyed = keyed.join(keyed.groupBy("t", "v").count().filter("count > 1").select("t", "v"), ["t", "v"], "left_semi")
    keyed = scratch.table(keyed.select("t", "v", "node"), few=True)
    whole = nodes.select("node", "size", "sketch")
    rooted = keyed.join(whole.withColumn("root", F.col("node")), "node")
    pairs = _pairs(by_print.unionByName(alike).unionByName(_in_windows(rooted, window, similar, True, width(docs))), scratch)
    links = _similar(pairs, _sets(_ends(pairs).select("node", F.lit(None).cast("long").alias("root")), rows, docs, words, text_col, scratch), similar, scratch)
    roots = components(links, scratch)
    rooted = keyed.join(whole.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "node")
    mixed = rooted.groupBy("t", "v").agg(F.min("root").alias("low"), F.max("root").alias("high"), (F.count(F.lit(1)) > window + 1).alias("wide")).filter("low <> high").select("t", "v", "wide")
    rooted = scratch.table(rooted.join(mixed, ["t", "v"]), few=True)
    sets = _sets(rooted.groupBy("node").agg(F.max(F.when(F.col("wide"), F.col("root"))).alias("root")), rows, docs, words, text_col, scratch)
    pairs = _in_windows(rooted.filter("NOT wide").join(sets.select("node", "low"), "node"), window, similar, False, width(docs))
    wide = sets.filter("root IS NOT NULL")
    if not wide.isEmpty():
        pairs = pairs.unionByName(_by_prefix(wide, similar, scratch, width(docs)))
    pairs = _pairs(pairs, scratch)
    links = links.unionByName(_similar(pairs, sets, similar, scratch))
    roots = components(links, scratch)
    named = nodes.join(roots, "node", "left").select("node", "least_id", "copies", F.coalesce("root", "node").alias("root"))
    named = scratch.table(named, n)
    scratch.release(rows, named)
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    named = attach(named.select("node", "copies", "root"), ids, "root", n, "members").select("node", "copies", "component_id", "root")
    return attach(rows.select("doc_id", "place", "node"), named, "node", total, "copies").select("doc_id", "place", "component_id", "root")


def near_dedup(docs: DataFrame, words: int = WORDS, similar: float = SIMILARITY, window: int = WINDOW, distance: int = simhash.DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, component_id (the least doc_id reachable over pairs at least so similar)."""
    return _named(docs, Scratch(docs.sparkSession), words, similar, window, distance, id_col, text_col).select("doc_id", "component_id")


def kept_rows(docs: DataFrame, words: int = WORDS, similar: float = SIMILARITY, window: int = WINDOW, distance: int = simhash.DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, that of the least id (null ids last; of rows of one id, any one); all columns
    stay, whatever their names."""
    scratch = Scratch(docs.sparkSession)
    named = _named(docs, scratch, words, similar, window, distance, id_col, text_col)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "place")
    won = named.groupBy("root").agg(F.min(order).alias("w")).select(F.col("w.doc_id").alias("doc_id"), F.col("w.place").alias("place"))
    return only(docs, scratch.table(won), F.col(id_col).cast("long"), place_of(text_col))
