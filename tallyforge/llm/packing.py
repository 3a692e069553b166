"""Best-fit packing planned on the histogram of lengths.

Documents are encoded and cut into pieces of at most `limit` tokens. The histogram of piece lengths has at most `limit`
bins, whatever the corpus; the driver runs best-fit decreasing on these counts, moving whole runs of equal sequences at a
time, and writes the plan as runs: pieces of length L with ranks a..b take sequences from s at offset o. Pieces take
their planned places by a join on (length, rank). Ranks are dealt within salted parts of a length and shifted by the
parts before; a length has as many parts as it has `part_rows` rows, so one that most pieces share isn't one task.

Encoding uses the vocabulary's ranks in a faster library than the one the file is made for; both apply the same merges
to the matches of the same pattern, and tests hold their ids against each other.

Nulls: a null text is empty (the end id alone); a null id stays null. Repeated rows are packed each. A long text is cut
into pieces; only its first may be shorter than limit. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import USUAL, spans
from .common import Scratch, read, text_of

LIMIT, END, PART_ROWS = 1024, 2, 20_000
#: Spans that a worker remembers the ids of.
REMEMBER = 400_000


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others as characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _json_encoder(path: str):
    """(encode, specials): encode gives a text's ids; special strings in it count as special tokens, as by default."""
    import tiktoken
    import tokenizers

    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    model, pre = made["model"], made["pre_tokenizer"] or {}
    of = _byte_of_char()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [model["vocab"].get(a + b) for a, b in merges]
    special = {t["content"]: t["id"] for t in made["added_tokens"]}
    simple = (
        made["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"]
        and model["type"] == "BPE" and not model["dropout"] and not model["ignore_merges"] and all(x is not None for x in order) and order == sorted(order)
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in made["added_tokens"])
    )
    if not simple:
        t = tokenizers.Tokenizer.from_file(path)
        return (lambda text: t.encode(text, add_special_tokens=False).ids), None
    ranks = {bytes(of[c] for c in word): i for word, i in model["vocab"].items() if word not in special}
    enc = tiktoken.Encoding("own", pat_str=USUAL, mergeable_ranks=ranks, special_tokens=special)
    return (lambda text: enc.encode(text, allowed_special="all", disallowed_special=())), [*special]


_known: dict[str, dict[str, bytes]] = {}


def ids_of(text: str, path: str) -> bytes:
    """The text's token ids as little-endian unsigned 32-bit integers."""
    encode, special = _json_encoder(path)
    if special is None or any(s in text for s in special):
        return np.array(encode(text), "<u4").tobytes()
    known, parts = _known.setdefault(path, {}), spans(text)
    try:
        return b"".join(map(known.__getitem__, parts))
    except KeyError:
        pass
    own = {}
    for s in set(parts):
        if s not in known:
            own[s] = np.array(encode(s), "<u4").tobytes()
    if len(known) + len(own) <= REMEMBER:
        known.update(own)
        return b"".join(map(known.__getitem__, parts))
    return b"".join([own[s] if s in own else known[s] for s in parts])


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the first may be shorter, the others have limit."""
    first = n % limit or limit
    return [(0, first)] + [(s, limit) for s in range(first, n, limit)]


def pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end: int = END, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        tail = np.array([end], "<u4").tobytes()
        for b in batches:
            out = [[] for _ in names]
            size = 0
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = ids_of(text, tokenizer) + tail
                for k, (s, n) in enumerate(cut(len(ids) // 4, limit)):
                    part = ids[4 * s : 4 * (s + n)]
                    for column, x in zip(out, (i, k, s, n, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int32) if with_ids else None), strict=False):
                        column.append(x)
                    size += n * with_ids
                if size > 1 << 22:
                    yield batch(out)
                    out, size = [[] for _ in names], 0
            yield batch(out)

    def batch(out):
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def plan(counts: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing on counts: runs (length, first rank, ranks' end, first sequence, offset)."""
    rooms: dict[int, list[tuple[int, int]]] = {}  # free tokens -> intervals of sequences
    runs, opened = [], 0

    def fill(length, rank, lo, hi, room, each):
        """each pieces in every sequence of lo..hi, which have that room."""
        for j in range(each):
            runs.append((length, rank, rank + hi - lo, lo, limit - room + j * length))
            rank += hi - lo
        left = room - each * length
        if left:
            rooms.setdefault(left, []).append((lo, hi))
        return rank

    for length in sorted(counts, reverse=True):
        rank, n = 0, counts[length]
        for room in sorted(r for r in rooms if r >= length):
            each, intervals = room // length, rooms.pop(room)
            while intervals and rank < n:
                lo, hi = intervals.pop()
                k = min(hi - lo, (n - rank) // each)
                if k:
                    rank = fill(length, rank, lo, lo + k, room, each)
                    lo += k
                if lo < hi and 0 < n - rank < each:
                    rank = fill(length, rank, lo, lo + 1, room, n - rank)
                    lo += 1
                if lo < hi:
                    intervals.append((lo, hi))
            if intervals:
                rooms.setdefault(room, []).extend(intervals)
            if rank == n:
                break
        if rank < n:
            each = limit // length
            k = (n - rank) // each
            if k:
                rank = fill(length, rank, opened, opened + k, limit, each)
                opened += k
            if rank < n:
                rank = fill(length, rank, opened, opened + 1, limit, n - rank)
                opened += 1
    return runs


def pack(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end: int = END, with_ids: bool = False, part_rows: int = PART_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    made = pieces(docs, tokenizer, limit, end, with_ids, id_col, text_col)
    rows = scratch.table(made.withColumn("no", F.monotonically_increasing_id()))  # fixes the number; what follows may run again
    counts = {r[0]: r[1] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= limit rows
    salts = F.from_json(F.lit(json.dumps([-(-counts.get(n, 1) // part_rows) for n in range(limit + 1)])), "array<int>")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("no"), salts[F.col("length").cast("int")]))
    parts = rows.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    runs = json.dumps([dict(zip(("l", "lo", "hi", "s", "o"), r, strict=True)) for r in plan(counts, limit)])
    table = spark.range(1).select(F.inline(F.from_json(F.lit(runs), "array<struct<l:bigint,lo:bigint,hi:bigint,s:bigint,o:bigint>>")).alias("l", "lo", "hi", "s", "o"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("no")) - 1
    ranked = rows.withColumn("within", within).join(parts, ["length", "salt"]).withColumn("rank", F.col("within") + F.col("before"))
    out = ranked.join(F.broadcast(table), (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return out.select(*columns, (F.col("s") + F.col("rank") - F.col("lo")).alias("sequence_id"), F.col("o").alias("offset"), *["ids"] * with_ids)


def op5_packing(spark, sf_dir):
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
