"""Best-fit packing against the tokenizer library and the rules of packing."""

import random
import struct
import zlib

import public_tokenizers
from tokenizers import Tokenizer

from tallyforge.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_equal_the_library():
    t, rnd = Tokenizer.from_file(PATH), random.Random(5)
    alpha = list("ab1 'sté\n\t\r\x1c\x85\xa0　▁.,漢字 ​\x00😀'll ") + ["<|endoftext|>", "the", " word"]
    for _ in range(3000):
        text = "".join(rnd.choices(alpha, k=rnd.randint(0, 15)))
        want = t.encode(text, add_special_tokens=False).ids
        assert packing.ids_of(text, PATH) == struct.pack(f"<{len(want)}I", *want), repr(text)


def check_plan(counts, limit):
    used, seen = {}, {n: [] for n in counts}
    for length, lo, hi, first, offset in packing.plan(counts, limit):
        seen[length] += range(lo, hi)
        for k in range(hi - lo):
            used.setdefault(first + k, []).append((offset, length))
    assert all(sorted(seen[n]) == list(range(c)) for n, c in counts.items())
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    assert sorted(used) == list(range(len(used)))
    return len(used)


def one_by_one(counts, limit):
    """Best-fit decreasing on single pieces."""
    bins = []
    for n in sorted((x for x, c in counts.items() for _ in range(c)), reverse=True):
        fit = [i for i, r in enumerate(bins) if r >= n]
        if fit:
            bins[min(fit, key=lambda i: bins[i])] -= n
        else:
            bins.append(limit - n)
    return len(bins)


def test_plan_is_best_fit():
    rnd = random.Random(2)
    for _ in range(60):
        limit = rnd.choice([7, 16, 50])
        counts = {rnd.randint(1, limit): rnd.randint(1, 30) for _ in range(rnd.randint(1, 12))}
        assert check_plan(counts, limit) == one_by_one(counts, limit)
    assert packing.plan({}, 8) == []


def test_pack(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choices(["alpha", "beta", "of", "gamma."], k=rnd.randint(0, 900)))) for i in range(120)]
    rows += [(200, None), (201, ""), (None, "no id"), (5, rows[5][1]), (202, "long " * 6000), (203, "<|endoftext|> in a text")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, length int, salt int").repartition(3)
    got = packing.pack(docs, PATH, with_ids=True).collect()
    t = Tokenizer.from_file(PATH)
    want = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        for k, (s, n) in enumerate(packing.cut(len(ids), 1024)):
            part = ids[s : s + n]
            want.append((i, k, s, n, zlib.crc32(struct.pack(f"<{n}I", *part)), part))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in got), key=repr) == sorted(want, key=repr)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-sum(r.length for r in got) // 1024) + 2


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
