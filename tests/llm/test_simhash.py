"""SimHash near-dedup against brute force over all pairs."""

import random
import re

import xxhash

from tallyforge.llm import simhash


def brute(text, words=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    parts = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(rows, distance=4):
    fps = [(r[0], brute(r[1])) for r in rows]
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= distance:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return sorted(((d, f"{fp:016x}", least[find(i)]) for i, (d, fp) in enumerate(fps)), key=repr)


def corpus(seed=7):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(400)]
    rows, n = [], 0
    for _ in range(40):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(1, 300))]
        for _ in range(rnd.randint(1, 6)):
            copy = list(base)
            for _ in range(rnd.randint(0, 3)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (None, "Null Id here and there"), (n + 3, "null id here AND there"), (n + 4, "É é nbsp\xa0joined one\x0btwo"), (0, rows[5][1]), (n + 5, "w " * 70000)]
    return rows


def test_equal_to_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, component_id string").repartition(3)
    got = sorted(map(tuple, simhash.near_dedup(docs).collect()), key=repr)
    assert got == classes(rows)


def test_crowded_keys_take_hubs(spark):
    rows = corpus(11)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.near_dedup(docs, crowd=1).collect()), key=repr) == classes(rows)


def test_empty_table(spark):
    assert simhash.near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_forest_joins_what_all_pairs_join():
    import numpy as np

    rnd = random.Random(3)
    fps = [rnd.getrandbits(63) for _ in range(5)]
    fps += [f ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for f in fps for _ in range(20)]
    fps = np.unique(np.array(fps, np.uint64) * np.uint64(2) + np.uint64(1)).view(np.int64)
    links = simhash.forest(fps, 4)
    assert all(bin((int(a) ^ int(b)) & (2**64 - 1)).count("1") <= 4 for a, b in links)
    root = {int(f): int(f) for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    for a in fps:
        for b in fps:
            if bin((int(a) ^ int(b)) & (2**64 - 1)).count("1") <= 4:
                assert find(int(a)) == find(int(b))


def test_odd_distances_with_and_without_hubs(spark):
    rows = corpus(13)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for crowd in (1, 4096):
        assert sorted(map(tuple, simhash.near_dedup(docs, distance=3, crowd=crowd).collect()), key=repr) == classes(rows, 3)
