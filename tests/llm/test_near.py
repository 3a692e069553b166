"""The pipeline's near-dedup against brute force over all pairs."""

import random

import pytest

import corpus_pipeline
from tallyforge.llm import near
from tallyforge.llm.common import Scratch
from tallyforge.llm.components import components as connected


def brute(text, words=5):
    parts = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))}


def groups(rows, similar=0.8):
    sets = [brute(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similar * len(sets[i] | sets[j]) - 1e-9:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def components(rows, similar=0.8):
    least, found = {}, groups(rows, similar)
    for g, (d, _) in zip(found, rows, strict=True):
        least[g] = min((x for x in (d, least.get(g)) if x is not None), default=None)
    return sorted(((d, least[g]) for g, (d, _) in zip(found, rows, strict=True)), key=repr)


def corpus(seed=5, groups=60, copies=3):
    """Groups of texts whose copies have similarities of about 0.6 to 1."""
    rnd, rows = random.Random(seed), []
    vocab = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(3000)]
    for _ in range(groups):
        base = rnd.choices(vocab, k=rnd.randint(100, 300))
        for k in range(copies):
            copy = list(base)
            for _ in range(rnd.randint(0, len(base) // 40) if k else 0):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            rows.append((len(rows), " ".join(copy)))
    return [*rows, (len(rows), None), (len(rows) + 1, "few words"), (len(rows) + 2, "FEW Words"), (len(rows) + 3, " \n"), (None, "few words")]


def test_equal_to_all_pairs(spark):
    rows = corpus()
    got = sorted(map(tuple, near.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=repr)
    assert got == components(rows)


def test_crowded_keys(spark):
    """One group of many near copies, more than a key's window."""
    rows = corpus(9, groups=2, copies=90)
    got = sorted(map(tuple, near.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == components(rows)


def template(n, seed=7, words=165, changed=3):
    """One template with a few words of each text's own: most pairs share a min-hash key, few are similar."""
    rnd, rows = random.Random(seed), []
    base = [f"w{i}" for i in range(words)]
    for k in range(n):
        copy = list(base)
        for i, at in enumerate(rnd.sample(range(words), changed)):
            copy[at] = f"own{k}x{i}"
        rows.append((k, " ".join(copy)))
    return rows


def test_keys_wider_than_the_window(spark, monkeypatch):
    """Pairs of a key that stand further apart than the window are found as well, also where a shingle's rows are cut up."""
    monkeypatch.setattr(near, "BLOCK", 16, raising=False)
    rows = template(240)
    want = components(rows)
    assert 30 < len({c for _, c in want}) < 210  # links between few of the pairs
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, near.near_dedup(docs, window=2).collect()), key=repr) == want


def test_prefixes_lose_no_pair(spark, monkeypatch):
    """Every similar pair under different roots is proposed, whatever the sizes of its sets."""
    rnd, monkey = random.Random(2), monkeypatch.setattr
    monkey(near, "BUCKETS", 64)  # shingles that share a bucket change the order, not the result
    sets = []
    for k in range(300):
        own = set(rnd.sample(range(40), rnd.randint(1, 12))) if k % 3 or not k else {x for x in sets[-1] if rnd.random() > 0.1} | {rnd.randrange(40)}
        sets.append(own)
    rows = [(k, k % 5, near.np.sort(near.np.array([hash((x, 3)) % 2**63 for x in s], near.np.uint64)).tobytes()) for k, s in enumerate(sets)]
    table = spark.createDataFrame(rows, "node long, root long, found binary").repartition(3)
    for similar in (0.6, 0.8):
        want = {(a, b) for b in range(300) for a in range(b) if a % 5 != b % 5 and len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b])}
        got = {tuple(sorted(r)) for r in near._by_prefix(table, similar, Scratch(spark), 4).collect()}
        assert want <= got and all(a % 5 != b % 5 for a, b in got) and len(want) > 20


def test_stage_drops_near_copies(spark, tmp_path):
    """Pairs of similarity 0.8 and more go, whatever their fingerprints' distance."""
    rows = corpus(3, groups=40, copies=2)[:-1]
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    kept = {r.doc_id for r in stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()}
    assert kept == {d for d, c in components(rows) if d == c}


def test_one_row_of_each_group_stays(spark):
    """Repeated ids, null ids, repeated rows, and columns whose names the stage might use itself."""
    a, b, c = ("z y x w v u", "a b c d e f", "k l m n o p q")
    rows = [(1, a), (1, b), (2, b), (0, a), (None, a), (None, b), (None, c), (None, c), (3, "s t"), (3, "s t")]
    names = ["_kept_id", "_kept_sha256", "_sha256", "_id0", "_place0", "_n0", "node", "place", "root", "n"]
    docs = spark.createDataFrame([(*r, *[f"{i}"] * len(names)) for i, r in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)).repartition(3)
    got = near.kept_rows(docs)
    assert got.columns == docs.columns
    assert sorted((r[:2] for r in got.collect()), key=repr) == sorted([(0, a), (1, b), (None, c), (3, "s t")], key=repr)
    stage = dict(corpus_pipeline.STAGES)["exact_dedup"](spark, docs, "")
    assert stage.columns == docs.columns
    assert sorted((r[:2] for r in stage.collect()), key=repr) == sorted([(1, a), (2, b), (None, c), (3, "s t")], key=repr)


@pytest.mark.parametrize("stage", ["exact_dedup", "simhash_near_dedup", "best_fit_packing"])
def test_stages_on_an_empty_table(spark, stage):
    docs = spark.createDataFrame([], "doc_id long, text string, _kept_id long")
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, "")
    assert out.count() == 0 and (stage == "best_fit_packing" or out.columns == docs.columns)


def test_empty_table(spark):
    assert near.near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    """Against a search by hand, with repeated, reversed, looped and null-ended edges, a long path and a star."""
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(rnd.randrange(600, 700), rnd.randrange(600, 700)) for _ in range(70)]
    edges += [(b, a) for a, b in edges[::3]] + edges[::5] + [(900, 900), (901, 901), (901, 902), (-5, 130)]
    near_by = {}
    for a, b in edges:
        if a != b:
            near_by.setdefault(a, set()).add(b)
            near_by.setdefault(b, set()).add(a)
    want, seen = {}, set()
    for start in sorted(near_by):
        stack = [start] if start not in seen else []
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                want[x] = start
                stack += near_by[x]
    table = spark.createDataFrame([*[(a, b, "x") for a, b in edges], (7, None, "x"), (None, 8, "x")], "a long, b long, root string")
    assert {r.node: r.root for r in connected(table, Scratch(spark)).collect()} == want
    assert connected(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_a_cluster_needs_a_shared_folder(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace

    from tallyforge.llm import common

    told = {"spark.master": "spark://host:7077"}
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: told.get(k, d)))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(session)
    told["spark.checkpoint.dir"] = "hdfs://host/x"
    assert common.shared_dir(session) == "hdfs://host/x"
    scratch = Scratch(spark)
    a, b = scratch.table(spark.range(10)), scratch.table(spark.range(5), rows=5)
    scratch.release(b)
    assert b.count() == 5
    with pytest.raises(Exception, match="not exist|NOT_EXIST|FAILED_READ"):
        a.count()
