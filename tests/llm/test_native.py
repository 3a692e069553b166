"""Exact dedup, sharding and line dedup against brute force, on awkward rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

from tallyforge.llm import exact_dedup, line_dedup, sharding

ROWS = [(i, f"text {i % 7}") for i in range(60)] + [(100, None), (101, ""), (None, "text 3"), (None, "alone"), (5, "text 5"), (7, "repeated"), (7, "repeated"), (8, "x" * 100_000), (9, "é")]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "a", 1, "b") for r in rows], "doc_id long, text string, digest string, salt int, keep_id string").repartition(5)


def test_exact_dedup(spark):
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[t or ""].append(i)
    got = exact_dedup.exact_dedup(docs(spark)).collect()
    assert len(got) == len(ROWS)
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    kept = Counter()
    for r in got:
        ids = groups[sha[r.text_sha256]]
        best = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size) == (best, len(ids))
        assert not r.kept or r.doc_id == best
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}
    assert exact_dedup.kept_rows(docs(spark)).count() == len(groups)
    assert exact_dedup.exact_dedup(docs(spark, []).limit(0)).count() == 0


def test_exact_dedup_of_colliding_digests(spark, monkeypatch):
    """With a digest that all texts share, full content still tells them apart."""
    from pyspark.sql import functions as F

    real = F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: real(F.substring(c, 1, 1), n))
    got = exact_dedup.exact_dedup(docs(spark)).collect()
    sizes = Counter(t or "" for _, t in ROWS)
    assert Counter(r.group_size for r in got) == Counter(n for t, n in sizes.items() for _ in range(n))


def test_sharding(spark):
    rows = ROWS + [(1, "hot")] * 500
    got = sharding.shard(docs(spark, rows)).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        by[r.shard].append(r.slot)
    assert set(by) == set(range(24)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard(docs(spark, []).limit(0)).count() == 0


def test_ring_bounds_loads_and_moves_few_keys():
    counts = {p: 50 for p in range(1 << 12)}
    homes = {}
    for shards in (24, 25):
        at, load = {}, Counter()
        for p, lo, hi, s, slot in sharding.plan(counts, shards, 64, 1 << 12, slack=0.25):
            assert slot == load[s]
            load[s] += hi - lo
            at.update({(p, k): s for k in range(lo, hi)})
        assert len(at) == 50 << 12 and max(load.values()) <= 1.25 * (50 << 12) / shards + 2
        homes[shards] = at
    moved = sum(homes[24][k] != homes[25][k] for k in homes[24]) / len(homes[24])
    assert moved < 0.12  # an even deal of 25 shards alone moves 0.04


def test_line_dedup(spark):
    page = "<html><head><title>T{0}</title><script>var x='<p>no';</script></head><body><!-- hid\nden --><p>Menu</p><div>Unique {0} &amp; <b>bold</b></div>\n<p>Menu</p><footer>Site foot</footer></body></html>"
    rows = [(i, f"https://User@Big.example:8080/p{i}?q", page.format(i)) for i in range(40)] + [(50, "http://small.example/a", page.format(50)), (51, "http://small.example/b", page.format(51))]
    rows += [(60, None, "<p>null host</p>"), (61, "not a url", None), (62, "http://big.example", ""), (0, "https://big.example/p0", page.format(0))]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string")
    got = {(r.page_id, r.host, r.n_lines, r.n_dropped, r.text) for r in line_dedup.line_dedup(pages).collect()}
    want = {(i, "big.example", 5, 3, f"T{i}\nUnique {i} &amp; bold") for i in range(40)}
    want |= {(i, "small.example", 5, 3, f"T{i}\nUnique {i} &amp; bold") for i in (50, 51)}
    want |= {(60, "", 1, 0, "null host"), (61, "", 0, 0, ""), (62, "big.example", 0, 0, "")}
    assert got == want
    assert line_dedup.line_dedup(pages.limit(0)).count() == 0
    spared = {r.page_id: r.n_dropped for r in line_dedup.line_dedup(pages, least_pages=3).collect()}
    assert spared[50] == 0 and spared[1] == 3


def test_line_dedup_of_one_page_and_of_what_is_left_open(spark):
    rows = [(1, "http://one.example", "<p>all goes</p>")]
    rows += [(10 + i, "http://open.example", x) for i, x in enumerate(["a < b<p>c", "<p>d<!-- e <p>f", "g<script>h</p>", "<style x>i", "j<p k", "<" * 100_000 + "l", "<!-- " * 100_000, "<p " * 100_000, "m<script " * 50_000])]
    got = {r.page_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "" and [got[10 + i] for i in range(7)] == ["a < b\nc", "d", "g", "", "j<p k", "<" * 100_000 + "l", ""]
    assert got[17] == ("<p " * 100_000).strip() and got[18] == "m"


def test_attach_meets_heavy_and_light_keys(spark, monkeypatch):
    from tallyforge.llm import common

    monkeypatch.setattr(common, "HEAVY", 4)
    keys = [1] * 50 + [2] * 30 + [3, 4, 4, None, 9]
    left = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i int")
    right = spark.createDataFrame([(k, keys.count(k), f"v{k}") for k in (1, 2, 3, 4)], "k long, n long, v string")
    got = {(r.k, r.i, r.v) for r in common.attach(left, right, "k", len(keys), "n").collect()}
    assert got == {(k, i, f"v{k}" if k in (1, 2, 3, 4) else None) for i, k in enumerate(keys)}
