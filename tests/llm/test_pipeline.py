"""The pipeline's stages against brute force on a small corpus."""

import random

import pytest

import corpus_pipeline

from .test_near import components


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(6)
    vocab = ["".join(rnd.choices(["ta", "re", "mo", "li", "ne", "su"], k=rnd.randint(1, 4))) for _ in range(600)]
    docs, labels = [], []
    for i in range(500):
        words = rnd.choices(vocab, k=rnd.randint(20, 300))
        if i % 5 == 0:
            words[3] = "blorgish"
        docs.append((i, " ".join(words), "en", f"src{i % 3}", 0))
        if i % 4:
            labels.append((i, 1, int(i % 5 == 0)))
    docs += [(500 + i, docs[i][1], "en", "copy", 0) for i in range(40)]  # exact copies
    docs += [(600 + i, docs[i][1].upper(), "en", "near", 0) for i in range(40)]  # the same words
    docs += [(700, None, "en", "x", 0), (701, "", None, "x", None), (702, docs[702 - 700][1], "en", "x", 0), (702, docs[702 - 700][1], "en", "x", 0)]
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, docs


def test_stages(spark, folder):
    at, rows = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "simhash_near_dedup", "best_fit_packing"]

    clean = stages["toxicity"](spark, docs, at)
    want = [r for r in rows if "blorgish" not in (r[1] or "").lower()]
    assert clean.columns == docs.columns and sorted(map(tuple, clean.collect()), key=repr) == sorted(want, key=repr)

    clean = spark.createDataFrame(want, docs.schema)
    unique = stages["exact_dedup"](spark, clean, at)
    best = {}
    for r in want:
        best[r[1] or ""] = max(best.get(r[1] or "", r), r, key=lambda x: x[0])
    assert unique.columns == docs.columns and sorted(map(tuple, unique.collect()), key=repr) == sorted(best.values(), key=repr)

    rest = sorted(best.values())
    unique = spark.createDataFrame(rest, docs.schema)
    single = stages["simhash_near_dedup"](spark, unique, at)
    keep = {d for d, c in components([r[:2] for r in rest]) if d == c}
    assert single.columns == docs.columns and sorted(map(tuple, single.collect()), key=repr) == sorted((r for r in rest if r[0] in keep), key=repr)

    out = corpus_pipeline.run(spark, at).collect()
    assert {r.doc_id for r in out} == keep
    ends = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 1024


def test_empty_tables_and_clashing_names(spark, folder, tmp_path):
    at, rows = folder
    labels = spark.read.parquet(f"{at}/labels.parquet")
    for name, docs in (("none", rows[:0]), ("some", [(None, rows[0][1], "x", "y", 1), (None, None, "x", "y", 1), (1, "", "x", "y", 1), *rows[1:40]])):
        names = "doc_id long, text string, kept string, score string, place long"
        made = spark.createDataFrame([(*r[:2], "a", "b", 7) for r in docs], names)
        made.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, made, str(tmp_path / name))
            assert out.columns == made.columns and {tuple(r)[2:] for r in out.collect()} <= {("a", "b", 7)}
        assert (corpus_pipeline.run(spark, str(tmp_path / name)).count() > 0) == (name == "some")
