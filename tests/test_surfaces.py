"""Statistics, the model, sinks, the command line, HTTP and streaming."""

import itertools
import json
import math
import os
import random
import threading
import urllib.error
import urllib.request

import pytest

from tallyforge import cli, http_api, registry
from tallyforge.operators import model as models
from tallyforge.operators import stats
from tallyforge.plans import analyze as plan
from tallyforge.sinks import html, output
from tallyforge.streaming import analyze_stream

HERE = os.path.join(os.path.dirname(__file__), "fixtures")


def test_summary(spark):
    df = spark.createDataFrame([(4.0,), (1.0,), (3.0,), (2.0,), (None,)], "v double")
    r = stats.summary(df, ["v"]).first()
    assert (r.n, r.missing, r["mean"], r.q1, r.median, r.q3, r["min"], r["max"]) == (4, 1, 2.5, 1.75, 2.5, 3.25, 1, 4)
    assert r.sd == pytest.approx(math.sqrt(5 / 3))
    one = stats.summary(df.filter("v = 1"), ["v"]).first()
    assert one.sd is None and one.n == 1
    none = stats.summary(df.filter("v IS NULL"), ["v"]).first()
    assert none.n == 0 and none["mean"] is None and none.median is None


def test_correlations(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0, 5.0, 10.0), (2.0, 4.0, 8.0, 5.0, 20.0), (3.0, 6.0, 27.0, 5.0, 10.0), (4.0, None, 64.0, 5.0, 30.0)], "a double, b double, c double, d double, e double")
    r = {(x.a, x.b): x for x in stats.correlations(df, list("abcde")).collect()}
    assert len(r) == 10 and r["a", "b"].pearson == pytest.approx(1) and r["a", "b"].n == 3
    assert r["a", "c"].spearman == pytest.approx(1) and r["a", "c"].pearson < 1 and r["a", "d"].pearson is None
    few = stats.correlations(df.limit(2), ["a", "b"]).first()
    assert few.n == 2 and few.pearson is None
    ranks = df.select("e", stats.average_rank("e", ["d"]).alias("r")).orderBy("e").collect()
    assert [x.r for x in ranks] == [1.5, 1.5, 3, 4]


def test_correlations_by_hand(spark):
    """Random columns with ties and gaps, a constant far from zero, one that is constant where another has values."""
    rnd = random.Random(2)
    table = []
    for i in range(200):
        x = rnd.gauss(1e6, 1)
        table.append((x, x * 2 + rnd.gauss(0, 1), float(rnd.randrange(5)), 1e9 + 0.1, rnd.choice([None, math.nan, 7.25, float(i)]), None if i % 2 else 0.1, float(i % 2)))
    columns = list("abcdefg")
    got = {(r.a, r.b): r for r in stats.correlations(spark.createDataFrame(table, ", ".join(f"{c} double" for c in columns)).repartition(3), columns).collect()}

    def ranks(v):
        return [sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for x in v]

    def r(x, y):
        n = len(x)
        mx, my = sum(x) / n if n else 0, sum(y) / n if n else 0
        if n < 3 or len(set(x)) == 1 or len(set(y)) == 1:
            return None
        return sum((p - mx) * (q - my) for p, q in zip(x, y)) / math.sqrt(sum((p - mx) ** 2 for p in x) * sum((q - my) ** 2 for q in y))

    for i, j in itertools.combinations(range(7), 2):
        both = [(t[i], t[j]) for t in table if t[i] is not None and t[j] is not None and not math.isnan(t[i]) and not math.isnan(t[j])]
        x, y = [p for p, _ in both], [q for _, q in both]
        own = got[columns[i], columns[j]]
        assert own.n == len(both)
        for have, want in ((own.pearson, r(x, y)), (own.spearman, r(ranks(x), ranks(y)))):
            assert (have is None) == (want is None) and (want is None or have == pytest.approx(want, abs=1e-8)), (i, j)


def test_histogram(spark):
    bins = stats.histogram(spark.createDataFrame([(1.0,), (2.0,), (2.0,), (10.0,)], "v double"), "v", 3).orderBy("bin").collect()
    assert [(b.lo, b.hi, b.n) for b in bins] == [(1, 4, 3), (4, 7, 0), (7, 10, 1)]
    assert [b.n for b in stats.histogram(spark.createDataFrame([(5.0,), (5.0,)], "v double"), "v").collect()] == [2]
    assert stats.histogram(spark.createDataFrame([(None,)], "v double"), "v").count() == 0


def rows(spark, n=7):
    return spark.createDataFrame([(i, float(i), float((i * i) % 5), 3.0, 2.0 * i - (i * i) % 5 + 3) for i in range(n)], "row_idx int, a double, b double, c double, score double")


def test_ridge(spark):
    m = models.fit(rows(spark), "file", ["a", "b", "c"], lam=1e-9, public=str)
    assert m.features == ["a", "b"] and m.excluded_features == {"c": "constant over the labelled units"}
    assert m.r_squared == pytest.approx(1, abs=1e-6) and m.cv_rmse < 1e-3
    assert abs(models.fit(rows(spark), "file", ["a", "b"], lam=100.0, public=str).coefficients[0]) < abs(m.coefficients[0])
    assert models.fit(rows(spark, 4), "file", ["a", "b"], public=str).cv_rmse is None
    with pytest.raises(ValueError, match="at least 2"):
        models.fit(rows(spark, 1), "file", ["a"], public=str)
    with pytest.raises(ValueError, match="lambda"):
        models.fit(rows(spark), "file", ["a"], lam=math.nan, public=str)
    far = models.fit(rows(spark).selectExpr("row_idx", "a + 1e9 AS a", "b - 3e8 AS b", "score + 1e7 AS score"), "file", ["a", "b"], lam=1.0, public=str)
    near = models.fit(rows(spark), "file", ["a", "b"], lam=1.0, public=str)
    assert far.coefficients == pytest.approx(near.coefficients, rel=1e-6) and far.cv_rmse == pytest.approx(near.cv_rmse, rel=1e-6) and far.means[0] - near.means[0] == pytest.approx(1e9)
    units = spark.createDataFrame([(1.0, 2.0), (1.0, None)], "a double, b double")
    got = models.predict(models.Model.from_json(m.to_json()), units, column=str).orderBy("score").collect()
    assert got[0].score is None and got[0].unavailable == "b is null" and got[1].score == pytest.approx(3, abs=1e-4)


def test_labels():
    assert models.read_labels('path,function,score\n"a,b.py",,1\nc.py,f,2.5\n') == [models.Label("a,b.py", None, 1.0), models.Label("c.py", "f", 2.5)]
    for bad, says in (("path,score\n", "header"), ("path,function,score\na,,x\n", "row 2"), ("path,function,score\na,,nan\n", "finite"), ("path,function,score\na,,1e400\n", "finite")):
        with pytest.raises(ValueError, match=says):
            models.read_labels(bad)
    with pytest.raises(ValueError, match="either"):
        models.label_scope(models.read_labels("path,function,score\na,,1\nb,f,2\n"))


@pytest.fixture(scope="module")
def made(spark):
    with plan.analyze(spark, HERE, "fixtures") as result:
        made = output.to_dict(result)
        assert result.kept and all(x.is_cached for x in result.kept)
        own = [*result.kept]
    assert not result.kept and not any(x.is_cached for x in own)
    return made


def test_json_csv_html(spark, made):
    again = json.loads(output.to_json(made))
    assert again == made and [f["path"] for f in made["files"]] == sorted(f["path"] for f in made["files"])
    assert set(made["files"][0]["metrics"]) == set(registry.ids("L")) and set(made["project"]["metrics"]) == set(registry.ids("P"))
    assert made["run"]["parsers"].keys() == {"c", "cpp", "go", "java", "javascript", "typescript", "python", "rust"}
    lines = output.to_csv(made).splitlines()
    assert lines[0].split(",") == output.HEADER + registry.IDS and len(lines) == 1 + 1 + 8 + 24
    assert output.quoted('a"b,c') == '"a""b,c"' and output.number(3.0) == "3" and output.number(None) == ""
    assert [output.number(x) for x in (5e-05, 1e16, 1.5e20, 0.1, 1 / 3, -2.0, 123456.789)] == ["0.00005", "10000000000000000", "150000000000000000000", "0.1", "0.3333333333333333", "-2", "123456.789"]
    assert lines[1].startswith("project,,,,,,,,") and ",ok,," in lines[2]
    page = html.to_html(spark, made)
    assert "<script" not in page and "http" not in page and html.escape("<x>") == "&lt;x&gt;" and "complexity.cyclomatic" in page
    assert "Distributions over functions" in page and "Rank correlations over functions" in page and "complexity.path_count / complexity.cognitive" in page and "–</td>" not in page


def test_label_join(spark, made):
    units = output.units(spark, [made, made], "function")
    got = models.join_labels(units, [], [models.Label("collatz.c", "inside", 1.0), models.Label("collatz.py", "digits", 2.0)]).orderBy("row_idx").collect()
    assert [(r.path, r.unit_function, r.result_no) for r in got] == [("collatz.c", "inside", 0), ("collatz.py", "digits", 0)]
    with pytest.raises(ValueError, match="not in the results"):
        models.join_labels(units, [], [models.Label("none.c", "f", 1.0)])
    twice = json.loads(json.dumps(made))
    for f in twice["files"]:
        f["functions"] = f["functions"] * 2
    with pytest.raises(ValueError, match="several functions"):
        models.join_labels(output.units(spark, [twice], "function"), [], [models.Label("collatz.c", "inside", 1.0)])


def test_command_line(spark, tmp_path, capsys):
    result, model = str(tmp_path / "r.json"), str(tmp_path / "m.json")
    assert cli.main(["analyze", HERE, "--project", "x", "-o", result]) == 0
    assert cli.main(["stats", result]) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["units"] == 8 and len(got["correlations"]) == 46 * 45 // 2 and got["metrics"][0]["metric"] == "size.loc"
    assert cli.main(["report", result, "-o", str(tmp_path / "r.html")]) == 0
    labels = tmp_path / "l.csv"
    labels.write_text("path,function,score\n" + "".join(f"collatz.{e},,{k}\n" for k, e in enumerate(["c", "go", "java", "js", "py", "rs"])))
    assert cli.main(["model", "train", "--labels", str(labels), "--features", "size.loc,size.token_count", "-o", model, result]) == 0
    assert cli.main(["model", "predict", "--model", model, result]) == 0
    got = json.loads(capsys.readouterr().out)
    assert len(got) == 8 and all(r["score"] is not None for r in got)
    assert cli.main(["analyze", str(tmp_path / "none")]) == 1
    assert "error:" in capsys.readouterr().err


def test_http(spark):
    s = http_api.server(spark, port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{s.server_address[1]}"

    def post(path, body):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, json.dumps(body).encode(), {"Content-Type": "application/json"})) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    assert urllib.request.urlopen(base + "/").status == 200
    code, body = post("/api/analyze", {"filename": "a.py", "source": "def f(a):\n    return a\n"})
    assert code == 200 and body["files"][0]["functions"][0]["name"] == "f" and body["run"]["project"] == "a"
    assert post("/api/analyze", {"filename": "a.xyz", "source": ""})[0] == 400
    code, body = post("/api/analyze", {"filename": "a.py", "source": "def f(:\n"})
    assert code == 400 and "a.py:1" in body["error"]
    assert post("/other", {})[0] == 404
    s.shutdown()


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("p", "a.py", b"def f(a):\n    return a\n")], "project string, path string, content binary").write.parquet(src)
    stream = spark.readStream.schema("project string, path string, content binary").parquet(src)
    q = analyze_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out" / "functions")).first().name == "f"
