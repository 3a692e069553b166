"""Metrics on rows made by hand, on fixtures, and the invariants of the registry."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from tallyforge import registry, schema
from tallyforge.frontend.ir import Node, Param, Token, annotate
from tallyforge.operators import duplication, metrics
from tallyforge.operators.parse import Facts, facts
from tallyforge.plans import analyze as plan
from tallyforge.sources import files as sources

HERE = os.path.join(os.path.dirname(__file__), "fixtures")


def tree(kind, *children, label=None, **more):
    """A node by kind; places are dealt out by build()."""
    return Node(kind, 0, 0, list(children), label=label, **more)


def fn(name, *children, params=0, **more):
    return tree("function", *children, name=name, params=[Param(None)] * params, **more)


def build(spark, files):
    """Facts of files given as (path, root, tokens, source); every node spans the file."""
    rows = []
    for path, root, tokens, source in files:
        stack, n = [root], 0
        while stack:
            x = stack.pop()
            x.start, x.end = (n, len(source) + 1) if x.end == 0 else (x.start, x.end)
            stack.extend(reversed(x.children))
        a = annotate(root, tokens, source.encode())
        rows.append(("p", path, "x", "ok", None, source, a["nodes"], a["tokens"], a["functions"]))
    return facts(spark.createDataFrame(rows, schema.PARSED))


def by_name(df):
    return {r["name"]: r.asDict() for r in df.collect()}


def test_registry():
    assert len(registry.IDS) == 53 == len(set(registry.IDS))
    assert [len(registry.ids(s)) for s in "FLP"] == [33, 46, 45]


@pytest.fixture(scope="module")
def fixtures(spark):
    return plan.analyze(spark, HERE, "fixtures")


def test_fixtures_agree_across_languages(fixtures):
    f = fixtures.functions.collect()
    assert len(f) == 24
    # by hand: cyclomatic, cognitive, depth, paths, parameters, doc lines, fan-out, fan-in, call depth, calls
    want = {"steps_to_one": (4, 6, 2, 5, 2, 2, 0, 0, 0, 0), "inside": (3, 2, 0, 1, 3, 1, 0, 0, 0, 0), "digits": (2, 2, 1, 2, 1, 0, 1, 8, 0, 1)}
    for r in f:
        got = (
            r.complexity_cyclomatic, r.complexity_cognitive, r.nesting_max_depth, r.complexity_path_count, r.function_parameter_count, r.documentation_doc_loc,
            r.dependency_fan_out, r.dependency_fan_in, r.dependency_call_depth, r.function_call_count,
        )
        assert got == want[r["name"]], r


def test_every_id_is_there_and_nothing_is_an_error(fixtures):
    long = fixtures.long()
    assert long.filter("reason LIKE 'error%'").count() == 0
    for scope, name in registry.SCOPE_NAMES.items():
        rows = long.filter(F.col("scope") == name).select("metric").distinct().collect()
        assert {r.metric for r in rows} == set(registry.ids(scope))
    assert long.filter("value IS NULL AND reason IS NULL AND metric IS NOT NULL").count() == 0
    p = fixtures.projects.first()
    assert p.size_function_count == 24 and p.dependency_dependency_count == 8 and p.documentation_documentation_ratio == 16 / 24


def test_lines(spark):
    source = "int x; // c\n\n/* a\n b */\nf() {\n return 1;\n}\n"
    words = [("keyword", "int"), ("identifier", "x"), ("punctuation", ";"), ("comment", "// c"), ("comment", "/* a\n b */"), ("identifier", "f"), ("punctuation", "("), ("punctuation", ")"), ("punctuation", "{"), ("keyword", "return"), ("literal", "1"), ("punctuation", ";"), ("punctuation", "}")]
    tokens, at = [], 0
    for kind, text in words:
        at = source.index(text, at)
        tokens.append(Token(kind, text, at, at + len(text)))
        at += len(text)
    start = source.index("f()")
    root = tree("other", tree("declaration"), Node("function", start, len(source) - 1, [tree("return")], name="f"))
    one = build(spark, [("a.x", root, tokens, source)])
    r = metrics.by_file(one).first()
    assert (r.size_loc, r.size_sloc, r.size_comment_loc, r.size_blank_loc) == (7, 4, 2, 1)
    assert r.size_comment_ratio == pytest.approx(2 / 7) and r.size_token_count == 11 and r.size_statement_count == 2
    g = metrics.by_function(one).first()
    assert (g.size_function_length, g.size_sloc, g.size_token_count, g.size_statement_count) == (3, 3, 8, 1)
    two = build(spark, [(p, root, tokens, source) for p in ("a.x", "b.x")])
    p = metrics.by_project(two).first()
    assert p.size_loc == 14 and p.size_comment_ratio == pytest.approx(4 / 14) and p.size_avg_function_length == 3
    bad = build(spark, [("a.x", tree("other"), [], "text\n")])
    long = {r.metric: r.reason for r in metrics.to_long(metrics.by_file(bad), "L", ["path"]).collect()}
    assert long["size.sloc"] == "error: a.x: line 1 has text that no token covers"
    assert long["derived.tokens_per_loc"].startswith("error: size.loc: ") and long["nesting.avg_depth"] == "not_applicable"


def test_complexity_and_cognitive(spark):
    ladder = lambda: tree("branch", tree("logical", label="&&"), tree("else", tree("branch")))
    f = fn("f", ladder(), tree("loop"), tree("return", tree("conditional")))
    r = by_name(metrics.by_function(build(spark, [("a", tree("other", f, fn("g", tree("statement")), tree("branch")), [], "")])))
    assert r["f"]["complexity_cyclomatic"] == 6 and r["g"]["complexity_cyclomatic"] == 1
    assert [r["f"][f"complexity_{k}_count"] for k in ("branch", "conditional", "loop", "return", "jump")] == [2, 1, 1, 1, 0]
    cases = {
        "nested": (fn("nested", tree("loop", tree("branch", tree("loop")))), 6),
        "chain": (fn("chain", tree("branch", tree("else", tree("branch", tree("else"))))), 3),
        "elif": (fn("elif", tree("branch", tree("branch"), tree("else"))), 3),
        "switch": (fn("switch", tree("loop", tree("other", tree("case"), tree("case"), tree("case")))), 3),
        "logic": (fn("logic", tree("logical", tree("logical", tree("logical", label="&&"), label="&&"), label="||")), 2),
        "catch": (fn("catch", tree("catch", tree("call", label="catch")), tree("conditional")), 3),
    }
    r = by_name(metrics.by_function(build(spark, [("a", tree("other", *[x for x, _ in cases.values()]), [], "")])))
    assert {k: r[k]["complexity_cognitive"] for k in cases} == {k: v for k, (_, v) in cases.items()}
    inner = fn("out", tree("branch"), fn(None, tree("branch")))
    x = build(spark, [("a", tree("other", inner, tree("branch")), [], "")])
    assert sorted(v["complexity_cognitive"] for v in by_name(metrics.by_function(x)).values()) == [1, 1]
    assert metrics.by_file(x).first().complexity_cognitive == 2 and metrics.by_file(x).first().complexity_cyclomatic == 5


def test_path_counts(spark):
    cases = {
        "straight": (fn("straight", tree("statement")), 1),
        "if": (fn("if", tree("branch")), 2),
        "chain": (fn("chain", tree("branch", tree("else", tree("branch", tree("else"))))), 3),
        "elif": (fn("elif", tree("branch", tree("branch"), tree("branch"))), 4),
        "mixed": (fn("mixed", tree("branch"), tree("loop", tree("branch"))), 6),
        "cases": (fn("cases", tree("block", tree("case", tree("branch")), tree("case"))), 4),
        "try": (fn("try", tree("other", tree("block"), tree("catch"), tree("catch"))), 3),
        "ternary": (fn("ternary", tree("conditional")), 2),
        "huge": (fn("huge", *[tree("branch") for _ in range(1100)]), None),
    }
    made = build(spark, [("a", tree("other", *[x for x, _ in cases.values()]), [], "")])
    r = by_name(metrics.by_function(made))
    assert {k: r[k]["complexity_path_count"] for k in cases} == {k: v for k, (_, v) in cases.items()}
    assert r["huge"]["path_error"] == "value inf is not finite"


def test_nesting(spark):
    body = tree("loop", tree("branch", tree("statement"), tree("else", tree("branch", tree("statement"), tree("loop", tree("statement")), tree("else", tree("statement"))))))
    r = by_name(metrics.by_function(build(spark, [("a", tree("other", fn("f", body), fn("empty")), [], "")])))
    assert r["f"]["nesting_max_depth"] == 3 and r["empty"]["nesting_max_depth"] == 0
    assert r["empty"]["nesting_avg_depth"] is None


def test_halstead(spark):
    words = [("identifier", "x"), ("operator", "="), ("identifier", "f"), ("punctuation", "("), ("identifier", "x"), ("punctuation", ","), ("literal", "1"), ("punctuation", ")"), ("punctuation", ";"), ("comment", "// c")]
    tokens = [Token(k, t, i, i + 1) for i, (k, t) in enumerate(words)]
    r = metrics.by_file(build(spark, [("a", tree("other"), tokens, " " * 12)])).first()
    assert [r.halstead_unique_operators, r.halstead_total_operators, r.halstead_unique_operands, r.halstead_total_operands] == [2, 2, 3, 4]
    assert r.halstead_volume == pytest.approx(6 * math.log2(5)) and r.halstead_difficulty == pytest.approx(4 / 3)
    p = metrics.by_project(build(spark, [(q, tree("other"), tokens, " " * 12) for q in "ab"])).first()
    assert p.halstead_unique_operands == 3 and p.halstead_total_operands == 8
    e = metrics.by_file(build(spark, [("a", tree("other"), [], "")])).first()
    assert e.halstead_length == 0 and e.halstead_volume is None and e.size_loc == 0 and e.size_comment_ratio is None


def test_functions_and_documentation(spark):
    f = fn("f", tree("call", tree("expression")), tree("binary"), params=3)
    root = tree("other", f, fn("g", params=1), fn(None), tree("call"), tree("call"))
    made = build(spark, [("a", root, [], "")])
    r, g = metrics.by_file(made).first(), by_name(metrics.by_function(made))
    assert g["f"]["function_parameter_count"] == 3 and g["f"]["function_expression_count"] == 3 and g["f"]["function_call_count"] == 1
    assert r.function_call_count == 3 and r.function_expression_count == 5
    assert r.function_avg_parameter_count == pytest.approx(4 / 3) and r.function_max_parameter_count == 3


def test_duplication(spark):
    def copy(k, n):
        return [Token("identifier" if i % 3 else "keyword", f"v{k}_{i}" if i % 3 else f"w{i}", 0, 0) for i in range(n)]

    def of(files):
        out = []
        for p, tokens in files:
            for i, t in enumerate(tokens):
                t.start = t.end = i
            out.append((p, tree("other"), tokens, " " * 400))
        return build(spark, out).coded()

    one = duplication.by_file(of([("a", copy(1, 60) + [Token("keyword", "sep", 0, 0)] + copy(2, 60))])).first()
    assert [one.duplication_duplicate_token_count, one.duplication_duplicate_block_count, one.duplication_max_duplicate_length] == [120, 2, 60]
    assert duplication.by_file(of([("a", copy(1, 48) + [Token("keyword", "sep", 0, 0)] + copy(2, 48))])).count() == 0
    split = copy(1, 60)
    split.insert(30, Token("comment", "// c", 0, 0))
    assert duplication.by_file(of([("a", split + [Token("keyword", "sep", 0, 0)] + copy(2, 60))])).first().duplication_duplicate_token_count == 120
    two = of([("a", copy(1, 60)), ("b", copy(2, 60))])
    assert duplication.by_file(two).count() == 0
    p = duplication.by_project(two).first()
    assert [p.duplication_duplicate_token_count, p.duplication_duplicate_block_count] == [120, 2]


def test_duplication_by_brute_force(spark):
    """Random files in several projects, in small chunks, with repeated files, as longs and as strings; and from token rows."""
    rnd, window = random.Random(8), 5
    base = [rnd.randrange(4) for _ in range(300)]
    files = []
    for i in range(60):
        c = [rnd.randrange(9) for _ in range(rnd.choice([0, 3, 5, 40, 120]))]
        at = rnd.randrange(200)
        files.append((f"p{i % 3}" if i % 3 else None, f"f{i}", c + base[at : at + rnd.randrange(60)] if i % 2 else c))
    files += [("p1", "same", base)] * 3
    seen, own = {}, {}
    for p, q, c in files:
        for i in range(len(c) - window + 1):
            w = (p, *c[i : i + window])
            seen[w] = seen.get(w, 0) + 1
            own[(q, *w)] = own.get((q, *w), 0) + 1

    def measured(p, q, c, count):
        covered, out = set(), []
        for i in range(len(c) - window + 1):
            if count(q, (p, *c[i : i + window])) > 1:
                covered |= set(range(i, i + window))
        for i in sorted(covered):
            if i - 1 not in covered:
                out.append(0)
            out[-1] += 1
        return out

    for kind, code in (("array<long>", list), ("string", lambda c: "".join(chr(97 + x) for x in c))):
        coded = spark.createDataFrame([(p, q, code(c)) for p, q, c in files], f"project string, path string, codes {kind}").repartition(4)
        got = sorted((r.path, r.blocks, r.covered, r.longest) for r in duplication.repeated_in_project(coded, window, 100).collect())
        want = [(q, r) for p, q, c in files if (r := measured(p, q, c, lambda _, w: seen[w]))]
        assert got == sorted((q, len(r), sum(r), max(r)) for q, r in want)
        got = {r.path: r.duplication_duplicate_token_count for r in duplication.by_file(coded.filter("path <> 'same'"), window).collect()}
        assert got == {q: sum(r) for p, q, c in files if q != "same" and (r := measured(p, q, c, lambda q, w: own[(q, *w)]))}
    rows = [(p, q, i, "operator", str(x)) for p, q, c in files[:-3] for i, x in enumerate(c)]
    again = duplication.codes(spark.createDataFrame(rows, "project string, path string, pos int, kind string, text string"))
    got = {r.path: r.covered for r in duplication.repeated_in_project(again, window).collect()}
    short = {}
    for p, _, c in files[:-3]:
        for i in range(len(c) - window + 1):
            short[(p, *c[i : i + window])] = short.get((p, *c[i : i + window]), 0) + 1
    assert got == {q: sum(r) for p, q, c in files[:-3] if (r := measured(p, q, c, lambda _, w: short[w]))}
    assert duplication.by_project(spark.createDataFrame([], "project string, path string, codes array<long>")).count() == 0


def test_dependency(spark):
    call = lambda *names: [tree("call", label=n) for n in names]
    root = tree("other", fn("f", *call("g", "h", "h")), fn("g", *call("f", "k")), fn("k"), fn("m", *call("k"), fn(None, *call("f"))), tree("import"), tree("import"))
    made = build(spark, [("a", root, [], "")])
    r = by_name(metrics.by_function(made))
    assert [r[x]["dependency_fan_out"] for x in "fkm"] == [2, 0, 1]
    assert [r[x]["dependency_fan_in"] for x in "fkm"] == [2, 2, 0]
    assert [r[x]["dependency_call_depth"] for x in ("f", "g", "k", "m", None)] == [1, 1, 0, 1, 2]
    assert metrics.by_file(made).first().dependency_dependency_count == 2
    n = 100_000
    depth = metrics.longest_paths([(str(i), str(i + 1)) for i in range(n - 1)], [str(i) for i in range(n)])
    assert depth["0"] == n - 1


def test_derived(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    lit = lambda x: F.lit(float(x))
    assert one(metrics.maintainability(lit(1000), lit(5), lit(40))) == pytest.approx(171 - 5.2 * math.log(1000) - 1.15 - 16.2 * math.log(40))
    assert one(metrics.maintainability(lit(0), lit(5), lit(40))) is None


def test_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "ok.py").write_text("def ok(a):\n    return a\n")
    (tmp_path / "broken.c").write_text("int f( {\n")
    (tmp_path / "README.md").write_text("no code")
    (tmp_path / "sub" / "empty.py").write_text("")
    (tmp_path / "bad.py").write_bytes(b"x = '\xff'\n")
    (tmp_path / ".hidden.py").write_text("x = 1")
    (tmp_path / "left.py").write_text("x = 1")
    (tmp_path / ".gitignore").write_text("left.py\n*.log\n")
    assert "left.py" in sources.walk(str(tmp_path))  # git's rules count in a working copy only
    (tmp_path / ".git").mkdir()
    assert sources.walk(str(tmp_path)) == ["bad.py", "broken.c", "ok.py", "sub/empty.py"]
    r = plan.analyze(spark, str(tmp_path))
    got = {x.path: x.status for x in r.parsed.collect()}
    assert got == {"bad.py": "error", "broken.c": "error", "ok.py": "ok", "sub/empty.py": "ok"}
    assert r.projects.first().size_function_count == 1
    assert {x.path: x.size_loc for x in r.files.collect()} == {"ok.py": 2, "sub/empty.py": 0}
    with pytest.raises(sources.UnsupportedLanguage):
        plan.analyze(spark, str(tmp_path / "README.md"))
    with pytest.raises(FileNotFoundError):
        plan.analyze(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="a.c:1"):
        plan.analyze_source(spark, "a.c", "int f( {")


def test_ignore_rules_from_outside(tmp_path, monkeypatch):
    """Of the user's own file, the exclude file, folders above and .ignore files."""
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "config"))
    monkeypatch.setenv("GIT_CONFIG_GLOBAL", str(tmp_path / "none"))
    top = tmp_path / "copy"
    for folder in ("config/git", "copy/.git/info", "copy/a/b", "copy/a/c"):
        (tmp_path / folder).mkdir(parents=True)
    for name in ("one.py", "two.py", "three.py", "four.py", "five.py", "six.py"):
        for folder in ("a", "a/b", "a/c"):
            (top / folder / name).write_text("")
    (tmp_path / "config/git/ignore").write_text("one.py\n")
    (top / ".git/info/exclude").write_text("/a/b/two.py\n")
    (top / ".gitignore").write_text("three.py\na/b/four.py\n/five.py\n")
    (tmp_path / ".gitignore").write_text("six.py\n")  # outside of the working copy
    assert sources.walk(str(top / "a/b")) == ["five.py", "six.py"]
    (top / "a/.gitignore").write_text("!three.py\nc/\n")
    (top / "a/.ignore").write_text("five.py\n!one.py\n")
    (tmp_path / ".ignore").write_text("six.py\n")
    assert sources.walk(str(top / "a")) == ["b/one.py", "b/three.py", "four.py", "one.py", "three.py", "two.py"]


def test_metrics_know_no_language():
    """Metrics read the representation only."""
    import tallyforge.operators.metrics as m

    with open(m.__file__, encoding="utf-8") as f:
        text = f.read().lower()
    assert not [w for w in ("python", "javascript", "rust", "golang", "frontend") if w in text]
