"""Queries that run the whole analysis over generated programs, with values worked out by hand as DuckDB SQL.

Each supplier gives one program, in the language k % 8 of its key k, of

    b = k % 3 comment lines, an import, p = 2 padding functions if 5 divides k, a constant, and a function `root`: documented
    by d = k % 2 comment lines, with a loop over a = k % 4 branches, and c = (k div 8) % 3 calls of functions `leaf0`, ...

Keys with k % 11 = 5 give a file that can't be parsed. Each program is a project of its own, or part of its nation's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import metrics, model, stats
from .operators.parse import Facts, facts, parse, with_language


@dataclass
class Program:
    """How a language writes the program: lines, with {i} for a number; open and shut: what stands around all functions."""

    language: str
    ext: str
    note: str
    imports: str
    pad: tuple[str, ...]  # header, statement, return, end
    constant: str
    root: tuple[str, ...]  # header, loop, branch, its body, its end, step, the loop's end, call, return, end
    leaf: tuple[str, ...]  # header, return, end
    top: tuple[str, ...] = ()
    open: tuple[str, ...] = ()
    shut: tuple[str, ...] = ()


def _braces(language, ext, imports, constant, header, loop, branch, semi=";", **more):
    s = lambda x: x + semi
    return Program(
        language, ext, "// note {i}", imports, (header("pad{i}", "z"), s("z = z + 1"), s("return z"), "}"), constant,
        (header("root", "x", "y"), loop, branch, s("x = x - 1"), "}", s("x = x - 2"), "}", s("leaf{i}(x)"), s("return x + y"), "}"),
        (header("leaf{i}", "z"), s("return z"), "}"), **more,
    )


def _c(name, *params):
    return f"int {name}({', '.join('int ' + p for p in params)}) {{"


PROGRAMS = [
    Program(
        "python", "py", "# note {i}", "import os", ("def pad{i}(z):", "    z = z + 1", "    return z"), "LIMIT = 1",
        ("def root(x, y):", "    while x > 0:", "        if x == 0:", "            x = x - 1", "", "        x = x - 2", "", "    leaf{i}(x)", "    return x + y"), ("def leaf{i}(z):", "    return z"),
    ),
    _braces("c", "c", "#include <os.h>", "static int limit = 1;", _c, "while (x > 0) {", "if (x == 0) {"),
    _braces("cpp", "cpp", "#include <os>", "static int limit = 1;", _c, "while (x > 0) {", "if (x == 0) {"),
    _braces("go", "go", 'import "os"', "var limit = 1", lambda name, *params: f"func {name}({', '.join(p + ' int' for p in params)}) int {{", "for x > 0 {", "if x == 0 {", "", top=("package p",)),
    _braces("java", "java", "import java.util.List;", "final int limit = 1;", lambda name, *params: "static " + _c(name, *params), "while (x > 0) {", "if (x == 0) {", open=("class A {",), shut=("}",)),
    _braces("javascript", "js", 'import os from "os";', "const limit = 1;", lambda name, *params: f"function {name}({', '.join(params)}) {{", "while (x > 0) {", "if (x == 0) {"),
    _braces("typescript", "ts", 'import os from "os";', "const limit = 1;", lambda name, *params: f"function {name}({', '.join(p + ': number' for p in params)}): number {{", "while (x > 0) {", "if (x == 0) {"),
    _braces("rust", "rs", "use std::os;", "const LIMIT: i64 = 1;", lambda name, *params: f"fn {name}({', '.join('mut ' + p + ': i64' for p in params)}) -> i64 {{", "while x > 0 {", "if x == 0 {"),
]

BROKEN = "(((\n"


def _lines(lines, n: Column | None = None) -> Column:
    """An array of lines; n: as often, {i} being 0, 1, ..."""
    own = [x for x in lines if x]
    if n is None:
        return F.array(*[F.lit(x) for x in own]) if own else F.expr("CAST(array() AS array<string>)")
    of = lambda i: F.array(*[F.concat(*[y for part in x.split("{i}") for y in (F.lit(part), i.cast("string"))][:-1]) for x in own])
    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), n.cast("int") - 1), of))).otherwise(F.expr("CAST(array() AS array<string>)"))


def _source(g: Program) -> Column:
    a, b, c, d, p = (F.col(x) for x in "abcdp")
    pad = (g.pad[0], *[g.pad[1]] * 20, *g.pad[2:])
    loop = F.concat(_lines(g.root[:2]), _lines(g.root[2:5], a), _lines(g.root[5:7]), _lines(g.root[7:8], c), _lines(g.root[8:]))
    about = _lines([g.note.replace("note", "about root")], d)
    blank = F.array(F.lit(""))
    every = F.concat(_lines(g.top), _lines([g.note], b), blank, _lines([g.imports, *g.open]), _lines(pad, p), _lines([g.constant]), blank, about, loop, blank, _lines(g.leaf, c), _lines(g.shut))
    return F.concat(F.array_join(every, "\n"), F.lit("\n"))


def sources(suppliers: DataFrame, project: Column) -> DataFrame:
    """project, path, content, language of each supplier's program."""
    k = F.col("s_suppkey").cast("long")
    rows = suppliers.select(project.alias("project"), k.alias("k"), (k % 8).alias("lang"), (k % 4).alias("a"), (k % 3).alias("b"), (F.floor(k / 8) % 3).alias("c"), (k % 2).alias("d"), F.when(k % 5 == 0, 2).otherwise(0).alias("p"))
    pick = lambda of: F.element_at(F.array(*[of(g) for g in PROGRAMS]), F.col("lang").cast("int") + 1)
    content = F.coalesce(*[F.when(F.col("lang") == i, _source(g)) for i, g in enumerate(PROGRAMS)])
    content = F.when(k_of(F.col("k")), BROKEN).otherwise(content)
    return rows.select("project", F.concat(F.col("k").cast("string"), F.lit("."), pick(lambda g: F.lit(g.ext))).alias("path"), content.cast("binary").alias("content"), pick(lambda g: F.lit(g.language)).alias("language"))


def k_of(k: Column) -> Column:
    """Whether the key's file is broken."""
    return k % 11 == 5


def _suppliers(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet")


def _facts(spark, sf_dir, project=None) -> Facts:
    own = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    return facts(parse(sources(_suppliers(spark, sf_dir), own if project is None else project)))


def _key() -> Column:
    return F.regexp_extract("path", r"^(\d+)", 1).cast("bigint").alias("k")


def _columns(names: dict[str, str]) -> list[Column]:
    return [F.round(F.col(c).cast("double"), 6).alias(a) for a, c in names.items()]


#: Columns of the queries and the metrics that they show.
FUNCTION_COLUMNS = {
    "length": "size_function_length", "sloc": "size_sloc", "statements": "size_statement_count", "params": "function_parameter_count", "doc_loc": "documentation_doc_loc", "cyclomatic": "complexity_cyclomatic",
    "cognitive": "complexity_cognitive", "branches": "complexity_branch_count", "loops": "complexity_loop_count", "returns": "complexity_return_count", "paths": "complexity_path_count", "max_depth": "nesting_max_depth",
    "avg_depth": "nesting_avg_depth", "calls": "function_call_count", "fan_out": "dependency_fan_out", "fan_in": "dependency_fan_in", "call_depth": "dependency_call_depth",
}
PROJECT_COLUMNS = {
    "loc": "size_loc", "sloc": "size_sloc", "comment_loc": "size_comment_loc", "blank_loc": "size_blank_loc", "comment_ratio": "size_comment_ratio", "statements": "size_statement_count", "functions": "size_function_count",
    "avg_length": "size_avg_function_length", "max_length": "size_max_function_length", "avg_params": "function_avg_parameter_count", "max_params": "function_max_parameter_count", "tokens": "size_token_count",
    "imports": "dependency_dependency_count", "documented": "documentation_documented_function_count", "documentation_ratio": "documentation_documentation_ratio", "cyclomatic": "complexity_cyclomatic", "cognitive": "complexity_cognitive",
    "max_depth": "nesting_max_depth", "avg_depth": "nesting_avg_depth", "calls": "function_call_count", "cyclomatic_per_function": "derived_cyclomatic_per_function", "tokens_per_loc": "derived_tokens_per_loc",
    "statements_per_function": "derived_statements_per_function",
}
FILE_COLUMNS = PROJECT_COLUMNS | {
    "dup_blocks": "duplication_duplicate_block_count", "dup_tokens": "duplication_duplicate_token_count", "dup_longest": "duplication_max_duplicate_length", "dup_ratio": "duplication_duplication_ratio", "dup_per_sloc": "derived_duplicate_tokens_per_sloc",
}


def code_functions(spark, sf_dir):
    """Every function of every program, its metrics by the front ends and the function scope."""
    return metrics.by_function(_facts(spark, sf_dir)).select(_key(), F.col("name").alias("function"), *_columns(FUNCTION_COLUMNS))


def code_files(spark, sf_dir):
    """Every program that parses, by the file scope; the error rows give none."""
    return metrics.by_file(_facts(spark, sf_dir)).select(_key(), "language", *_columns(FILE_COLUMNS))


def code_projects(spark, sf_dir):
    """The programs of a nation as one project."""
    f = _facts(spark, sf_dir, F.col("s_nationkey").cast("string"))
    return metrics.by_project(f).select(F.col("project").cast("bigint").alias("nation"), *_columns(PROJECT_COLUMNS))


def code_status(spark, sf_dir):
    """Files by language and status; a message names the file and a place."""
    parsed = parse(sources(_suppliers(spark, sf_dir), F.lit("p")))
    named = F.col("error").rlike(r"^\d+\.\w+:\d+:\d+: parse error: ")
    return parsed.groupBy("language", "status").agg(F.count(F.lit(1)).alias("n"), F.count_if(named).alias("with_place"))


def code_errors(spark, sf_dir):
    """Files by the language of their extension and by what came of them: some can't be read, aren't UTF-8 or don't parse;
    files of an extension that no language has are left out."""
    k = F.col("k")
    rows = sources(_suppliers(spark, sf_dir), F.lit("p")).withColumn("k", F.regexp_extract("path", r"^(\d+)", 1).cast("bigint"))
    content = F.when(k % 13 == 7, F.lit(None)).when(k % 17 == 3, F.concat(F.unhex(F.lit("FF")), F.col("content"))).otherwise(F.col("content"))
    path = F.when(k % 19 == 4, F.concat(F.col("path"), F.lit(".txt"))).when(k % 23 == 6, F.concat("path", F.lit(".H"))).otherwise(F.col("path"))
    parsed = parse(with_language(rows.select("project", path.alias("path"), content.alias("content"))))
    why = F.when(F.col("error").contains("can't be read"), "unreadable").when(F.col("error").contains("not UTF-8"), "not UTF-8").when(F.col("error").contains("parse error"), "syntax").otherwise(F.col("error"))
    return parsed.groupBy("language", "status", why.alias("why")).agg(F.count(F.lit(1)).alias("n"))


def code_long(spark, sf_dir):
    """The file scope in long form: of each metric how many files have a value, and how many why not."""
    long = metrics.to_long(metrics.by_file(_facts(spark, sf_dir)), "L", ["path"]).filter(F.col("metric").isin(*_LONG))
    return long.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("with_value"), F.count_if(F.col("reason") == "not_applicable").alias("not_applicable"), F.round(F.sum("value"), 4).alias("total"))


def code_language_medians(spark, sf_dir):
    """Quartiles of files' lines by language, over the file scope."""
    files = metrics.by_file(_facts(spark, sf_dir))
    s = stats.summary(files, ["size_loc", "size_token_count"], ["language"])
    return s.select("language", "metric", "n", "missing", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "min", "q1", "median", "q3", "max")])


def code_labels(spark, sf_dir):
    """A label for each program's root, for a leaf that only some have, and for a file; what each of them meets."""
    units = metrics.by_function(_facts(spark, sf_dir, F.lit("p"))).select(F.lit(0).alias("result_no"), "path", F.col("name").alias("function"))
    k = F.col("s_suppkey").cast("long")
    ext = F.element_at(F.array(*[F.lit(g.ext) for g in PROGRAMS]), (k % 8).cast("int") + 1)
    labels = _suppliers(spark, sf_dir).select(F.concat(k.cast("string"), F.lit("."), ext).alias("path"), F.explode(F.array(F.lit("root"), F.lit("leaf0"), F.lit(None).cast("string"))).alias("function"))
    met = model.label_matches(units, labels.withColumn("row_idx", F.monotonically_increasing_id()))
    status = F.when(F.col("n") == 1, "joined").when(F.col("in_path") == 0, "no file").when(F.col("n") == 0, "no function").otherwise("several functions")
    return met.groupBy(F.coalesce("function", F.lit("file")).alias("label"), status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


_LONG = ["size.loc", "size.sloc", "size.comment_loc", "size.blank_loc", "size.comment_ratio", "size.token_count", "duplication.duplication_ratio", "derived.statements_per_function", "derived.tokens_per_loc", "derived.duplicate_tokens_per_sloc", "documentation.documentation_ratio"]

QUERIES = {f.__name__: f for f in (code_functions, code_files, code_projects, code_status, code_errors, code_long, code_language_medians, code_labels)}

# Counted by hand from the programs above. Of each language: lines and code lines beside the branches, calls, leaves and
# pads; lines of a branch, a leaf, a pad; tokens beside those; tokens of a branch, of a call with its leaf, of a pad; what
# precedes the first pad and looks as what precedes the second; statements outside of functions (Java's fields and Rust's
# constants are none); whether loops, branches and returns stand in a statement of their own.
#
#   python      import os | LIMIT = 1 | def root ( x , y ) : | while x > 0 : | x = x - 2 | return x + y          2+3+8+5+5+4 = 27
#   c, cpp      # include <os.h> | static int limit = 1 ; | int root ( int x , int y ) { | while ( x > 0 ) { | x = x - 2 ; | } | return x + y ; | }
#               2 + 6 + 10 + 7 + 6 + 1 + 5 + 1 = 38
#   go          package p | import "os" | var limit = 1 | func root ( x int , y int ) int { | for x > 0 { | x = x - 2 | } | return x + y | }
#               2 + 2 + 4 + 11 + 5 + 5 + 1 + 4 + 1 = 35
#   java        import java . util . List ; | class A { | final int limit = 1 ; | static int root ... { | ... as c | }
#               7 + 3 + 6 + 11 + 7 + 6 + 1 + 5 + 1 + 1 = 48
#   javascript  import os from "os" ; | const limit = 1 ; | function root ( x , y ) { | ... as c                        5+5+8+7+6+1+5+1 = 38
#   typescript  import os from "os" ; | const limit = 1 ; | function root ( x : number , y : number ) : number { | ...   5+5+14+7+6+1+5+1 = 44
#   rust        use std :: os ; | const LIMIT : i64 = 1 ; | fn root ( mut x : i64 , mut y : i64 ) -> i64 { | while x > 0 { | x = x - 2 ; | } | return x + y ; | }
#               5 + 7 + 16 + 5 + 6 + 1 + 5 + 1 = 46
_VALUES = """programs(lang, language, loc0, sloc0, branch_lines, leaf_lines, pad_lines, length0, tokens0, branch_tokens, leaf_tokens, pad_tokens, before_pad, statements0, wrapped) AS (VALUES
 (0, 'python', 9, 6, 2, 2, 22, 4, 27, 10, 12, 108, 1, 1, 0), (1, 'c', 11, 8, 3, 3, 23, 6, 38, 14, 16, 131, 0, 1, 0), (2, 'cpp', 11, 8, 3, 3, 23, 6, 38, 14, 16, 131, 0, 1, 0),
 (3, 'go', 12, 9, 3, 3, 23, 6, 35, 11, 15, 111, 0, 1, 0), (4, 'java', 13, 10, 3, 3, 23, 6, 48, 14, 17, 132, 0, 0, 0), (5, 'javascript', 11, 8, 3, 3, 23, 6, 38, 14, 15, 130, 0, 1, 0),
 (6, 'typescript', 11, 8, 3, 3, 23, 6, 44, 14, 19, 134, 0, 1, 0), (7, 'rust', 11, 8, 3, 3, 23, 6, 46, 12, 20, 135, 0, 0, 1))"""
_SQL = f"""WITH {_VALUES},
s AS (SELECT s_suppkey AS k, s_nationkey AS nation, s_suppkey % 8 AS lang, s_suppkey % 4 AS a, s_suppkey % 3 AS b, (s_suppkey // 8) % 3 AS c, s_suppkey % 2 AS d, CASE WHEN s_suppkey % 5 = 0 THEN 2 ELSE 0 END AS p FROM supplier WHERE s_suppkey % 11 <> 5),
m AS (SELECT s.*, language, statements0, loc0 + a * branch_lines + c * (1 + leaf_lines) + p * pad_lines + b + d AS loc, sloc0 + a * branch_lines + c * (1 + leaf_lines) + p * pad_lines AS sloc, b + d AS comment_loc, 3 AS blank_loc,
  length0 + a * branch_lines + c AS root_length, leaf_lines AS leaf_length, pad_lines AS pad_length, tokens0 + a * branch_tokens + c * leaf_tokens + p * pad_tokens AS tokens,
  1 + c + p AS functions, 2 + c + p AS params, 2 * a + c + 3 + wrapped * (a + 2) AS root_statements, 1 + wrapped AS leaf_statements, 21 + wrapped AS pad_statements, a + 1 AS decisions, 1 + 2 * a AS cognitive,
  CASE WHEN a > 0 THEN 2 ELSE 1 END AS max_depth, 3 * a + 1 + wrapped * a AS level_sum, CASE WHEN p > 0 THEN 2 * pad_tokens + before_pad ELSE 0 END AS dup, CASE WHEN p > 0 THEN 1 ELSE 0 END AS dup_blocks
  FROM s JOIN programs USING (lang))"""


def _doubles(columns: dict[str, str]) -> str:
    return ", ".join(f"round(CAST({x} AS DOUBLE), 6) AS {a}" for a, x in columns.items())


_FUNCTIONS_SQL = f"""{_SQL}, f AS (
 SELECT k, 'root' AS function, root_length AS length, root_statements AS statements, 2 AS params, d AS doc_loc, a + 2 AS cyclomatic, cognitive, a AS branches, 1 AS loops, 1 AS returns, 2 ** a + 1 AS paths, max_depth,
  level_sum::DOUBLE / root_statements AS avg_depth, c AS calls, c AS fan_out, 0 AS fan_in, CASE WHEN c > 0 THEN 1 ELSE 0 END AS call_depth FROM m
 UNION ALL SELECT k, 'leaf' || i, leaf_length, leaf_statements, 1, 0, 1, 0, 0, 0, 1, 1, 0, 0, 0, 0, 1, 0 FROM m, range(2) t(i) WHERE i < c
 UNION ALL SELECT k, 'pad' || i, pad_length, pad_statements, 1, 0, 1, 0, 0, 0, 1, 1, 0, 0, 0, 0, 0, 0 FROM m, range(2) t(i) WHERE i < p)
SELECT k, function, {_doubles({a: a if a != 'sloc' else 'length' for a in FUNCTION_COLUMNS})} FROM f"""

_TOTALS = {
    "loc": "loc", "sloc": "sloc", "comment_loc": "comment_loc", "blank_loc": "blank_loc", "comment_ratio": "comment_loc::DOUBLE / loc", "statements": "statements", "functions": "functions",
    "avg_length": "lengths::DOUBLE / functions", "max_length": "max_length", "avg_params": "params::DOUBLE / functions", "max_params": "2", "tokens": "tokens", "imports": "imports", "documented": "d",
    "documentation_ratio": "d::DOUBLE / functions", "cyclomatic": "functions + decisions", "cognitive": "cognitive", "max_depth": "max_depth", "avg_depth": "level_sum::DOUBLE / statements", "calls": "c",
    "cyclomatic_per_function": "(functions + decisions)::DOUBLE / functions", "tokens_per_loc": "tokens::DOUBLE / loc", "statements_per_function": "statements::DOUBLE / functions",
}
_FILE = """l AS (SELECT m.*, 1 AS imports, statements0 + root_statements + c * leaf_statements + p * pad_statements AS statements, root_length + c * leaf_length + p * pad_length AS lengths, greatest(root_length, CASE WHEN c > 0 THEN leaf_length ELSE 0 END, CASE WHEN p > 0 THEN pad_length ELSE 0 END) AS max_length FROM m)"""
_DUPLICATES = {"dup_blocks": "dup_blocks", "dup_tokens": "dup", "dup_longest": "dup", "dup_ratio": "dup::DOUBLE / tokens", "dup_per_sloc": "dup::DOUBLE / sloc"}
_LONG_SQL = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, count(*) AS n, count(*) AS with_value, 0::BIGINT AS not_applicable, round(CAST(sum({x}) AS DOUBLE), 4) AS total FROM r"
    for m, x in (
        ("size.loc", "loc"), ("size.sloc", "sloc"), ("size.comment_loc", "comment_loc"), ("size.blank_loc", "blank_loc"), ("size.comment_ratio", "comment_ratio"), ("size.token_count", "tokens"), ("duplication.duplication_ratio", "dup_ratio"),
        ("derived.statements_per_function", "statements_per_function"), ("derived.tokens_per_loc", "tokens_per_loc"), ("derived.duplicate_tokens_per_sloc", "dup_per_sloc"), ("documentation.documentation_ratio", "documentation_ratio"),
    )
)
_SUMMARY_SQL = "SELECT language, '{m}' AS metric, count(*) AS n, 0::BIGINT AS missing, round(avg({c}::DOUBLE), 6) AS mean, round(CASE WHEN count(*) > 1 THEN stddev_samp({c}::DOUBLE) END, 6) AS sd, min({c})::DOUBLE AS min, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q1, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median, round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q3, max({c})::DOUBLE AS max FROM l GROUP BY language"
_SUMS = "loc sloc comment_loc blank_loc statements functions lengths params tokens imports d decisions cognitive level_sum c".split()

ORACLE = {
    "code_functions": _FUNCTIONS_SQL,
    "code_files": f"{_SQL}, {_FILE} SELECT k, language, {_doubles(_TOTALS | _DUPLICATES)} FROM l",
    "code_projects": f"""{_SQL}, {_FILE}, n AS (SELECT nation, {', '.join(f'sum({c}) AS {c}' for c in _SUMS)}, max(max_length) AS max_length, max(max_depth) AS max_depth FROM l GROUP BY nation)
SELECT CAST(nation AS BIGINT) AS nation, {_doubles(_TOTALS)} FROM n""",
    "code_long": f"{_SQL}, {_FILE}, r AS (SELECT k, {_doubles(_TOTALS | _DUPLICATES)} FROM l) {_LONG_SQL}",
    "code_language_medians": f"{_SQL}, {_FILE} " + " UNION ALL ".join(_SUMMARY_SQL.format(m=m, c=c) for m, c in (("size_loc", "loc"), ("size_token_count", "tokens"))),
    "code_labels": """WITH s AS (SELECT s_suppkey % 11 = 5 AS bad, (s_suppkey // 8) % 3 AS c, s_suppkey % 5 = 0 AS padded FROM supplier), l AS (SELECT s.*, unnest(['root', 'leaf0', 'file']) AS label FROM s)
SELECT label, CASE WHEN bad THEN 'no file' WHEN label = 'leaf0' AND c = 0 THEN 'no function' WHEN label = 'file' AND (c > 0 OR padded) THEN 'several functions' ELSE 'joined' END AS status, count(*) AS n FROM l GROUP BY ALL""",
    "code_errors": f"""WITH {_VALUES}, s AS (SELECT s_suppkey AS k, s_suppkey % 8 AS lang FROM supplier WHERE s_suppkey % 19 <> 4 AND s_suppkey % 23 <> 6),
w AS (SELECT language, CASE WHEN k % 13 = 7 THEN 'unreadable' WHEN k % 17 = 3 THEN 'not UTF-8' WHEN k % 11 = 5 THEN 'syntax' END AS why FROM s JOIN programs USING (lang))
SELECT language, CASE WHEN why IS NULL THEN 'ok' ELSE 'error' END AS status, why, count(*) AS n FROM w GROUP BY ALL""",
    "code_status": f"""WITH {_VALUES}, s AS (SELECT s_suppkey % 8 AS lang, s_suppkey % 11 = 5 AS bad FROM supplier)
SELECT language, CASE WHEN bad THEN 'error' ELSE 'ok' END AS status, count(*) AS n, count(*) FILTER (bad) AS with_place FROM s JOIN programs USING (lang) GROUP BY ALL""",
}
