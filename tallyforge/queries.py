"""The operators as queries over the driver's tables, with the same results as DuckDB SQL.

The tables hold no source files. Token and line operators run over documents.text through the text adapter's pattern;
scripts cut from pages go through the real JavaScript front end; statistics and the model run over numeric tables; some
tree operators run over 20 rows written out on both sides. code_queries has those that run over generated programs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frontend.text_front import PATTERN
from . import code_queries
from .operators import duplication, metrics, model, stats
from .operators.parse import Facts, facts, parse

_SPARK_PATTERN = PATTERN.replace("\\", "\\\\")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, text of documents; a table of fewer partitions than there are threads is dealt out before its texts
    are taken apart."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    threads = spark.sparkContext.defaultParallelism
    return docs.repartition(threads) if docs.rdd.getNumPartitions() < threads else docs


def _r(c, alias: str):
    return F.round(c if not isinstance(c, str) else F.col(c), 6).alias(alias)


def _whole(c, alias: str):
    return (F.col(c) if isinstance(c, str) else c).cast("bigint").alias(alias)


def _is_name(token: Column) -> Column:
    """A token is known by its first sign."""
    first = F.ascii(token)
    return first.between(65, 90) | first.between(97, 122) | (first == 95)


def _is_number(token: Column) -> Column:
    return F.ascii(token).between(48, 57)


def _is_word(token: Column) -> Column:
    return _is_name(token) | _is_number(token)


def text_tokens(docs: DataFrame, project=None) -> DataFrame:
    """Tokens of documents.text by the text adapter's pattern, without leaving the JVM."""
    words = F.expr(f"regexp_extract_all(text, '{_SPARK_PATTERN}', 0)")
    rows = docs.select((project if project is not None else F.lit("documents")).alias("project"), F.col("doc_id").cast("string").alias("path"), F.posexplode(words).alias("pos", "text"))
    kind = F.when(_is_name(F.col("text")), "identifier").when(_is_number(F.col("text")), "literal").when(F.col("text").isin(*",;()[]{}"), "punctuation").otherwise("operator")
    return rows.withColumn("kind", kind)


def text_codes(docs: DataFrame, project=None) -> DataFrame:
    """The same tokens as codes for duplication: one character a token, x for names and 0 for literals, without the gaps."""
    codes = F.col("text")
    for pattern, code in (("[A-Za-z_][A-Za-z0-9_]*", "x"), ("[0-9]+", "0"), ("[ \t\r\n]+", "")):
        codes = F.regexp_replace(codes, pattern, code)
    return docs.select((project if project is not None else F.lit("documents")).alias("project"), F.col("doc_id").cast("string").alias("path"), codes.alias("codes"))


_TOKENS = f"tok AS (SELECT doc_id, source, unnest(regexp_extract_all(text, '{PATTERN}')) AS w FROM documents)"
_ROLE = """role AS (SELECT *, CASE WHEN regexp_matches(w, '^[A-Za-z_]') OR regexp_matches(w, '^[0-9]') THEN 'operand'
  WHEN w IN ('(', '[', '{') THEN 'operator' WHEN w IN (',', ';', ')', ']', '}') THEN NULL ELSE 'operator' END AS r FROM tok)"""

HALSTEAD = ["unique_operators", "unique_operands", "total_operators", "total_operands", "vocabulary", "length", "volume", "difficulty", "effort", "time", "bugs"]


def _halstead_columns() -> list:
    cells = metrics.halstead(F.col("n1"), F.col("n2"), F.col("t1"), F.col("t2"))
    return [_whole(cells[f"halstead_{h}"], h) if k < 6 else _r(cells[f"halstead_{h}"], h) for k, h in enumerate(HALSTEAD)]


def _halstead_sql(key: str, group: str) -> str:
    return f"""WITH {_TOKENS}, {_ROLE},
c AS (SELECT {key} count(DISTINCT w) FILTER (r = 'operator') AS n1, count(DISTINCT w) FILTER (r = 'operand') AS n2,
  count(*) FILTER (r = 'operator') AS t1, count(*) FILTER (r = 'operand') AS t2 FROM role {group}),
d AS (SELECT *, n1 + n2 AS vocabulary, t1 + t2 AS length, CASE WHEN n1 + n2 > 0 THEN (t1 + t2) * log2((n1 + n2)::DOUBLE) END AS volume,
  CASE WHEN n2 > 0 THEN n1 / 2.0::DOUBLE * (t2::DOUBLE / n2) END AS difficulty FROM c)
SELECT {'doc_id,' if 'doc_id' in key else 'source,' if 'source' in key else ''} n1 AS unique_operators, n2 AS unique_operands, t1 AS total_operators, t2 AS total_operands,
  vocabulary, length, round(volume, 6) AS volume, round(difficulty, 6) AS difficulty, round(difficulty * volume, 6) AS effort,
  round(difficulty * volume / 18.0::DOUBLE, 6) AS time, round(volume / 3000.0::DOUBLE, 6) AS bugs FROM d"""


# -- text operators over documents


def size_loc_by_doc(spark, sf_dir):
    lines = F.split(F.col("text"), "\n")
    loc = F.when(F.col("text") == "", 0).otherwise(F.size(lines) - F.when(F.col("text").endswith("\n"), 1).otherwise(0))
    return _table(spark, sf_dir, "documents").select("doc_id", _whole(loc, "loc"))


def _text_facts(docs: DataFrame) -> DataFrame:
    """Lines of documents with what they hold: (doc_id, solid, code)."""
    rows = docs.filter("text <> ''").select("doc_id", F.posexplode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("line", "t"))
    return rows.select("doc_id", "line", F.col("t").rlike(PATTERN).alias("code"), (F.regexp_replace("t", "[ \\t\\r]", "") != "").alias("solid"))


def size_line_classes_by_doc(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    n = _text_facts(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("loc"), F.count_if("code").alias("sloc"), F.count_if(~F.col("solid")).alias("blank_loc"))
    out = docs.select("doc_id").join(n, "doc_id", "left")
    return out.select("doc_id", *[_whole(F.coalesce(c, F.lit(0)), c) for c in ("loc", "sloc", "blank_loc")])


def size_project_totals(spark, sf_dir):
    return size_line_classes_by_doc(spark, sf_dir).agg(*[_whole(F.sum(c), c) for c in ("loc", "sloc", "blank_loc")], _whole(F.count(F.lit(1)), "files"))


def size_comment_ratio_project(spark, sf_dir):
    """The ratio of sums, not the mean of ratios; blank lines stand in for comments."""
    t = size_line_classes_by_doc(spark, sf_dir).join(_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("loc").alias("loc"), F.sum("blank_loc").alias("blank"))
    return t.select("source", _r(metrics.ratio("blank", "loc"), "ratio"))


_LINES_SQL = f"""line AS (SELECT doc_id, source, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS t FROM documents WHERE text <> ''),
per AS (SELECT doc_id, any_value(source) AS source, count(*) AS loc, count(*) FILTER (regexp_matches(t, '{PATTERN}')) AS sloc,
  count(*) FILTER (regexp_replace(t, '[ \\t\\r]', '', 'g') = '') AS blank_loc FROM line GROUP BY doc_id),
al AS (SELECT doc_id, source, coalesce(loc, 0) AS loc, coalesce(sloc, 0) AS sloc, coalesce(blank_loc, 0) AS blank_loc
  FROM (SELECT doc_id, source FROM documents) LEFT JOIN (SELECT doc_id, loc, sloc, blank_loc FROM per) USING (doc_id))"""


def size_token_count_by_doc(spark, sf_dir):
    n = F.size(F.expr(f"regexp_extract_all(text, '{_SPARK_PATTERN}', 0)"))
    return _table(spark, sf_dir, "documents").select("doc_id", _whole(n, "token_count"))


def _with_all(docs: DataFrame, counted: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("string").alias("path"), "doc_id").join(counted, "path", "left").fillna(0.0)


def halstead_by_doc(spark, sf_dir):
    words = F.expr(f"regexp_extract_all(text, '{_SPARK_PATTERN}', 0)")
    counted = metrics.count_texts(_texts(spark, sf_dir), ["doc_id"], words, lambda w: ~_is_word(w) & ~w.isin(*",;)]}"), _is_word)
    return counted.filter("size_token_count > 0").select("doc_id", *_halstead_columns())


def halstead_by_source(spark, sf_dir):
    tokens = text_tokens(_texts(spark, sf_dir), F.col("source"))
    return metrics._tokens(tokens, ["project"]).select(F.col("project").alias("source"), *_halstead_columns())


def halstead_project(spark, sf_dir):
    return metrics._tokens(text_tokens(_texts(spark, sf_dir)), ["project"]).select(*_halstead_columns())


def derived_mi_by_doc(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    h = halstead_by_doc(spark, sf_dir).select("doc_id", "volume")
    lines = size_line_classes_by_doc(spark, sf_dir).select("doc_id", "sloc")
    out = docs.select("doc_id").join(lines, "doc_id").join(h, "doc_id", "left")
    return out.select("doc_id", _r(metrics.maintainability(F.col("volume"), F.lit(1.0), F.col("sloc")), "maintainability"))


def derived_tokens_per_loc(spark, sf_dir):
    t = size_token_count_by_doc(spark, sf_dir).join(size_loc_by_doc(spark, sf_dir), "doc_id")
    return t.select("doc_id", _r(F.try_divide(F.col("token_count").cast("double"), F.col("loc").cast("double")), "tokens_per_loc"))


def dup_by_doc(spark, sf_dir):
    """duplicate tokens, blocks and longest run of documents that have any."""
    d = duplication.by_file(text_codes(_texts(spark, sf_dir)))
    return d.select(F.col("path").cast("bigint").alias("doc_id"), _whole("duplication_duplicate_token_count", "tokens"), _whole("duplication_duplicate_block_count", "blocks"), _whole("duplication_max_duplicate_length", "longest"))


def dup_project(spark, sf_dir):
    d = duplication.by_project(text_codes(_texts(spark, sf_dir), F.col("source")))
    return d.select(F.col("project").alias("source"), _whole("duplication_duplicate_token_count", "tokens"), _whole("duplication_duplicate_block_count", "blocks"), _whole("duplication_max_duplicate_length", "longest"))


def _dup_sql(scope: str) -> str:
    key = "doc_id, h" if scope == "doc_id" else "source, h"
    head = "doc_id" if scope == "doc_id" else "source"
    return f"""WITH a AS (SELECT doc_id, source, list_transform(regexp_extract_all(text, '{PATTERN}'),
  lambda w: CASE WHEN regexp_matches(w, '^[A-Za-z_]') THEN '$id' WHEN regexp_matches(w, '^[0-9]') THEN '$lit' ELSE w END) AS t FROM documents),
win AS (SELECT doc_id, source, s, array_to_string(list_slice(t, s + 1, s + 50), ' ') AS h FROM (SELECT *, unnest(range(0, len(t) - 49)) AS s FROM a WHERE len(t) >= 50)),
hot AS (SELECT doc_id, source, s FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS n FROM win) WHERE n > 1),
gap AS (SELECT *, s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM hot),
run AS (SELECT *, sum(CASE WHEN g IS NULL OR g > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM gap),
each_run AS (SELECT doc_id, any_value(source) AS source, k, max(s) - min(s) + 50 AS n FROM run GROUP BY doc_id, k)
SELECT {head}, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS blocks, CAST(max(n) AS BIGINT) AS longest FROM each_run GROUP BY {head}"""


def result_long(spark, sf_dir):
    """A few measures of each source in the long form: metric, value, reason."""
    h = halstead_by_source(spark, sf_dir)
    cells = [F.struct(F.lit(f"halstead.{c}").alias("metric"), F.col(c).cast("double").alias("value")) for c in ("length", "volume", "difficulty")]
    rows = h.select("source", F.explode(F.array(*cells)).alias("m")).select("source", "m.*")
    return rows.withColumn("reason", F.when(F.col("value").isNull(), "not_applicable"))


# -- scripts of pages, through the JavaScript front end


#: Fixed value: a script's code in a page.
SCRIPT = r"(?is)<script\b[^>]*>(.*?)</script"


def _scripts(spark, sf_dir) -> Facts:
    pages = _table(spark, sf_dir, "pages")
    body = F.array_join(F.regexp_extract_all("html", F.lit(SCRIPT), F.lit(1)), "\n")  # all scripts of a page
    src = pages.select(F.lit("pages").alias("project"), F.concat(F.col("page_id").cast("string"), F.lit(".js")).alias("path"), body.cast("binary").alias("content"), F.lit("javascript").alias("language"))
    return parse(src)


def js_metrics(spark, sf_dir):
    f = facts(_scripts(spark, sf_dir))
    page = F.regexp_extract("path", r"^(\d+)", 1).cast("bigint").alias("page_id")
    out = f.files.select("project", "path").join(metrics.nodes_by_file(f), metrics.FILE).join(metrics.tokens_by_file(f), metrics.FILE).join(metrics.lines_by_file(f), metrics.FILE)
    fns = metrics.functions_by(f, metrics.FILE).select("project", "path", "size_function_count")
    out = out.join(fns, metrics.FILE, "left").fillna(0.0, ["size_function_count"])
    return out.select(page, _whole("size_token_count", "token_count"), _whole("size_statement_count", "statement_count"), _whole("size_function_count", "function_count"), _whole(F.col("size_function_count") + F.col("decisions"), "cyclomatic"), _whole("function_call_count", "call_count"), _whole("function_expression_count", "expression_count"), _whole("n1", "unique_operators"), _whole("n2", "unique_operands"), _whole("size_loc", "loc"))


JS_SQL = """SELECT page_id, len(regexp_extract_all(b, '"(?:[^"])*"|[A-Za-z_]\\w*|[0-9]+|[^\\sA-Za-z0-9_]')) AS token_count,
 2::BIGINT AS statement_count, 0::BIGINT AS function_count, 0::BIGINT AS cyclomatic, 1::BIGINT AS call_count, 1::BIGINT AS expression_count,
 3::BIGINT AS unique_operators, len(list_distinct(list_filter(regexp_extract_all(b, '"(?:[^"])*"|[A-Za-z_]\\w*|[0-9]+'), lambda w: w <> 'var'))) AS unique_operands, 1::BIGINT AS loc
FROM (SELECT page_id, array_to_string(regexp_extract_all(html, '""" + SCRIPT + """', 1), chr(10)) AS b FROM pages)"""


def js_status(spark, sf_dir):
    return _scripts(spark, sf_dir).groupBy("language", "status").agg(_whole(F.count(F.lit(1)), "n"))


# -- rows written out on both sides

#: Fixed values: (path, node, parent, kind, label, owner function, level, cognitive level, continuation, parent's kind,
#: parent's label, previous sibling's kind, wraps a continuation) of a small tree.
NODES = [
    ("a", 2, 1, "loop", None, 0, 0, 0, False, "block", None, None, False), ("a", 3, 2, "branch", None, 0, 1, 1, False, "loop", None, None, False),
    ("a", 4, 3, "logical", "&&", 0, 2, 2, False, "branch", None, None, False), ("a", 5, 4, "logical", "&&", 0, 2, 2, False, "logical", "&&", None, False),
    ("a", 6, 3, "else", None, 0, 2, 2, False, "branch", None, "logical", True), ("a", 7, 6, "branch", None, 0, 1, 1, True, "else", None, None, False),
    ("a", 8, 7, "else", None, 0, 2, 2, False, "branch", None, None, False), ("a", 9, 8, "jump", None, 0, 2, 2, False, "else", None, None, False),
    ("a", 10, 1, "return", None, 0, 0, 0, False, "block", None, "loop", False), ("a", 11, 10, "conditional", None, 0, 0, 0, False, "return", None, None, False),
    ("b", 2, 1, "case", None, 0, 0, 0, False, "block", None, None, False), ("b", 3, 2, "statement", None, 0, 1, 1, False, "case", None, None, False),
    ("b", 4, 3, "call", "run", 0, 1, 1, False, "statement", None, None, False), ("b", 5, 1, "case", None, 0, 0, 0, False, "block", None, "case", False),
    ("b", 6, 1, "other", None, 0, 0, 0, False, "block", None, "case", False), ("b", 7, 1, "case", None, 0, 0, 0, False, "block", None, "other", False),
    ("b", 8, 1, "catch", None, 0, 0, 0, False, "block", None, "case", False), ("b", 9, 8, "assignment", None, 0, 1, 1, False, "catch", None, None, False),
    ("b", 10, 9, "binary", None, 0, 1, 1, False, "assignment", None, None, False), ("b", 11, None, "import", None, None, 0, 0, False, None, None, None, False),
]
_NODE_COLUMNS = "path, node_id, parent_id, kind, label, owner_fn, level, cog_level, is_continuation, parent_kind, parent_label, prev_kind, wraps_continuation"


def _literal(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'"


NODES_SQL = f"nodes({_NODE_COLUMNS}) AS (VALUES " + ", ".join("(" + ", ".join(map(_literal, n)) + ")" for n in NODES) + ")"


def _nodes(spark) -> Facts:
    rows = spark.sql(f"WITH {NODES_SQL} SELECT 'p' AS project, * FROM nodes")
    fns = spark.sql("SELECT 'p' AS project, path, 0 AS fn_id, name FROM VALUES ('a', 'go'), ('b', 'run') AS t(path, name)")
    return Facts(rows.select("project", "path").distinct(), rows, rows, fns)


def nodes_branch_counts(spark, sf_dir):
    n = metrics.nodes_by_function(_nodes(spark))
    return n.select("path", _whole(F.col("decisions") + 1, "cyclomatic"), *[_whole(f"complexity_{k}_count", k) for k in ("branch", "conditional", "loop", "return", "jump")], _whole("complexity_cognitive", "cognitive"), _whole("nesting_max_depth", "max_depth"), _r(metrics.ratio("level_sum", "own_statements"), "avg_depth"), _whole("function_expression_count", "expressions"), _whole("function_call_count", "calls"))


NODES_COUNT_SQL = f"""WITH {NODES_SQL}
SELECT path, count(*) FILTER (kind IN ('branch','loop','case','catch','logical','conditional')) + 1 AS cyclomatic,
 count(*) FILTER (kind IN ('branch','case')) AS branch, count(*) FILTER (kind = 'conditional') AS conditional, count(*) FILTER (kind = 'loop') AS loop,
 count(*) FILTER (kind = 'return') AS return, count(*) FILTER (kind = 'jump') AS jump,
 CAST(sum(CASE WHEN kind = 'branch' AND is_continuation THEN 1 WHEN kind IN ('branch','loop','catch','conditional') THEN cog_level + 1
  WHEN kind = 'else' THEN CASE WHEN wraps_continuation THEN 0 ELSE 1 END WHEN kind = 'case' THEN CASE WHEN prev_kind = 'case' THEN 0 ELSE cog_level + 1 END
  WHEN kind = 'logical' THEN CASE WHEN parent_kind = 'logical' AND parent_label IS NOT DISTINCT FROM label THEN 0 ELSE 1 END
  WHEN kind = 'call' AND label = CASE path WHEN 'a' THEN 'go' ELSE 'run' END THEN 1 ELSE 0 END) AS BIGINT) AS cognitive,
 CAST(coalesce(max(CASE WHEN kind IN ('branch','loop','case','catch') AND NOT is_continuation THEN level + 1 END), 0) AS BIGINT) AS max_depth,
 round(sum(CASE WHEN kind IN ('statement','declaration','branch','loop','return','jump') THEN level END)::DOUBLE / count(*) FILTER (kind IN ('statement','declaration','branch','loop','return','jump')), 6) AS avg_depth,
 count(*) FILTER (kind IN ('expression','call','assignment','binary','logical','conditional','unary')) AS expressions, count(*) FILTER (kind = 'call') AS calls
FROM nodes WHERE owner_fn IS NOT NULL GROUP BY path"""


def nodes_by_file(spark, sf_dir):
    n = metrics.nodes_by_file(_nodes(spark))
    return n.select("path", _whole("decisions", "decisions"), _whole("dependency_dependency_count", "imports"), _whole("size_statement_count", "statements"))


# -- graphs and statistics over numeric tables


def _orders_as_calls(spark, sf_dir) -> Facts:
    """Orders as functions of one file, the parts they name as calls."""
    lines = _table(spark, sf_dir, "lineitem").select(F.lit("p").alias("project"), F.lit("a").alias("path"), F.col("l_orderkey").alias("owner_fn"), F.lit("call").alias("kind"), F.col("l_partkey").cast("string").alias("label"))
    return Facts(None, lines, None, None)


def fan_out_orders(spark, sf_dir):
    """Distinct parts that an order names: distinct callees of a caller."""
    n = metrics.fan_out(metrics.calls(_orders_as_calls(spark, sf_dir)))
    return n.select(F.col("fn_id").alias("l_orderkey"), _whole("dependency_fan_out", "fan_out"))


def fan_in_parts(spark, sf_dir):
    """Distinct orders that name a part; parts that none names have 0."""
    names = _table(spark, sf_dir, "part").select(F.lit("p").alias("project"), F.col("p_partkey").cast("string").alias("name"))
    n = metrics.fan_in(metrics.calls(_orders_as_calls(spark, sf_dir)), names)
    return names.join(n, ["project", "name"], "left").select(F.col("name").cast("bigint").alias("p_partkey"), _whole(F.coalesce("dependency_fan_in", F.lit(0)), "fan_in"))


def call_depth_regions(spark, sf_dir):
    """The longest chain from each name of a graph region -> nation -> market segment."""
    nation, region, customer = (_table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    a = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit("p").alias("project"), F.col("r_name").alias("caller"), F.col("n_name").alias("callee"))
    b = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.lit("p").alias("project"), F.col("n_name").alias("caller"), F.concat(F.lit("seg:"), "c_mktsegment").alias("callee"))
    edges = a.unionByName(b).distinct()
    names = edges.select("project", F.col("caller").alias("name")).unionByName(edges.select("project", F.col("callee").alias("name")))
    return metrics.name_depths(edges, names).select("name", _whole("depth", "depth"))


CALL_DEPTH_SQL = """WITH RECURSIVE e AS (SELECT DISTINCT r_name AS a, n_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION SELECT DISTINCT n_name, 'seg:' || c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey),
v AS (SELECT a AS name FROM e UNION SELECT b FROM e),
w AS (SELECT name, name AS here, 0 AS d FROM v UNION ALL SELECT w.name, e.b, w.d + 1 FROM w JOIN e ON w.here = e.a)
SELECT name, CAST(max(d) AS BIGINT) AS depth FROM w GROUP BY name"""


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount"]


def _summary(df: DataFrame, columns: list[str], by=None) -> DataFrame:
    s = stats.summary(df, columns, by)
    return s.select(*(by or []), "metric", _whole("n", "n"), _whole("missing", "missing"), *[_r(c, c) for c in ("mean", "sd", "min", "q1", "median", "q3", "max")])


def _summary_sql(source: str, columns: list[str], by: str = "") -> str:
    head, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    one = "SELECT {h}'{c}' AS metric, count({c}) AS n, count(*) - count({c}) AS missing, round(avg({c}::DOUBLE), 6) AS mean, round(stddev_samp({c}::DOUBLE), 6) AS sd, round(min({c})::DOUBLE, 6) AS min, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q1, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median, round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q3, round(max({c})::DOUBLE, 6) AS max FROM {s} {g}"
    return " UNION ALL ".join(one.format(h=head, c=c, s=source, g=group) for c in columns)


def stats_summary_lineitem(spark, sf_dir):
    return _summary(_table(spark, sf_dir, "lineitem"), _MEASURES)


def stats_by_language_docs(spark, sf_dir):
    return _summary(_table(spark, sf_dir, "documents"), ["n_chars"], ["lang"])


def stats_summary_missing(spark, sf_dir):
    return _summary(_table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left"), ["quality", "toxic"])


def stats_correlations_lineitem(spark, sf_dir):
    c = stats.correlations(_table(spark, sf_dir, "lineitem"), [*_MEASURES, "l_tax"])
    return c.select("a", "b", _whole("n", "n"), _r("pearson", "pearson"), _r("spearman", "spearman"))


def _correlation_sql(table: str, columns: list[str]) -> str:
    from itertools import combinations

    one = """SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, CASE WHEN count(*) >= 3 AND var_pop(x) > 0 AND var_pop(y) > 0 THEN round(covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)), 6) END AS pearson,
 CASE WHEN count(*) >= 3 AND var_pop(rx) > 0 AND var_pop(ry) > 0 THEN round(covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)), 6) END AS spearman
FROM (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry
 FROM (SELECT {a}::DOUBLE AS x, {b}::DOUBLE AS y FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL))"""
    return " UNION ALL ".join(one.format(a=a, b=b, t=table) for a, b in combinations(columns, 2))


def stats_correlations_orders(spark, sf_dir):
    c = stats.correlations(_table(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"])
    return c.select("a", "b", _whole("n", "n"), _r("pearson", "pearson"), _r("spearman", "spearman"))


def stats_corr_zero_variance(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").select("l_quantity", F.lit(1.0).alias("one"))
    return stats.pearson(df, "l_quantity", "one").select(_whole("n", "n"), _r("pearson", "pearson"))


def stats_rank_ties(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return p.select("p_partkey", _r(stats.average_rank("p_size", ["p_brand"]), "rank"))


def hist_extendedprice(spark, sf_dir):
    h = stats.histogram(_table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return h.select("bin", _r("lo", "lo"), _r("hi", "hi"), _whole("n", "n"))


def medians_pivot(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    languages = sorted(r[0] for r in docs.select("lang").distinct().collect() if r[0])  # a column each
    m = stats.medians_by_language(docs, ["n_chars"], languages, "lang")
    return m.select("metric", *[_r(x, x) for x in languages])


def _ridge_rows(spark, sf_dir) -> DataFrame:
    d = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id")
    return d.select(F.col("doc_id").alias("row_idx"), F.col("n_chars").cast("double").alias("x"), F.col("quality").cast("double").alias("score"))


def ridge_fit_quality(spark, sf_dir):
    m = model.fit(_ridge_rows(spark, sf_dir), "file", ["x"], lam=1.0, public=str)
    return spark.createDataFrame([(m.n, round(m.means[0], 6), round(m.sds[0], 6), round(m.coefficients[0], 6), round(m.intercept, 6), round(m.r_squared, 6), round(m.cv_rmse, 6))], "n long, mean double, sd double, coefficient double, intercept double, r_squared double, cv_rmse double")


def ridge_predict_quality(spark, sf_dir):
    rows = _ridge_rows(spark, sf_dir)
    m = model.fit(rows, "file", ["x"], lam=1.0, public=str)
    units = _table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("x"))
    return model.predict(m, units, column=str).select("doc_id", _r("score", "score"), "unavailable")


_FIT = """fit AS (SELECT count(*) AS n, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, sum((x - mx0) / sx0 * (y - my0)) / (sum(((x - mx0) / sx0) * ((x - mx0) / sx0)) + 1) AS b
 FROM xy, (SELECT avg(x) AS mx0, stddev_pop(x) AS sx0, avg(y) AS my0 FROM xy))"""
_XY = "xy AS (SELECT doc_id, n_chars::DOUBLE AS x, quality::DOUBLE AS y FROM documents JOIN labels USING (doc_id))"
RIDGE_SQL = f"""WITH {_XY}, {_FIT},
out AS (SELECT f, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my FROM xy, range(5) t(f) WHERE doc_id % 5 <> f GROUP BY f),
cf AS (SELECT f, mx, sx, my, sum((x - mx) / sx * (y - my)) / (sum(((x - mx) / sx) * ((x - mx) / sx)) + 1) AS b FROM xy JOIN out ON doc_id % 5 <> f GROUP BY f, mx, sx, my),
cv AS (SELECT sqrt(sum((y - (my + b * (x - mx) / sx)) ** 2) / count(*)) AS e FROM xy JOIN cf ON doc_id % 5 = f)
SELECT n, round(mx, 6) AS mean, round(sx, 6) AS sd, round(b, 6) AS coefficient, round(my, 6) AS intercept,
 round((SELECT 1 - sum((y - (my + b * (x - mx) / sx)) ** 2) / sum((y - my) ** 2) FROM xy, fit), 6) AS r_squared, round((SELECT e FROM cv), 6) AS cv_rmse FROM fit"""
RIDGE_PREDICT_SQL = f"""WITH {_XY}, {_FIT}
SELECT doc_id, round(my + (n_chars - mx) / sx * b, 6) AS score, CASE WHEN n_chars IS NULL THEN 'x is null' END AS unavailable FROM documents, fit"""


QUERIES = {
    f.__name__: f
    for f in (
        size_loc_by_doc, size_line_classes_by_doc, size_project_totals, size_comment_ratio_project, size_token_count_by_doc, halstead_by_doc, halstead_by_source, halstead_project, derived_mi_by_doc,
        derived_tokens_per_loc, dup_by_doc, dup_project, result_long, js_metrics, js_status, nodes_branch_counts, nodes_by_file, fan_out_orders, fan_in_parts, call_depth_regions,
        stats_summary_lineitem, stats_by_language_docs, stats_summary_missing, stats_correlations_lineitem, stats_correlations_orders, stats_corr_zero_variance, stats_rank_ties,
        hist_extendedprice, medians_pivot, ridge_fit_quality, ridge_predict_quality,
    )
} | code_queries.QUERIES

_LOC_SQL = "CAST(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN text[-1:] = chr(10) THEN 1 ELSE 0 END END AS BIGINT)"
_COUNT_SQL = f"CAST(len(regexp_extract_all(text, '{PATTERN}')) AS BIGINT)"

ORACLE = {
    "size_loc_by_doc": f"SELECT doc_id, {_LOC_SQL} AS loc FROM documents",
    "size_line_classes_by_doc": f"WITH {_LINES_SQL} SELECT doc_id, loc, sloc, blank_loc FROM al",
    "size_project_totals": f"WITH {_LINES_SQL} SELECT CAST(sum(loc) AS BIGINT) AS loc, CAST(sum(sloc) AS BIGINT) AS sloc, CAST(sum(blank_loc) AS BIGINT) AS blank_loc, count(*) AS files FROM al",
    "size_comment_ratio_project": f"WITH {_LINES_SQL} SELECT source, round(sum(blank_loc)::DOUBLE / nullif(sum(loc), 0), 6) AS ratio FROM al GROUP BY source",
    "size_token_count_by_doc": f"SELECT doc_id, {_COUNT_SQL} AS token_count FROM documents",
    "halstead_by_doc": _halstead_sql("doc_id,", "GROUP BY doc_id"),
    "halstead_by_source": _halstead_sql("source,", "GROUP BY source"),
    "halstead_project": _halstead_sql("", ""),
    "derived_mi_by_doc": f"""WITH {_LINES_SQL}, h AS ({_halstead_sql('doc_id,', 'GROUP BY doc_id')})
SELECT doc_id, CASE WHEN volume > 0 AND sloc > 0 THEN round(171 - 5.2::DOUBLE * ln(volume) - 0.23::DOUBLE - 16.2::DOUBLE * ln(sloc::DOUBLE), 6) END AS maintainability FROM al LEFT JOIN h USING (doc_id)""",
    "derived_tokens_per_loc": f"SELECT doc_id, round({_COUNT_SQL}::DOUBLE / nullif({_LOC_SQL}, 0), 6) AS tokens_per_loc FROM documents",
    "dup_by_doc": _dup_sql("doc_id"),
    "dup_project": _dup_sql("source"),
    "result_long": f"""WITH h AS ({_halstead_sql('source,', 'GROUP BY source')}), r AS (SELECT source, 'halstead.length' AS metric, length::DOUBLE AS value FROM h UNION ALL SELECT source, 'halstead.volume', volume FROM h UNION ALL SELECT source, 'halstead.difficulty', difficulty FROM h)
SELECT source, metric, value, CASE WHEN value IS NULL THEN 'not_applicable' END AS reason FROM r""",
    "js_metrics": JS_SQL,
    "js_status": "SELECT 'javascript' AS language, 'ok' AS status, count(*) AS n FROM pages",
    "nodes_branch_counts": NODES_COUNT_SQL,
    "nodes_by_file": f"WITH {NODES_SQL} SELECT path, count(*) FILTER (kind IN ('branch','loop','case','catch','logical','conditional')) AS decisions, count(*) FILTER (kind = 'import') AS imports, count(*) FILTER (kind IN ('statement','declaration','branch','loop','return','jump')) AS statements FROM nodes GROUP BY path",
    "fan_out_orders": "SELECT l_orderkey, count(DISTINCT l_partkey) AS fan_out FROM lineitem GROUP BY l_orderkey",
    "fan_in_parts": "SELECT p_partkey, coalesce(n, 0) AS fan_in FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey",
    "call_depth_regions": CALL_DEPTH_SQL,
    "stats_summary_lineitem": _summary_sql("lineitem", _MEASURES),
    "stats_by_language_docs": _summary_sql("documents", ["n_chars"], "lang"),
    "stats_summary_missing": _summary_sql("(SELECT * FROM documents LEFT JOIN labels USING (doc_id))", ["quality", "toxic"]),
    "stats_correlations_lineitem": _correlation_sql("lineitem", [*_MEASURES, "l_tax"]),
    "stats_correlations_orders": _correlation_sql("orders", ["o_totalprice", "o_custkey"]),
    "stats_corr_zero_variance": "SELECT count(*) AS n, CAST(NULL AS DOUBLE) AS pearson FROM lineitem",
    "stats_rank_ties": "SELECT p_partkey, round(rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE, 6) AS rank FROM part",
    "hist_extendedprice": """WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, (max(l_extendedprice) - min(l_extendedprice)) / 20 AS w FROM lineitem),
c AS (SELECT CAST(least(floor((l_extendedprice - lo) / w), 19) AS BIGINT) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1)
SELECT r.bin, round(lo + r.bin * w, 6) AS lo, round(CASE WHEN r.bin = 19 THEN hi ELSE lo + (r.bin + 1) * w END, 6) AS hi, coalesce(n, 0) AS n FROM (SELECT unnest(range(20)) AS bin) r CROSS JOIN b LEFT JOIN c USING (bin)""",
    "medians_pivot": "SELECT 'n_chars' AS metric, " + ", ".join(f"round(quantile_cont(CASE WHEN lang = '{x}' THEN n_chars::DOUBLE END, 0.5), 6) AS {x}" for x in ("de", "en", "es", "fr")) + " FROM documents",
    "ridge_fit_quality": RIDGE_SQL,
    "ridge_predict_quality": RIDGE_PREDICT_SQL,
} | code_queries.ORACLE
