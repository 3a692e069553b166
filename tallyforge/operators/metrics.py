"""The metrics, as DataFrame queries over facts.

Each family gives wide tables by scope: F (project, path, fn_id), L (project, path), P (project). Families that read the
same facts share one aggregation for each scope. A file's facts come from one task, so the map side combines them to a row
a file or function before any shuffle. Columns are named as registry.column() names them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import registry
from ..functions.columns import DECISIONS, EXPRESSIONS, NESTING, STATEMENTS, cognitive_increment, count_texts, halstead, is_kind, is_operand, is_operator, maintainability, n_if, ratio
from . import duplication
from .parse import Facts

PROJECT, FILE, FUNCTION = ["project"], ["project", "path"], ["project", "path", "fn_id"]


def _node_aggregates() -> list[Column]:
    depth = F.when(is_kind(*NESTING) & ~F.col("is_continuation"), F.col("level") + 1)
    return [
        n_if(is_kind(*DECISIONS)).alias("decisions"),
        n_if(is_kind("branch", "case")).alias("complexity_branch_count"),
        n_if(is_kind("conditional")).alias("complexity_conditional_count"),
        n_if(is_kind("loop")).alias("complexity_loop_count"),
        n_if(is_kind("return")).alias("complexity_return_count"),
        n_if(is_kind("jump")).alias("complexity_jump_count"),
        F.coalesce(F.max(depth), F.lit(0)).cast("double").alias("nesting_max_depth"),
        F.coalesce(F.sum(F.when(is_kind(*STATEMENTS), F.col("level"))), F.lit(0)).cast("double").alias("level_sum"),
        n_if(is_kind(*STATEMENTS)).alias("own_statements"),
        n_if(is_kind(*EXPRESSIONS)).alias("function_expression_count"),
        n_if(is_kind("call")).alias("function_call_count"),
        n_if(is_kind("import")).alias("dependency_dependency_count"),
        F.coalesce(F.sum("cog"), F.lit(0)).cast("double").alias("complexity_cognitive"),
    ]


def _with_cognitive(f: Facts) -> DataFrame:
    nodes = f.nodes
    if "owner_name" not in nodes.columns:
        names = f.functions.select(*FILE, F.col("fn_id").alias("owner_fn"), F.col("name").alias("owner_name"))
        nodes = nodes.join(names, [*FILE, "owner_fn"], "left")
    return nodes.withColumn("cog", F.when(F.col("owner_fn").isNotNull(), cognitive_increment(F.col("owner_name"))))


def nodes_by_function(f: Facts) -> DataFrame:
    """Counts of a function's own nodes, nested functions left out."""
    own = _with_cognitive(f).filter("owner_fn IS NOT NULL").withColumnRenamed("owner_fn", "fn_id")
    return own.groupBy(*FUNCTION).agg(*_node_aggregates()).drop("dependency_dependency_count")


def statements_by_function(f: Facts) -> DataFrame:
    """Statements of a function with those of nested functions."""
    rows = f.nodes.filter(is_kind(*STATEMENTS)).select(*FILE, F.explode("enclosing_fns").alias("fn_id"))
    return rows.groupBy(*FUNCTION).agg(F.count(F.lit(1)).cast("double").alias("size_statement_count"))


def nodes_by_file(f: Facts) -> DataFrame:
    return _with_cognitive(f).groupBy(*FILE).agg(*_node_aggregates()).withColumn("size_statement_count", F.col("own_statements"))


def token_texts(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """keys, role, text, n: how often each text occurs in a role."""
    role = F.when(is_operator(), "operator").when(is_operand(), "operand").alias("role")
    return tokens.filter("kind <> 'comment'").groupBy(*keys, role, "text").agg(F.count(F.lit(1)).alias("n"))


def _tokens(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """token_count and the counts behind Halstead, by keys. Texts are counted first, so distinct ones need no second shuffle of tokens."""
    return token_texts(tokens, keys).groupBy(*keys).agg(
        F.sum("n").cast("double").alias("size_token_count"),
        n_if(F.col("role") == "operator").alias("n1"),
        n_if(F.col("role") == "operand").alias("n2"),
        F.coalesce(F.sum(F.when(F.col("role") == "operator", F.col("n"))), F.lit(0)).cast("double").alias("t1"),
        F.coalesce(F.sum(F.when(F.col("role") == "operand", F.col("n"))), F.lit(0)).cast("double").alias("t2"),
    )


def tokens_by_function(f: Facts) -> DataFrame:
    return _tokens(f.tokens.select(*FILE, F.explode("enclosing_fns").alias("fn_id"), "kind", "text"), FUNCTION)


def tokens_by_file(f: Facts) -> DataFrame:
    if f.arrays is None:
        return _tokens(f.tokens, FILE)
    own = f.arrays.filter(F.size("tokens") > 0)
    return count_texts(own, FILE, F.col("tokens"), lambda x: is_operator(x["kind"], x["text"]), lambda x: is_operand(x["kind"]), lambda x: x["text"])


def tokens_by_project(f: Facts) -> DataFrame:
    return _tokens(f.tokens, PROJECT)


def line_rows(f: Facts) -> DataFrame:
    """A row for each line of a file (and each line a token claims): what it holds."""
    if f.lines is not None:
        return f.lines
    lines = F.split(F.regexp_replace("content", r"\n\z", ""), "\n")
    spine = f.files.filter("content <> ''").select(*FILE, F.posexplode(lines).alias("pos", "text"))
    spine = spine.select(*FILE, (F.col("pos") + 1).alias("line"), F.lit(1).alias("there"), (F.regexp_replace("text", r"(?U)\s", "") != "").cast("int").alias("solid"), F.lit(0).alias("code"), F.lit(0).alias("token"))
    used = f.tokens.select(*FILE, F.explode(F.sequence("first_line", "last_line")).alias("line"), (F.col("kind") != "comment").cast("int").alias("code"))
    used = used.select(*FILE, "line", F.lit(0).alias("there"), F.lit(0).alias("solid"), "code", F.lit(1).alias("token"))
    return spine.unionByName(used).groupBy(*FILE, "line").agg(*[F.max(c).alias(c) for c in ("there", "solid", "code", "token")])


def lines_by_file(f: Facts) -> DataFrame:
    bad = ((F.col("solid") == 1) & (F.col("token") == 0)) | ((F.col("there") == 0) & (F.col("token") == 1))
    out = line_rows(f).groupBy(*FILE).agg(
        F.sum("there").cast("double").alias("size_loc"),
        F.sum("code").cast("double").alias("size_sloc"),
        n_if((F.col("token") == 1) & (F.col("code") == 0)).alias("size_comment_loc"),
        n_if((F.col("there") == 1) & (F.col("token") == 0) & (F.col("solid") == 0)).alias("size_blank_loc"),
        F.min(F.when(bad, F.col("line"))).alias("bad_line"),
    )
    message = F.concat(F.col("path"), F.lit(": line "), F.col("bad_line").cast("string"), F.lit(" has text that no token covers"))
    return out.withColumn("line_error", F.when(F.col("bad_line").isNotNull(), message)).drop("bad_line")


def lines_by_function(f: Facts) -> DataFrame:
    """Code lines within a function's lines; its lines meet the file's by an equality join, not by ranges."""
    code = line_rows(f).filter("code = 1").select(*FILE, "line")
    own = f.functions.select(*FUNCTION, F.explode(F.sequence("first_line", "last_line")).alias("line"))
    return own.join(code, [*FILE, "line"]).groupBy(*FUNCTION).agg(F.count(F.lit(1)).cast("double").alias("size_sloc"))


def function_rows(f: Facts) -> DataFrame:
    finite = (F.abs("path_count") < float("inf")) & ~F.isnan("path_count")
    return f.functions.select(
        *FUNCTION, "name", "first_line", "last_line",
        (F.col("last_line") - F.col("first_line") + 1).cast("double").alias("size_function_length"),
        F.size("params").cast("double").alias("function_parameter_count"),
        F.col("doc_lines").cast("double").alias("documentation_doc_loc"),
        F.when(finite, F.col("path_count")).alias("complexity_path_count"),
        F.when(~finite, F.lit("value inf is not finite")).alias("path_error"),
    )


def _function_aggregates() -> list[Column]:
    length = F.col("last_line") - F.col("first_line") + 1
    return [
        F.count(F.lit(1)).cast("double").alias("size_function_count"),
        F.sum(length).cast("double").alias("length_sum"), F.max(length).cast("double").alias("size_max_function_length"),
        F.sum(F.size("params")).cast("double").alias("params_sum"), F.max(F.size("params")).cast("double").alias("function_max_parameter_count"),
        n_if(F.col("doc_lines") > 0).alias("documentation_documented_function_count"),
    ]


def functions_by(f: Facts, keys: list[str]) -> DataFrame:
    return f.functions.groupBy(*keys).agg(*_function_aggregates())


def calls(f: Facts) -> DataFrame:
    """Distinct (function, name it calls); calls inside nested functions belong to those."""
    rows = f.nodes.filter(is_kind("call") & F.col("label").isNotNull() & F.col("owner_fn").isNotNull())
    return rows.select(*FILE, F.col("owner_fn").alias("fn_id"), "label").distinct()


def longest_paths(edges: list[tuple[str, str]], names: list[str]) -> dict[str, int]:
    """For each name the longest path of edges in the graph whose cycles are drawn together. Iterative: chains are long."""
    out: dict[str, list[str]] = {n: [] for n in names}
    for a, b in edges:
        out[a].append(b)
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    on: set[str] = set()
    stack: list[str] = []
    depth: dict[str, int] = {}
    for root in out:
        if root in index:
            continue
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        work = [(root, iter(out[root]))]
        while work:
            v, rest = work[-1]
            w = next(rest, None)
            if w is not None:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out[w])))
                elif w in on:
                    low[v] = min(low[v], index[w])
                continue
            work.pop()
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[v])
            if low[v] == index[v]:  # a component is complete; those it reaches are too
                members = []
                while True:
                    w = stack.pop()
                    on.discard(w)
                    members.append(w)
                    if w == v:
                        break
                own = set(members)
                d = max((depth[x] + 1 for m in members for x in out[m] if x not in own), default=0)
                depth.update(dict.fromkeys(members, d))
    return depth


def name_depths(edges: DataFrame, names: DataFrame) -> DataFrame:
    """project, name, depth. edges: project, caller, callee; names: project, name. A project's names are one group."""
    rows = edges.select("project", F.col("caller").alias("a"), F.col("callee").alias("b")).distinct()
    rows = rows.unionByName(names.select("project", F.col("name").alias("a"), F.lit(None).cast("string").alias("b")).distinct())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known = dict.fromkeys(pdf["a"])
        pairs = [(a, b) for a, b in zip(pdf["a"], pdf["b"], strict=True) if isinstance(b, str)]
        depth = longest_paths(pairs, [*known, *dict.fromkeys(b for _, b in pairs)])
        return pd.DataFrame({"project": pdf["project"].iloc[0], "name": list(depth), "depth": list(depth.values())})

    return rows.groupBy("project").applyInPandas(run, "project string, name string, depth long")


def fan_out(called: DataFrame) -> DataFrame:
    """How many names each function calls. called: as calls() gives it."""
    return called.groupBy(*FUNCTION).agg(F.count(F.lit(1)).cast("double").alias("dependency_fan_out"))


def fan_in(called: DataFrame, names: DataFrame) -> DataFrame:
    """How many functions call each of the names (project, name), which 0 do not show."""
    inside = called.join(names.withColumnRenamed("name", "label"), ["project", "label"], "left_semi")
    return inside.groupBy("project", F.col("label").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("dependency_fan_in"))


def dependency_by_function(f: Facts) -> DataFrame:
    called = calls(f)
    names = f.functions.filter("name IS NOT NULL").select("project", "name").distinct()
    inside = called.join(names.withColumnRenamed("name", "label"), ["project", "label"], "left_semi")
    fns = f.functions.select(*FUNCTION, "name")
    callers = inside.join(fns, FUNCTION)
    edges = callers.filter("name IS NOT NULL").select("project", F.col("name").alias("caller"), F.col("label").alias("callee"))
    depths = name_depths(edges, names)
    anonymous = callers.filter("name IS NULL").select(*FUNCTION, "label").join(depths.withColumnRenamed("name", "label"), ["project", "label"])
    anonymous = anonymous.groupBy(*FUNCTION).agg((F.max("depth") + 1).alias("own_depth"))
    out = fns.join(fan_out(called), FUNCTION, "left").join(fan_in(called, names), ["project", "name"], "left").join(depths, ["project", "name"], "left").join(anonymous, FUNCTION, "left")
    zero = F.lit(0.0)
    return out.select(*FUNCTION, F.coalesce("dependency_fan_out", zero).alias("dependency_fan_out"), F.coalesce("dependency_fan_in", zero).alias("dependency_fan_in"), F.coalesce("depth", "own_depth", F.lit(0)).cast("double").alias("dependency_call_depth"))


# -- putting scopes together


def _zero(df: DataFrame, *columns: str) -> DataFrame:
    return df.fillna(0.0, list(columns))


NODE_COUNTS = ["decisions", "complexity_branch_count", "complexity_conditional_count", "complexity_loop_count", "complexity_return_count", "complexity_jump_count", "nesting_max_depth", "level_sum", "own_statements", "function_expression_count", "function_call_count", "complexity_cognitive"]
TOKEN_COUNTS = ["size_token_count", "n1", "n2", "t1", "t2"]
LINE_COUNTS = ["size_loc", "size_sloc", "size_comment_loc", "size_blank_loc"]
FUNCTION_SUMS = ["size_function_count", "length_sum", "params_sum", "documentation_documented_function_count"]
DUPLICATES = ["duplication_duplicate_block_count", "duplication_duplicate_token_count", "duplication_max_duplicate_length"]
#: Metrics that the line rule turns into errors.
LINE_METRICS = ["size_loc", "size_sloc", "size_comment_loc", "size_blank_loc", "size_comment_ratio"]


def _halstead(df: DataFrame) -> DataFrame:
    return df.withColumns(halstead(F.col("n1"), F.col("n2"), F.col("t1"), F.col("t2"))).drop("n1", "n2", "t1", "t2")


def by_function(f: Facts) -> DataFrame:
    """Every F metric of every function, with its name, lines and errors."""
    out = function_rows(f)
    for part in (nodes_by_function(f), statements_by_function(f), tokens_by_function(f), lines_by_function(f), dependency_by_function(f)):
        out = out.join(part, FUNCTION, "left")
    errors = lines_by_file(f).select(*FILE, "line_error")
    out = _zero(out, *NODE_COUNTS, "size_statement_count", "size_sloc", *TOKEN_COUNTS).join(errors, FILE, "left")
    out = _halstead(out.withColumn("complexity_cyclomatic", F.col("decisions") + 1).withColumn("nesting_avg_depth", ratio("level_sum", "own_statements")))
    out = out.withColumn("size_sloc", F.when(F.col("line_error").isNull(), F.col("size_sloc")))
    out = out.withColumn("maintainability_index", maintainability(F.col("halstead_volume"), F.col("complexity_cyclomatic"), F.col("size_sloc")))
    return out.select(*FUNCTION, "name", "first_line", "last_line", "line_error", "path_error", *[registry.column(m) for m in registry.ids("F")])


def _ratios(df: DataFrame) -> DataFrame:
    """The ratios of file and project scope, from their sums."""
    df = _halstead(df)
    df = df.withColumns({
        "complexity_cyclomatic": F.col("size_function_count") + F.col("decisions"),
        "nesting_avg_depth": ratio("level_sum", "own_statements"),
        "size_avg_function_length": ratio("length_sum", "size_function_count"),
        "function_avg_parameter_count": ratio("params_sum", "size_function_count"),
        "documentation_documentation_ratio": F.try_divide("documentation_documented_function_count", "size_function_count"),
        "duplication_duplication_ratio": F.try_divide("duplication_duplicate_token_count", "size_token_count"),
        "size_comment_ratio": F.try_divide("size_comment_loc", "size_loc"),
    })
    df = df.withColumns({c: F.when(F.col("line_error").isNull(), F.col(c)) for c in LINE_METRICS})
    return df.withColumns({
        "derived_cyclomatic_per_function": F.try_divide("complexity_cyclomatic", "size_function_count"),
        "derived_tokens_per_loc": F.try_divide("size_token_count", "size_loc"),
        "derived_statements_per_function": F.try_divide("size_statement_count", "size_function_count"),
        "derived_duplicate_tokens_per_sloc": F.try_divide("duplication_duplicate_token_count", "size_sloc"),
    })


def file_sums(f: Facts) -> DataFrame:
    """A row for each file: what files and projects are computed from."""
    if f.sums is not None:
        return f.sums
    out = f.files.select(*FILE, "language")
    for part in (lines_by_file(f), nodes_by_file(f), tokens_by_file(f), functions_by(f, FILE)):
        out = out.join(part, FILE, "left")
    return _zero(out, *LINE_COUNTS, *NODE_COUNTS, *TOKEN_COUNTS, *FUNCTION_SUMS, "size_statement_count", "dependency_dependency_count")


def by_file(f: Facts) -> DataFrame:
    """Every L metric of every file, with its language and error."""
    out = _zero(file_sums(f).join(duplication.by_file(f.coded()), FILE, "left"), *DUPLICATES)
    out = _ratios(out)
    out = out.withColumn("maintainability_index", maintainability(F.col("halstead_volume"), F.col("complexity_cyclomatic"), F.col("size_sloc")))
    return out.select(*FILE, "language", "line_error", *[registry.column(m) for m in registry.ids("L")])


def by_project(f: Facts, projects: DataFrame | None = None) -> DataFrame:
    """Every P metric of every project. projects: names that shall have a row even without any file."""
    sums = ["size_loc", "size_sloc", "size_comment_loc", "size_blank_loc", "size_statement_count", "size_function_count", "length_sum", "params_sum", "documentation_documented_function_count", "dependency_dependency_count"] + [c for c in NODE_COUNTS if c != "nesting_max_depth"]
    most = ["nesting_max_depth", "size_max_function_length", "function_max_parameter_count"]
    files = file_sums(f)
    totals = files.groupBy("project").agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in most], F.min_by("line_error", F.when(F.col("line_error").isNotNull(), F.col("path"))).alias("line_error"))
    out = projects.select("project").distinct().join(totals, "project", "left") if projects is not None else totals
    out = out.join(tokens_by_project(f), "project", "left").join(duplication.by_project(f.coded()), "project", "left")
    out = _ratios(_zero(out, *sums, "nesting_max_depth", *TOKEN_COUNTS, *DUPLICATES))
    return out.select("project", "line_error", *[registry.column(m) for m in registry.ids("P")])


def to_long(wide: DataFrame, scope: str, keys: list[str]) -> DataFrame:
    """keys, metric, value, reason: a row for each metric of the scope, null values with the reason."""
    error = F.col("line_error") if "line_error" in wide.columns else F.lit(None).cast("string")
    path_error = F.col("path_error") if "path_error" in wide.columns else F.lit(None).cast("string")
    sloc = {"maintainability.index": "size.sloc", "derived.duplicate_tokens_per_sloc": "size.sloc", "derived.tokens_per_loc": "size.loc"}

    def reason(m: str) -> Column:
        c = F.col(registry.column(m))
        missing = F.lit("not_applicable")
        if registry.column(m) in LINE_METRICS:
            missing = F.coalesce(F.concat(F.lit("error: "), error), missing)
        elif m in sloc:
            missing = F.coalesce(F.concat(F.lit(f"error: {sloc[m]}: "), error), missing)
        elif m == "complexity.path_count":
            missing = F.coalesce(F.concat(F.lit("error: "), path_error), missing)
        return F.when(c.isNull(), missing)

    cells = [F.struct(F.lit(m).alias("metric"), F.col(registry.column(m)).cast("double").alias("value"), reason(m).alias("reason")) for m in registry.ids(scope)]
    return wide.select(*keys, F.explode(F.array(*cells)).alias("m")).select(*keys, "m.*")
