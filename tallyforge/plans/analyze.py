"""From sources to a result: the flagship plan."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__, registry
from ..frontend import PARSERS
from ..operators import metrics
from ..operators.parse import Facts, facts, parse, with_language
from ..sources import files as sources

#: Fixed value: the version of the metric definitions.
DEFINITIONS = "1"
LONG = ["project", "scope", "path", "language", "fn_id", "function", "start_line", "end_line", "status", "error", "metric", "value", "reason"]


@dataclass
class Result:
    """DataFrames of a result, by scope; info has what describes the run."""

    parsed: DataFrame  # project, path, language, status, error of every file
    functions: DataFrame
    files: DataFrame
    projects: DataFrame
    info: dict = field(default_factory=dict)
    kept: list[DataFrame] = field(default_factory=list)  # what the session's storage holds for it

    def __enter__(self) -> Result:
        return self

    def __exit__(self, *_) -> None:
        self.release()

    def release(self) -> None:
        """Frees the session's storage; the tables can still be read, from the sources again."""
        while self.kept:
            self.kept.pop().unpersist()

    def long(self) -> DataFrame:
        """One row for each scope, unit and metric, and one for each failed file."""
        null = lambda t: F.lit(None).cast(t)
        fn = metrics.to_long(self.functions.join(self.files.select("project", "path", "language"), ["project", "path"]), "F", ["project", "path", "language", "fn_id", "name", "first_line", "last_line"])
        fn = fn.select("project", F.lit("function").alias("scope"), "path", "language", "fn_id", F.col("name").alias("function"), F.col("first_line").alias("start_line"), F.col("last_line").alias("end_line"), F.lit("ok").alias("status"), null("string").alias("error"), "metric", "value", "reason")

        def plain(df: DataFrame, scope: str, path, language) -> DataFrame:
            return df.select("project", F.lit(scope).alias("scope"), path.alias("path"), language.alias("language"), null("int").alias("fn_id"), null("string").alias("function"), null("int").alias("start_line"), null("int").alias("end_line"), F.lit("ok").alias("status"), null("string").alias("error"), "metric", "value", "reason")

        file = plain(metrics.to_long(self.files, "L", ["project", "path", "language"]), "file", F.col("path"), F.col("language"))
        project = plain(metrics.to_long(self.projects, "P", ["project"]), "project", null("string"), null("string"))
        failed = self.parsed.filter("status = 'error'").select("project", F.lit("file").alias("scope"), "path", "language", null("int").alias("fn_id"), null("string").alias("function"), null("int").alias("start_line"), null("int").alias("end_line"), "status", "error", null("string").alias("metric"), null("double").alias("value"), null("string").alias("reason"))
        return fn.unionByName(file).unionByName(project).unionByName(failed)

    def views(self, prefix: str = "code") -> None:
        """Registers the tables as temporary views for SQL."""
        self.functions.createOrReplaceTempView(f"{prefix}_functions")
        self.files.createOrReplaceTempView(f"{prefix}_files")
        self.projects.createOrReplaceTempView(f"{prefix}_projects")


def from_facts(f: Facts, parsed: DataFrame, projects: DataFrame | None = None, info: dict | None = None, keep: bool = True, kept: list[DataFrame] | None = None) -> Result:
    """kept: what the result shall release. keep: what several scopes read (lines and the sums of files) is kept in the session's storage."""
    if keep:
        f.lines = metrics.line_rows(f).persist()
        f.sums = metrics.file_sums(f).persist()
    own = [x for x in (*(kept or []), f.lines, f.sums) if x is not None]
    return Result(parsed.select("project", "path", "language", "status", "error"), metrics.by_function(f), metrics.by_file(f), metrics.by_project(f, projects), info or {}, own)


def analyze_table(table: DataFrame, store: str | None = None) -> Result:
    """Any table of (project, path, content). store: a folder for the parsed files, read again by all that follows;
    without it they are kept in the session's storage, on disk where memory is short."""
    parsed = parse(table if "language" in table.columns else with_language(table))
    if store:
        parsed.write.mode("overwrite").partitionBy("language").parquet(store)
        parsed = table.sparkSession.read.parquet(store)
    else:
        parsed = parsed.persist()
    return from_facts(facts(parsed), parsed, table, keep=store is None, kept=[] if store else [parsed])


def analyze(spark: SparkSession, path: str, project: str | None = None) -> Result:
    """A folder or a file."""
    name = project or sources.default_project_name(path)
    table = sources.from_path(spark, path, name)
    parsed = parse(with_language(table)).persist()
    repository, commit = sources.git_info(path)
    info = run_info(parsed, name, repository, commit)
    return from_facts(facts(parsed), parsed, spark.createDataFrame([(name,)], "project string"), info, kept=[parsed])


def run_info(parsed: DataFrame, project: str, repository: str | None = None, commit: str | None = None) -> dict:
    used = sorted(r[0] for r in parsed.filter("status = 'ok'").select("language").distinct().collect())  # as many as languages
    now = datetime.datetime.now(datetime.timezone.utc).replace(microsecond=0).isoformat().replace("+00:00", "Z")
    return {"project": project, "repository": repository, "commit": commit, "tool_version": __version__, "metric_definition_version": DEFINITIONS, "parsers": {x: PARSERS.get(x, x) for x in used}, "timestamp": now}


def analyze_source(spark: SparkSession, filename: str, source: str) -> Result:
    """One text. Raises ValueError where it can't be parsed."""
    table = sources.from_text(spark, filename, source)
    parsed = parse(with_language(table)).persist()
    failed = parsed.filter("status = 'error'").first()
    if failed:
        parsed.unpersist()
        raise ValueError(failed.error)
    name = table.first().project
    return from_facts(facts(parsed), parsed, table.select("project"), run_info(parsed, name), kept=[parsed])


def metric_columns(scope: str) -> list[str]:
    return [registry.column(m) for m in registry.ids(scope)]
