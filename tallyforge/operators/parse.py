"""Sources to the parsed representation, and that to tables of facts."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schema
from ..frontend import LANGUAGES, ParseError, to_ir
from . import duplication


def with_language(sources: DataFrame) -> DataFrame:
    """sources joined to the languages by extension (a fixed, small table); files of no language go."""
    spark = sources.sparkSession
    table = spark.createDataFrame([(e, n) for n, own, _ in LANGUAGES for e in own], "ext string, language string")
    ext = F.regexp_extract("path", r"(?:^|/)[^/]+\.([^./]+)$", 1)
    return sources.withColumn("ext", ext).join(F.broadcast(table), "ext").drop("ext")


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """An Arrow array. Lists of tuples are turned into a column for each field first, which is several times faster."""
    if not (pa.types.is_list(kind) and pa.types.is_struct(kind.value_type)):
        return pa.array(values, kind)
    ends = [0, *accumulate(len(v) if v else 0 for v in values)]
    offsets = pa.array([None if v is None else at for v, at in zip(values, ends, strict=False)] + ends[-1:], pa.int32())
    fields = list(kind.value_type)
    flat = list(zip(*chain.from_iterable(v for v in values if v), strict=True)) or [()] * len(fields)
    inner = pa.StructArray.from_arrays([_column(list(c), f.type) for c, f in zip(flat, fields, strict=True)], fields=fields)
    return pa.ListArray.from_arrays(offsets, inner, type=kind)


def parse(sources: DataFrame) -> DataFrame:
    """One row for each file of sources (project, path, content, language): schema.PARSED.

    A file that can't be read or parsed is an error row; the others aren't affected.
    """
    types = to_arrow_schema(sources.sparkSession.createDataFrame([], schema.PARSED).schema)

    def run(batches):
        for b in batches:
            columns: list[list] = [[] for _ in types]
            size = 0
            for project, path, content, language in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                row, error = {"nodes": None, "tokens": None, "functions": None}, None
                if content is None:
                    error = f"{path}: can't be read; check that the file exists and may be read"
                else:
                    content = content.encode() if isinstance(content, str) else content
                    try:
                        row = to_ir(language, content)
                    except ParseError as e:
                        error = f"{path}:{e.line}:{e.column}: parse error: {e.message}; fix the syntax or leave the file out"
                text = None if error else content.decode()
                for column, x in zip(columns, (project, path, language, "error" if error else "ok", error, text, row["nodes"], row["tokens"], row["functions"]), strict=True):
                    column.append(x)
                size += len(content or b"")
                if size > 4 << 20:  # bounds what a batch of rows holds
                    yield pa.RecordBatch.from_arrays([_column(c, f.type) for c, f in zip(columns, types, strict=True)], schema=types)
                    columns, size = [[] for _ in types], 0
            yield pa.RecordBatch.from_arrays([_column(c, f.type) for c, f in zip(columns, types, strict=True)], schema=types)

    return sources.select("project", "path", "content", "language").mapInArrow(run, schema.PARSED)


@dataclass
class Facts:
    """What metrics are computed from. Only these tables, so tests can hand over rows made by hand."""

    files: DataFrame  # project, path, language, content
    nodes: DataFrame
    tokens: DataFrame
    functions: DataFrame
    lines: DataFrame | None = None  # what metrics.line_rows() gives, where it is kept
    codes: DataFrame | None = None  # what duplication.codes() gives, where it needs no shuffle
    arrays: DataFrame | None = None  # project, path, tokens: the code tokens of a file as one array, where there are such
    sums: DataFrame | None = None  # what metrics.file_sums() gives, where it is kept

    def coded(self) -> DataFrame:
        return duplication.codes(self.tokens) if self.codes is None else self.codes


def facts(parsed: DataFrame) -> Facts:
    ok = parsed.filter("status = 'ok'")

    def rows(column: str) -> DataFrame:
        return ok.select("project", "path", F.explode(column).alias("x")).select("project", "path", "x.*")

    code = F.filter("tokens", lambda x: x["kind"] != "comment")
    coded = ok.select("project", "path", F.transform(code, lambda x: F.xxhash64(duplication.normalised(x["kind"], x["text"]))).alias("codes"))
    owner = F.element_at("functions", F.col("x.owner_fn") + 1)["name"]  # a function's number is its place
    nodes = ok.select("project", "path", "functions", F.explode("nodes").alias("x")).select("project", "path", "x.*", owner.alias("owner_name"))
    return Facts(ok.select("project", "path", "language", "content"), nodes, rows("tokens"), rows("functions"), codes=coded, arrays=ok.select("project", "path", code.alias("tokens")))
