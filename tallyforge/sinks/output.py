"""JSON and CSV of a result of one project. The driver holds one project's rows; many projects are written by Spark."""

from __future__ import annotations

import json
import math
from decimal import Decimal

from pyspark.sql import DataFrame

from .. import registry
from ..plans.analyze import Result


def cells(row: dict, scope: str) -> tuple[dict, dict]:
    """(value of each metric, reason of each that has none), sorted by id."""
    values, reasons = {}, {}
    error, path_error = row.get("line_error"), row.get("path_error")
    through = {"maintainability.index": "size.sloc", "derived.duplicate_tokens_per_sloc": "size.sloc", "derived.tokens_per_loc": "size.loc"}
    for m in sorted(registry.ids(scope)):
        v = row[registry.column(m)]
        values[m] = v if v is not None and math.isfinite(v) else None
        if values[m] is None:
            reasons[m] = "not_applicable"
            if error and m in ("size.loc", "size.sloc", "size.comment_loc", "size.blank_loc", "size.comment_ratio"):
                reasons[m] = f"error: {error}"
            elif error and m in through:
                reasons[m] = f"error: {through[m]}: {error}"
            elif path_error and m == "complexity.path_count":
                reasons[m] = f"error: {path_error}"
    return values, reasons


def to_dict(result: Result) -> dict:
    """The result as nested dictionaries: run, project, files with their functions, ordered by path."""
    functions: dict[str, list] = {}
    for r in sorted((r.asDict() for r in result.functions.collect()), key=lambda r: (r["path"].encode(), r["fn_id"])):
        values, reasons = cells(r, "F")
        functions.setdefault(r["path"], []).append({"name": r["name"], "start_line": r["first_line"], "end_line": r["last_line"], "metrics": values, "unavailable": reasons})
    own = {r.path: r.asDict() for r in result.files.collect()}
    files = []
    for p in sorted(result.parsed.collect(), key=lambda r: r.path.encode()):
        if p.status == "error":
            files.append({"status": "error", "path": p.path, "language": p.language, "error": p.error})
        else:
            values, reasons = cells(own[p.path], "L")
            files.append({"status": "ok", "path": p.path, "language": p.language, "metrics": values, "unavailable": reasons, "functions": functions.get(p.path, [])})
    project = result.projects.first()
    values, reasons = cells(project.asDict(), "P")
    return {"run": result.info, "project": {"metrics": values, "unavailable": reasons}, "files": files}


def to_json(result: Result | dict) -> str:
    return json.dumps(result if isinstance(result, dict) else to_dict(result), indent=2, ensure_ascii=False) + "\n"


def number(v: float | None) -> str:
    """The shortest decimal that reads back as v, without an exponent or a trailing .0; nothing for null."""
    return "" if v is None else format(Decimal(repr(float(v))), "f").removesuffix(".0")


def quoted(s: str | None) -> str:
    s = s or ""
    return '"' + s.replace('"', '""') + '"' if any(c in s for c in ',"\n\r') else s


HEADER = ["scope", "path", "language", "function", "start_line", "end_line", "status", "error"]


def to_csv(result: Result | dict) -> str:
    """A line for the project, then for each file and its functions; every metric has a column."""
    made = result if isinstance(result, dict) else to_dict(result)
    lines = [",".join(HEADER + registry.IDS)]

    def line(fixed: list, values: dict) -> None:
        lines.append(",".join([quoted(str(x) if x is not None else "") for x in fixed] + [number(values.get(m)) for m in registry.IDS]))

    line(["project", "", "", "", "", "", "", ""], made["project"]["metrics"])
    for f in made["files"]:
        if f["status"] == "error":
            line(["file", f["path"], f.get("language"), "", "", "", "error", f["error"]], {})
            continue
        line(["file", f["path"], f["language"], "", "", "", "ok", ""], f["metrics"])
        for g in f["functions"]:
            line(["function", f["path"], f["language"], g["name"], g["start_line"], g["end_line"], "ok", ""], g["metrics"])
    return "\n".join(lines) + "\n"


def write_long(result: Result, path: str, form: str = "parquet") -> None:
    """The long table of any number of projects, written by the executors."""
    writer = result.long().write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else getattr(writer, form)(path)


def units(spark, results: list[dict], scope: str) -> DataFrame:
    """Results as read from JSON: result_no, path, language, [function, start_line,] and a column for each metric."""
    rows = []
    ids = registry.ids("F" if scope == "function" else "L")
    for k, made in enumerate(results):
        for f in made["files"]:
            if f["status"] != "ok":
                continue
            for u in f["functions"] if scope == "function" else [f]:
                rows.append((k, f["path"], f["language"], u.get("name") if scope == "function" else None, u.get("start_line") if scope == "function" else None, *[None if u["metrics"].get(m) is None else float(u["metrics"][m]) for m in ids]))
    columns = ", ".join(f"`{registry.column(m)}` double" for m in ids)
    return spark.createDataFrame(rows, f"result_no int, path string, language string, function string, start_line int, {columns}")


def read_results(paths: list[str]) -> list[dict]:
    out = []
    for p in paths:
        with open(p, encoding="utf-8") as f:
            made = json.load(f)
        if not {"run", "project", "files"} <= set(made):
            raise ValueError(f"{p}: not a result; give the JSON that `analyze` writes")
        out.append(made)
    return out
