"""A self-contained HTML report of one result: no script, nothing from outside."""

from __future__ import annotations

from itertools import combinations

from .. import registry
from ..operators import stats
from . import output

BINS = 20
_STYLE = "body{font:14px sans-serif;margin:2em;color:#222}table{border-collapse:collapse;margin:1em 0}td,th{border:1px solid #ccc;padding:2px 8px;text-align:right}th:first-child,td:first-child{text-align:left}svg{background:#fafafa;margin:4px}"


def escape(s: object) -> str:
    return str(s).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def shown(v: float | None) -> str:
    return "null" if v is None else str(int(v)) if v == int(v) else f"{v:.3f}"


def table(head: list[str], rows: list[list]) -> str:
    line = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{escape(c)}</{tag}>" for c in cells) + "</tr>"
    return "<table>" + line("th", head) + "".join(line("td", r) for r in rows) + "</table>"


def bars(metric: str, bins: list) -> str:
    most = max(b["n"] for b in bins)
    w = 240 / len(bins)
    rects = "".join(f'<rect x="{k * w:.1f}" y="{80 - 80 * b["n"] / most:.1f}" width="{w - 1:.1f}" height="{80 * b["n"] / most:.1f}" fill="#4878a8"><title>{shown(b["lo"])}–{shown(b["hi"])}: {b["n"]}</title></rect>' for k, b in enumerate(bins))
    return f'<figure style="display:inline-block;margin:6px"><figcaption>{escape(metric)}</figcaption><svg width="240" height="80">{rects}</svg></figure>'


def distributions(units, columns: dict[str, str]) -> str:
    """A histogram of each metric that has values. columns: metric by column."""
    every: dict[str, list] = {}
    for b in sorted((r.asDict() for r in stats.histograms(units, [*columns], BINS).collect()), key=lambda b: b["bin"]):
        every.setdefault(b["metric"], []).append(b)
    return "".join(bars(m, every[c]) for c, m in columns.items() if c in every)


def heatmap(units, columns: dict[str, str], cell: int = 9) -> str:
    """Rank correlations of each pair of metrics, red where positive, blue where negative."""
    rho = {(r["a"], r["b"]): r["spearman"] for r in stats.correlations(units, [*columns]).collect()}
    rects = []
    for (i, (a, name_a)), (j, (b, name_b)) in combinations(enumerate(columns.items()), 2):
        v = rho[a, b]
        if v is not None:
            shade = int(255 * (1 - abs(v)))
            fill = f"rgb(255,{shade},{shade})" if v > 0 else f"rgb({shade},{shade},255)"
            rects.append(f'<rect x="{j * cell}" y="{i * cell}" width="{cell}" height="{cell}" fill="{fill}"><title>{escape(name_a)} / {escape(name_b)}: {v:.3f}</title></rect>')
    return f'<svg width="{len(columns) * cell}" height="{len(columns) * cell}">{"".join(rects)}</svg>'


def to_html(spark, made: dict) -> str:
    """made: a result as output.to_dict gives it."""
    files, functions = (output.units(spark, [made], scope).persist() for scope in ("file", "function"))
    of_files, of_functions = ({registry.column(m): m for m in registry.ids(s)} for s in "LF")
    languages = sorted({f["language"] for f in made["files"] if f["status"] == "ok"})
    run = [[k, v if not isinstance(v, dict) else ", ".join(f"{a} {b}" for a, b in v.items())] for k, v in made["run"].items()]
    parts = [f"<h1>{escape(made['run'].get('project'))}</h1>", table(["run", "value"], [[k, "null" if v is None else v] for k, v in run])]
    parts.append("<h2>Project</h2>" + table(["metric", "value"], [[m, shown(made["project"]["metrics"].get(m))] for m in registry.ids("P")]))
    if languages:
        med = {r["metric"]: r for r in stats.medians_by_language(files, [*of_files], languages).collect()}
        parts.append("<h2>Medians of files</h2>" + table(["metric", *languages], [[m, *[shown(med[c][x]) for x in languages]] for c, m in of_files.items()]))
        parts.append("<h2>Distributions over functions</h2>" + distributions(functions, of_functions))
        parts.append("<h2>Distributions over files</h2>" + distributions(files, of_files))
        parts.append("<h2>Rank correlations over functions</h2>" + heatmap(functions, of_functions))
    failed = [f for f in made["files"] if f["status"] == "error"]
    if failed:
        parts.append("<h2>Files left out</h2>" + table(["path", "error"], [[f["path"], f["error"]] for f in failed]))
    files.unpersist()
    functions.unpersist()
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{escape(made["run"].get("project"))}</title><style>{_STYLE}</style></head><body>{"".join(parts)}</body></html>\n'
