"""Command line: python -m tallyforge.cli COMMAND ..."""

from __future__ import annotations

import argparse
import sys

from . import registry


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.appName("tallyforge")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if spark.sparkContext.master.startswith("local") and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        spark.conf.set("spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism)  # one machine: as many as it runs at once
    return spark


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyforge", description="Source-code metrics on Spark.")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze", help="measure a folder or a file")
    a.add_argument("path")
    a.add_argument("--project")
    a.add_argument("-o", "--output")
    a.add_argument("--format", choices=["json", "csv"], default="json")
    s = sub.add_parser("stats", help="summaries and correlations of results")
    s.add_argument("results", nargs="+")
    s.add_argument("--scope", choices=["file", "function"], default="file")
    r = sub.add_parser("report", help="an HTML report of a result")
    r.add_argument("result")
    r.add_argument("-o", "--output")
    m = sub.add_parser("model", help="a model of your own labels").add_subparsers(dest="action", required=True)
    t = m.add_parser("train")
    t.add_argument("results", nargs="+")
    t.add_argument("--labels", required=True)
    t.add_argument("--features")
    t.add_argument("--lambda", dest="lam", type=float, default=1.0)
    t.add_argument("-o", "--output")
    q = m.add_parser("predict")
    q.add_argument("results", nargs="+")
    q.add_argument("--model", required=True)
    v = sub.add_parser("serve", help="an HTTP interface for one text at a time")
    v.add_argument("--bind", default="127.0.0.1")
    v.add_argument("--port", type=int, default=8080)
    return p


def write(text: str, path: str | None) -> None:
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        sys.stdout.write(text)


def predictions(spark, model, results: list[dict]) -> list[dict]:
    """A row for each unit of the model's scope, and one for each file that failed."""
    from .operators import model as models
    from .sinks import output

    rows = models.predict(model, output.units(spark, results, model.scope)).select("path", "function", "start_line", "score", "unavailable")
    out = [r.asDict() for r in rows.collect()]
    for made in results:
        out += [{"path": f["path"], "function": None, "start_line": None, "score": None, "unavailable": f["error"]} for f in made["files"] if f["status"] == "error"]
    return sorted(out, key=lambda r: (r["path"].encode(), r["start_line"] or 0))


def run(args: argparse.Namespace) -> int:
    import json

    if args.command == "serve":
        from .http_api import serve

        return serve(args.bind, args.port)
    from .operators import model as models
    from .operators import stats
    from .plans.analyze import analyze
    from .sinks import html, output

    spark = session()
    if args.command == "analyze":
        with analyze(spark, args.path, args.project) as result:
            made = output.to_dict(result)
        for f in made["files"]:
            if f["status"] == "error":
                print(f"warning: {f['error']}", file=sys.stderr)
        write(output.to_csv(made) if args.format == "csv" else output.to_json(made), args.output)
    elif args.command == "stats":
        units = output.units(spark, output.read_results(args.results), args.scope).persist()
        columns = [registry.column(m) for m in registry.ids("F" if args.scope == "function" else "L")]
        made = stats.report(units, columns)
        for rows in (made["metrics"], made["correlations"], *made["by_language"].values()):
            for r in rows:
                for k in ("metric", "a", "b"):
                    if k in r:
                        r[k] = models.public_id(r[k])
        sys.stdout.write(json.dumps(made, indent=2) + "\n")
    elif args.command == "report":
        write(html.to_html(spark, output.read_results([args.result])[0]), args.output)
    elif args.action == "train":
        results = output.read_results(args.results)
        with open(args.labels, encoding="utf-8", newline="") as f:
            labels = models.read_labels(f.read())
        scope = models.label_scope(labels)
        failed = [f["path"] for made in results for f in made["files"] if f["status"] == "error"]
        rows = models.join_labels(output.units(spark, results, scope), failed, labels).persist()
        columns = [registry.column(m) for m in registry.ids("F" if scope == "function" else "L")]
        chosen = [registry.column(x.strip()) for x in args.features.split(",")] if args.features else None
        write(models.fit(rows, scope, columns, chosen, args.lam).to_json(), args.output)
    else:
        with open(args.model, encoding="utf-8") as f:
            model = models.Model.from_json(f.read())
        sys.stdout.write(json.dumps(predictions(spark, model, output.read_results(args.results)), indent=2) + "\n")
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return run(args)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
