"""Code that arrives as a stream. File and function metrics only: project metrics need the whole set of files."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import metrics
from ..operators.parse import facts, parse, with_language


def analyze_stream(stream: DataFrame, path: str, checkpoint: str):
    """Starts a query that measures each batch of (project, path, content) and appends to path/files and path/functions.

    A batch writes under its own number, so a batch that runs again after a failure replaces what it wrote.
    """

    def batch(rows: DataFrame, number: int) -> None:
        parsed = parse(with_language(rows)).persist()
        f = facts(parsed)
        for name, df in (("files", metrics.by_file(f)), ("functions", metrics.by_function(f))):
            df.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        parsed.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
