"""Statistics of any wide numeric DataFrame: summaries, correlations, ranks, histograms, medians by language."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(c: Column | str) -> Column:
    """The value as a double; null where it is NaN or infinite."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def _long(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("metric"), finite(c).alias("value")) for c in columns]
    return df.select(*keys, F.explode(F.array(*cells)).alias("m")).select(*keys, "m.*")


def summary(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """[by,] metric, n, missing, mean, sd (n - 1), min, q1, median, q3, max; quartiles interpolate linearly."""
    by = by or []
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = _long(df, columns, by).groupBy(*by, "metric").agg(
        F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("missing"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), q.alias("q"), F.max("value").alias("max")
    )
    return out.select(*by, "metric", "n", "missing", "mean", F.when(F.col("n") > 1, F.col("sd")).alias("sd"), "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max")


def _guarded(x: Column, y: Column) -> Column:
    """Pearson's r; null below three pairs or without variance. Never divides by zero."""
    vx, vy = F.var_pop(x), F.var_pop(y)
    return F.when((F.count(x) >= 3) & (vx > 0) & (vy > 0), F.covar_pop(x, y) / F.sqrt(vx * vy))


def average_rank(value: str, partition: list[str]) -> Column:
    """Rank from 1; ties share the mean of their ranks."""
    return F.rank().over(Window.partitionBy(*partition).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*partition, value)) - 1) / F.lit(2.0)


def _moments(arrays: DataFrame, k: int, centre: list[float]) -> DataFrame:
    """i, j, n, sx, sy, sxx, syy, sxy of each pair of columns over the rows of arrays (v array<double>) where both have a
    value, less the centre: a row for each task and pair, so what is shuffled doesn't grow with the rows."""
    first, second = np.triu_indices(k, 1)

    def run(batches):
        total = np.zeros((4, k, k))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, k)  # nulls come as NaN
            there = ~np.isnan(x)
            x = np.where(there, x - centre, 0.0)
            m = there.astype(float)
            total += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        n, s, q, p = total
        columns = [first, second, n[first, second], s[first, second], s[second, first], q[first, second], q[second, first], p[first, second]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if t < 2 else pa.float64()) for t, c in enumerate(columns)], ["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])

    parts = arrays.select("v").mapInArrow(run, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])


def _r_of_moments() -> Column:
    """Pearson's r; null below three pairs or where a variance is nothing but rounding."""
    spread = lambda s, q: F.col(q) - F.col(s) * F.col(s) / F.col("n")
    vx, vy = spread("sx", "sxx"), spread("sy", "syy")
    varies = (F.col("n") >= 3) & (vx > F.col("sxx") * 1e-13) & (vy > F.col("syy") * 1e-13)
    return F.when(varies, (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(vx * vy))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, n, pearson, spearman of each pair of columns, over the rows where both have a value.

    Pearson's r comes from sums of products that each task makes for all pairs at once. Ranks are dealt once a column; a
    pair with a column that misses values is ranked by itself, over the rows where both have one.
    """
    k, pairs = len(columns), [(a, b, i, j) for (i, a), (j, b) in combinations(enumerate(columns), 2)]
    spine = df.sparkSession.createDataFrame(pairs, "a string, b string, i int, j int")
    if not pairs:
        return spine.select("a", "b", F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("pearson"), F.lit(None).cast("double").alias("spearman"))
    values = df.select(F.array(*[finite(c) for c in columns]).alias("v"))
    known = values.agg(F.count(F.lit(1)).alias("n"), *[x for i in range(k) for x in (F.count(F.col("v")[i]).alias(f"n{i}"), F.min(F.col("v")[i]).alias(f"m{i}"))]).first()
    whole = {i for i in range(k) if known[f"n{i}"] == known["n"]}
    plain = _moments(values, k, [known[f"m{i}"] or 0.0 for i in range(k)]).select("i", "j", F.col("n").cast("long").alias("n"), _r_of_moments().alias("pearson"))
    long = values.withColumn("row", F.monotonically_increasing_id()).select("row", F.posexplode("v").alias("c", "x"))
    ranked = long.filter(F.col("c").isin(sorted(whole))).select("row", "c", average_rank("x", ["c"]).alias("r"))
    ranks = ranked.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("c", "r"))).alias("m")).select(F.array(*[F.col("m")[i] for i in range(k)]).alias("v"))
    spearman = _moments(ranks, k, [(known["n"] + 1) / 2] * k).filter(F.col("i").isin(sorted(whole)) & F.col("j").isin(sorted(whole))).select("i", "j", _r_of_moments().alias("spearman"))
    if len(whole) < k:
        rows = values.select("v", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for _, _, i, j in pairs if not {i, j} <= whole])).alias("p"))
        rows = rows.select("p.i", "p.j", F.col("v")[F.col("p.i")].alias("x"), F.col("v")[F.col("p.j")].alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
        own = rows.withColumn("rx", average_rank("x", ["i", "j"])).withColumn("ry", average_rank("y", ["i", "j"]))
        spearman = spearman.unionByName(own.groupBy("i", "j").agg(_guarded(F.col("rx"), F.col("ry")).alias("spearman")))
    out = spine.join(plain, ["i", "j"], "left").join(spearman, ["i", "j"], "left")
    return out.select("a", "b", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "pearson", "spearman")


def pearson(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    rows = df.select(*(by or []), finite(a).alias("x"), finite(b).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    return rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), _guarded(F.col("x"), F.col("y")).alias("pearson"))


def histograms(df: DataFrame, columns: list[str], bins: int = 20) -> DataFrame:
    """metric, bin, lo, hi, n: equal widths from least to largest, the largest in the last bin; one bin if they are equal.
    Metrics without a value have no bins."""
    v = _long(df, columns, []).filter("value IS NOT NULL")
    bounds = v.groupBy("metric").agg(F.min("value").alias("low"), F.max("value").alias("high")).withColumn("w", (F.col("high") - F.col("low")) / bins)
    rows = v.join(F.broadcast(bounds), "metric")  # a row for each column
    k = F.when(F.col("w") > 0, F.least(F.floor(F.try_divide(F.col("value") - F.col("low"), F.col("w"))), F.lit(bins - 1))).otherwise(0).cast("long")
    counted = rows.groupBy("metric", k.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    last = F.when(F.col("w") > 0, bins - 1).otherwise(0).cast("long")
    spine = bounds.select("metric", "low", "high", "w", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("bin"))
    hi = F.when((F.col("bin") == bins - 1) | (F.col("w") == 0), F.col("high")).otherwise(F.col("low") + (F.col("bin") + 1) * F.col("w"))
    return spine.join(counted, ["metric", "bin"], "left").select("metric", "bin", (F.col("low") + F.col("bin") * F.col("w")).alias("lo"), hi.alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """bin, lo, hi, n of one column."""
    return histograms(df, [column], bins).drop("metric")


def medians_by_language(df: DataFrame, columns: list[str], languages: list[str], by: str = "language") -> DataFrame:
    """metric and the median of each language as a column."""
    rows = _long(df, columns, [by])
    return rows.groupBy("metric").agg(*[F.percentile(F.when(F.col(by) == x, F.col("value")), 0.5).alias(x) for x in languages])


def report(df: DataFrame, columns: list[str]) -> dict:
    """units, metrics, by_language and correlations as plain values, in the order of columns."""
    order = {c: k for k, c in enumerate(columns)}
    rows = lambda d: sorted((r.asDict() for r in d.collect()), key=lambda r: (r.get("language") or "", order[r.get("metric") or r["a"]], order.get(r.get("b"), 0)))
    by: dict[str, list] = {}
    for r in rows(summary(df, columns, ["language"])):
        by.setdefault(r.pop("language"), []).append(r)
    n = df.count()
    overall = rows(summary(df, columns))
    if not n:
        overall = [{"metric": c, "n": 0, "missing": 0} | dict.fromkeys(("mean", "sd", "min", "q1", "median", "q3", "max")) for c in columns]
    return {"units": n, "metrics": overall, "by_language": by, "correlations": rows(correlations(df, columns))}
