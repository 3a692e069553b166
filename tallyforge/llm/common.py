"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local master gets a folder
    of its own (tests); on a cluster that would be another folder on each machine, so it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


ROWS_PER_FILE = 200_000


class Scratch:
    """Tables written to the shared folder. They cut lineage: a lost executor costs a reread, not a recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.n, self.tables = 0, []
        atexit.register(self.drop)

    def table(self, df: DataFrame, rows: int | None = None, few: bool = False) -> DataFrame:
        """Writes df now; returns it as read from what was written. rows: a bound of its rows, if known; few rows go to
        few files. few: it may have few rows, so its partitions are put together by their size."""
        if rows is not None:
            df = df.repartition(min(width(df), 1 + rows // ROWS_PER_FILE))
        elif few:
            df = df.hint("rebalance")
        self.n += 1
        path = f"{self.root}/{self.n}"
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        self.tables.append(out)
        return out

    def release(self, *but: DataFrame) -> None:
        """Deletes all tables but those given: the rest of the plan reads only these."""
        left = {x._scratch_path for x in but}
        for x in self.tables:
            if x._scratch_path not in left:
                self.drop(x)
        self.tables = [*but]

    def drop(self, df: DataFrame | None = None) -> None:
        """Deletes one table, or all of them."""
        path = self.root if df is None else getattr(df, "_scratch_path", None)
        if not path:
            return
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be over
            pass


def width(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions for df's session."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


#: A key counts as heavy when it holds more than 1/HEAVY of all rows, so there are at most HEAVY heavy keys.
HEAVY = 1000


def attach(left: DataFrame, right: DataFrame, key: str, rows: int, count: str) -> DataFrame:
    """left joined to right (unique on key) on key, left outer, without a task that meets one heavy key.

    right has in column `count` how many rows of left carry the key; rows is the total. The fewer than HEAVY keys
    above rows / HEAVY are broadcast. For their rows the shuffled join gets a key that spreads them, which matches
    nothing; the other keys are too small to overload a task.
    """
    payload = [c for c in right.columns if c != key]
    heavy = right.filter(F.col(count) * HEAVY > F.lit(rows))
    light = right.filter(F.col(count) * HEAVY <= F.lit(rows))
    h = heavy.select(F.col(key).alias("_hk"), F.struct(*payload).alias("_hv"))
    g = light.select(F.col(key).alias("_lk"), F.struct(*payload).alias("_lv"))
    out = left.join(F.broadcast(h), F.col(key) == F.col("_hk"), "left")
    spread = {"string": F.uuid(), "binary": F.uuid().cast("binary"), "bigint": F.lit(None).cast("bigint")}[dict(left.dtypes)[key]]
    if dict(left.dtypes)[key] == "bigint":
        spread = F.xxhash64(F.monotonically_increasing_id())
    out = out.withColumn("_jk", F.when(F.col("_hk").isNull(), F.col(key)).otherwise(spread))
    out = out.join(g, F.col("_jk") == F.col("_lk"), "left")
    value = F.when(F.col("_hk").isNotNull(), F.col("_hv")).otherwise(F.col("_lv"))
    out = out.withColumn("_v", value).drop("_hk", "_hv", "_lk", "_lv", "_jk")
    return out.select(*left.columns, *[F.col("_v")[c].alias(c) for c in payload])


def only(docs: DataFrame, won: DataFrame, doc_id: Column, place: Column) -> DataFrame:
    """One row of docs for each row of won (doc_id, place; unique) that has its id and place; all columns stay.

    doc_id, place: columns over docs. Rows that docs repeats meet in a join of those alone that are repeated.
    """
    free = lambda name: next(x for k in range(len(docs.columns) + 1) if (x := f"_{name}{k}") not in {c.lower() for c in docs.columns})
    i, p, n = free("id"), free("place"), free("n")
    marked = docs.withColumns({i: doc_id, p: place})
    keys = marked.groupBy(i, p).agg(F.count(F.lit(1)).alias(n))
    keys = keys.join(won.select(F.col("doc_id").alias("_won_id"), F.col("place").alias("_won_place")), F.col(i).eqNullSafe(F.col("_won_id")) & (F.col(p) == F.col("_won_place")), "left_semi")
    keys = Scratch(docs.sparkSession).table(keys)

    def held(rows: DataFrame) -> DataFrame:
        k = rows.select(F.col(i).alias("_held_id"), F.col(p).alias("_held_place")).alias("_held")
        m = marked.alias("_marked")
        on = F.col(f"_marked.{i}").eqNullSafe(F.col("_held._held_id")) & (F.col(f"_marked.{p}") == F.col("_held._held_place"))
        return m.join(k, on, "left_semi")

    out = held(keys.filter(F.col(n) == 1))
    again = keys.filter(F.col(n) > 1)
    if not again.isEmpty():
        out = out.unionByName(held(again).dropDuplicates([i, p]))
    return out.drop(i, p)
