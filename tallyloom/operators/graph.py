"""Breadth-first search over edges by joins, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.shared import fresh_path


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def remove_state(spark: SparkSession, state: str) -> None:
    """Forget a search, once its result is written elsewhere."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def level(spark: SparkSession, state: str, d: int) -> DataFrame:
    return spark.read.parquet(f"{state}/level={d}")


def whole_levels(spark: SparkSession, state: str) -> int:
    """How many levels a state folder holds, from level 0 on: those whose writer has left its mark that all is there."""
    d = 0
    while exists(spark, f"{state}/level={d}/_SUCCESS"):
        d += 1
    return d


def bfs(edges: DataFrame, seeds: DataFrame, *, depth: int = 6, node: str = "node", state: str | None = None) -> DataFrame:
    """(node, depth, via): each node on first sight, via the smallest neighbour of the level before; seeds have none.

    edges: (from, to). Each level is a table of the folder state: the frontier is the last, the visited nodes are all. A search
    that finds whole levels there goes on after the last of them and reads the edges of no earlier one; a level that was cut off
    is written anew. Without state a new folder in spark.checkpoint.dir serves. The result is read from the folder, so
    it must stay until that is written elsewhere.
    """
    spark = edges.sparkSession
    state = state or fresh_path(spark)
    done = whole_levels(spark, state)
    if not done:
        first = seeds.select(F.col(node).alias("node")).where("node is not null").distinct()
        first.select("node", F.lit(0).alias("depth"), F.lit(None).cast(edges.schema["from"].dataType).alias("via")).write.mode("overwrite").parquet(f"{state}/level=0")
        done = 1

    def seen(n: int) -> DataFrame:
        out = level(spark, state, 0)
        for d in range(1, n):
            out = out.union(level(spark, state, d))
        return out

    while done <= depth and not level(spark, state, done - 1).isEmpty():
        front = level(spark, state, done - 1).select(F.col("node").alias("from"))
        step = edges.where("to is not null").join(front, "from").groupBy(F.col("to").alias("node")).agg(F.min("from").alias("via"))
        new = step.join(seen(done).select("node"), "node", "left_anti").select("node", F.lit(done).alias("depth"), "via")
        new.write.mode("overwrite").parquet(f"{state}/level={done}")
        done += 1
    return seen(min(done, depth + 1))
