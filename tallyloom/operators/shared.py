"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of our own only in a local session without one, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="tallyloom-"))
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession) -> str:
    """A path that no table has yet: in the innermost scratch block, else in the shared folder."""
    return f"{SCRATCH.get() or shared_dir(spark)}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table or a folder of tables; nothing happens where there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for the tables that operators cut inside the block; it goes when the block ends, by an error too.

    Frames made inside read these tables, so their results have to be written or collected inside. Blocks may be nested.
    Without a block such tables stay in the shared folder, as the frames that are handed out need them.
    """
    folder = fresh_path(spark)
    token = SCRATCH.set(folder)
    try:
        yield folder
    finally:
        SCRATCH.reset(token)
        remove(spark, folder)


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: a lost executor costs no earlier stage, and no later one plans it anew."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(taken: list[str], *names: str) -> list[str]:
    """names, with underscores before those that are among taken, whatever their case."""
    used = {c.lower() for c in taken}
    out = []
    for n in names:
        while n.lower() in used:
            n = f"_{n}"
        used.add(n.lower())
        out.append(n)
    return out


def running_totals(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """df with name: the sum of value over the rows of the group (by) that come before in order, which no two rows of a group share.

    Rows are dealt by ranges of group and order and summed within them; before that comes what the group has in earlier
    ranges. So no group is one task, however large.
    """
    part, own, before = free_names([*df.columns, name], "part", "own", "before")
    keys = free_names([*df.columns, name, part, own, before], *by)
    ranged = cut(df.repartitionByRange(*by, *order).withColumn(part, F.spark_partition_id()))
    w = Window.partitionBy(part, *by)
    inside = F.sum(value).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(value)
    totals = ranged.groupBy(part, *by).agg(F.sum(value).alias(own))
    earlier = F.sum(own).over(Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(F.col(part).alias(f"{part}_"), *[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.coalesce(earlier, F.lit(0)).alias(before))
    same = F.col(part) == F.col(f"{part}_")
    for c, k in zip(by, keys, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(k))
    return ranged.withColumn(name, inside).join(totals, same).withColumn(name, F.col(name) + F.col(before)).select(*df.columns, name)


def meet(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, *, side: int = 2048) -> DataFrame:
    """left joined to right on keys, the only names that they share; null keys meet nothing.

    A key with n rows here and m there, either of them above side, is dealt by the ids' hashes to ceil(n / side) times
    ceil(m / side) parts: its pairs are then made by as many tasks, and no part is left out. The counts of such keys are
    at most rows / side, and Spark broadcasts them only if the written table is small enough. The sides themselves are always
    shuffled: what they make is larger than they are, and has to be spread.
    """
    own, other, high, wide = free_names([*left.columns, *right.columns], "own", "other", "high", "wide")
    left, right = left.dropna(subset=keys), right.dropna(subset=keys)

    def frequent(d: DataFrame, name: str) -> DataFrame:
        n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > side)
        return n.withColumn(name, F.ceil(F.col(name) / side))

    hot = cut(frequent(left, high).join(frequent(right, wide), keys, "full"))
    if hot.isEmpty():
        return left.join(right.hint("merge"), keys)

    def dealt(d: DataFrame, key: str, parts: str, copies: str, mine: str, theirs: str) -> DataFrame:
        d = d.join(hot, keys, "left")
        d = d.withColumn(mine, F.pmod(F.xxhash64(key), F.coalesce(parts, F.lit(1))))
        return d.withColumn(theirs, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(copies, F.lit(1)).cast("long") - 1))).drop(high, wide)

    a = dealt(left, left_id, high, wide, own, other)
    b = dealt(right, right_id, wide, high, other, own)
    return a.join(b.hint("merge"), [*keys, own, other]).drop(own, other)
