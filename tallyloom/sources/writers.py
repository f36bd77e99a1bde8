"""Sinks: fixed-field text, JSON lines, chunked Parquet, manifests, append logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.shared import free_names


def with_fields(df: DataFrame, fields: list[str], blank: bool = True) -> DataFrame:
    """Exactly these columns as text: others are left out, missing ones blank."""
    out = df.select(*[F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields])
    return out.na.fill("") if blank else out


def write_csv(df: DataFrame, path: str, fields: list[str], order: list[str] | None = None) -> None:
    out = with_fields(df, fields)
    (out.orderBy(*order) if order else out).write.mode("overwrite").csv(path, header=True, escape='"')


def write_jsonl(df: DataFrame, path: str) -> None:
    """Null fields are left out."""
    df.write.mode("overwrite").json(path)


def numbered(df: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """df with index (from 0 in key's order) and total, without one task over all rows.

    Rows are numbered within range partitions, and the partitions' sizes are summed up: a row a partition.
    """
    p, i, n, before = free_names([*df.columns, "index", "total"], "p", "i", "n", "before")
    part = (df.repartitionByRange(parts, key) if parts else df.repartitionByRange(key)).withColumn(p, F.spark_partition_id())
    sizes = part.groupBy(p).agg(F.count(F.lit(1)).alias(n))
    above = (F.sum(n).over(Window.orderBy(p)) - F.col(n)).alias(before)
    sizes = sizes.select(p, above, F.sum(n).over(Window.partitionBy(F.lit(0))).alias("total"))
    row = F.row_number().over(Window.partitionBy(p).orderBy(key)) - 1
    return part.withColumn(i, row).join(F.broadcast(sizes), p).withColumn("index", F.col(i) + F.col(before)).drop(p, before, i)


def chunked(df: DataFrame, key: str, chunks: int) -> DataFrame:
    """df with chunk: contiguous parts of equal size in key's order."""
    d = numbered(df, key, max(1, chunks))
    n = F.greatest(F.lit(1), F.least(F.lit(chunks), F.col("total")))
    return d.withColumn("chunk", F.floor(F.col("index") / F.ceil(F.col("total") / n)).cast("int")).drop("index", "total")


def write_chunks(df: DataFrame, path: str, key: str, chunks: int) -> None:
    out = chunked(df, key, chunks)
    out.repartitionByRange(max(1, chunks), "chunk").sortWithinPartitions("chunk", key).write.mode("overwrite").partitionBy("chunk").parquet(path)


def manifest(spark, paths: list[str]) -> DataFrame:  # noqa: ANN001
    """Path, bytes and sha256 of the files in paths."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """df as Parquet at path: written beside it, and put in its place only when whole, so that a reader finds the old table or the new one."""
    sc = df.sparkSession.sparkContext
    of = sc._jvm.org.apache.hadoop.fs.Path
    part, old = of(f"{path}.part"), of(f"{path}.old")
    df.write.mode("overwrite").parquet(f"{path}.part")
    fs = part.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if fs.exists(of(path)):
        fs.rename(of(path), old)
    if not fs.rename(part, of(path)):
        raise OSError(f"can't put {path}.part in the place of {path}")
    fs.delete(old, True)
