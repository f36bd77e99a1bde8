"""Five stages over documents, each one of the operators, each over all rows that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, lines, minhash, mixing
from tallyloom.llm.queries import tokenizer_path
from tallyloom.operators.shared import fresh_path, remove, scratch


def packed(docs: DataFrame) -> DataFrame:
    """text and source, and the other columns as one, so that none can clash with those that an operator adds."""
    return docs.select("text", "source", F.struct(*(c for c in docs.columns if c not in ("text", "n_chars"))).alias("document"))


def unpacked(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, with the text and its n_chars as they are now."""
    now = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*(now[c].alias(c) if c in now else F.col("document")[c].alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, their text less the lines above the limits; n_chars as the text has now."""
    return unpacked(lines.quality_rules(packed(docs)).where("kept"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their text less the frame lines of its site; n_chars as the text has now."""
    return unpacked(lines.drop_site_lines(packed(docs)), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return minhash.drop_near_duplicates(docs).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, as often as it was taken."""
    return bpe.bpe_encode(docs, tokenizer_path())


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("near-duplicates", near_dedup), ("mixing", mix), ("BPE", encode)]

#: MinHash and BPE have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each but the last written to the shared folder and read again.

    A stage's input goes once its output is written, and so do the tables that the stage made on its way.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        path = fresh_path(spark)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
