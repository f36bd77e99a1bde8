"""The queries of this subpackage over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blockmax, bpe, covertree, crf, fim, hilbert, lines, mil, minhash, mixing, recurrent, suffix

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def held_out(n: int) -> Column:
    """Of every n classes of ids one is never learned from."""
    return F.coalesce(remainder(n) == 2, F.lit(False))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = crf.fit_languages(docs.where(~held_out(4)).select("doc_id", "text", "lang"))
    found = crf.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(4).alias("held_out"), "lang_pred", "score", "n_words")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removed_spans(table(spark, sf_dir, "documents")).drop("spans")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_frequent_words")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines.drop_site_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), stats=True)
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = mil.fit_quality(docs, table(spark, sf_dir, "labels").where(~held_out(4)))
    scored = mil.score_quality(docs, model)
    return scored.select("doc_id", held_out(4).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_passages", "top_passage")


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = recurrent.score_texts(docs, ~held_out(7))
    return scored.select("doc_id", held_out(7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_blockmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blockmax.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    whole = [F.sha2(c, 256).alias(name) for name, c in (("output_sha256", F.col("output")), ("restored_sha256", fim.restored(F.col("output"), F.col("form"))))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *whole)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_bpe": op2_bpe,
    "op3_suffix": op3_suffix,
    "op4_quality_rules": op4_quality_rules,
    "op5_topk": op5_topk,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality": op7_quality,
    "op8_lm": op8_lm,
    "op9_mixing": op9_mixing,
    "op10_minhash": op10_minhash,
    "op11_hilbert": op11_hilbert,
    "op12_blockmax": op12_blockmax,
    "op13_fim": op13_fim,
}
ORACLES = {
    "op4_quality_rules": lines.oracle_rules(),
    "op5_topk": covertree.ORACLE,
    "op6_line_dedup": lines.oracle_drop(),
    "op9_mixing": mixing.ORACLE,
    "op12_blockmax": blockmax.ORACLE,
    "op13_fim": fim.ORACLE,
}
