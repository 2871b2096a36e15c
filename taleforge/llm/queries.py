"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleforge.llm import license_scan as licenses
from taleforge.llm import quality_cotraining as quality
from taleforge.llm.additive_quantisation import nearest
from taleforge.llm.audio_fingerprint import alignments, fingerprints, recordings
from taleforge.llm.bloom_lm import score
from taleforge.llm.bpe import encode_table
from taleforge.llm.common import stash
from taleforge.llm.language_id import fit, identify
from taleforge.llm.license_scan import license_scan
from taleforge.llm.ngram_jaccard import ngram_jaccard
from taleforge.llm.packing import pack
from taleforge.llm.sharding import shard


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_documents(spark, sf_dir), shards=24)[0]


def op2_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), queries=F.col("vec_id") % 20 == 0, k=20)


def op3_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).select("doc_id", "p_text", "p_page", "quality_score", "keep")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(_documents(spark, sf_dir), n=4, num=85, den=100)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_documents(spark, sf_dir)).withColumn("licenses", F.array_join("licenses", ","))


def op6_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    out = score(_documents(spark, sf_dir), train=~held_out)
    return out.withColumn("held_out", ~F.col("trained")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_table(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), digest=True)


def op8_chroma_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding played as a recording; excerpts with noise of every fiftieth are found again among all.

    One row for each recording and query that align; a recording that no query aligns with has one row without query_id.
    """
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    prints = stash(fingerprints(recordings(rows)), "audio-prints")
    asked = stash(fingerprints(recordings(rows, queries=F.col("vec_id") % 50 == 0)), "audio-asked")
    out = prints.join(alignments(asked, prints), F.col("id") == F.col("match_id"), "left")
    return out.select(F.col("id").alias("vec_id"), "n_codes", F.crc32("codes").alias("codes_crc32"), "query_id", "offset", "bit_error", "overlap")


def op9_piece_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    model = fit(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=~held_out)
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model, with_text=False).select("doc_id", "held_out", "lang_pred", "score")


def op10_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end=0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_virtual_slots, op2_additive_quantisation, op3_quality_cotraining, op4_ngram_jaccard, op5_license_scan, op6_bloom_lm, op7_streaming_bpe, op8_chroma_fingerprint, op9_piece_language, op10_cutting_stock)}


def oracle_sql() -> dict[str, str]:
    """The others need checksums, tokenizers, fitted models or closures over all pairs: tested against brute force."""
    return {"op5_license_scan": licenses.oracle()}
