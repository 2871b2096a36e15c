"""From raw documents to packed training sequences: four stages over whole tables.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; the first three return
the columns of ``documents``, the last one the pieces of the sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleforge.llm import quality_cotraining
from taleforge.llm.common import stash
from taleforge.llm.language_id import fit, identify
from taleforge.llm.ngram_jaccard import ngram_jaccard
from taleforge.llm.packing import pack

#: A document's language has to have this share of the probability of all.
SURE_LANGUAGE = 0.5
#: Rejected ids are broadcast up to this many (8 bytes each), and joined by a shuffle beyond.
BROADCAST_IDS = 500_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers keep; without labels all of them. Null texts count as empty."""
    model = quality_cotraining.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_cotraining.score(docs, model).where("keep").select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned; texts without a letter go. If no language is declared at all, all stay."""
    model = fit(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=F.lit(True))
    if not model.languages:
        return docs
    return identify(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= SURE_LANGUAGE)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 over five-word shingles the document of the smallest id.

    Texts without words stay, and so do rows without an id. Of rows that repeat id and text one stays.
    """
    groups = stash(ngram_jaccard(docs, n=5, num=80, den=100, name="pipeline-jaccard"), "pipeline-groups")
    gone = groups.where("component_id is not null and doc_id <> component_id").select("doc_id")
    stay = groups.where("component_id is null or doc_id is null or doc_id = component_id").select("doc_id")
    gone = stash(gone.join(stay, "doc_id", "left_anti").distinct(), "pipeline-gone")  # an id that repeats may stay in one row
    out = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti")
    twice = stash(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "pipeline-twice")
    n = twice.count()
    if n:
        twice = F.broadcast(twice) if n <= BROADCAST_IDS else twice
        out = out.join(twice, "doc_id", "left_anti").unionByName(out.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    return out.select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that all remaining documents fill."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), name="pipeline-pack")


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("packing", packing)]

#: Tokenizers and fitted classifiers have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}-out")
    return docs
