"""Corpus pipeline: toxicity, exact dedup, near-duplicate removal, repeated-passage removal, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; its result is written as Parquet
and read again. All but the last return the columns of ``documents``, extra ones unchanged whatever their names.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_context.llm import bwt_dedup, exact_dedup, jaccard_join, packing, toxicity
from corpus_context.llm.common import scratch_path, table


def _narrow(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _rest): the other columns travel in one, so that no name of theirs can clash with an operator's."""
    rest = [F.col(f"`{c}`").alias(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *rest).alias("_rest"))


def _whole(df: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """``df`` with the columns of ``docs`` again; ``changed`` replaces some of the others."""
    return df.select(*[F.col(c) if c in ("doc_id", "text") else changed.get(c, F.col("_rest")[c]).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; the others stay as they are."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _whole(toxicity.score(_narrow(docs), model).where("not rejected"), docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return _whole(exact_dedup.dedup(_narrow(docs)).where("kept"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one document stays: that of the smallest id, one of them if several rows have it."""
    return _whole(jaccard_join.classes(_narrow(docs)).where("_class = _key"), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur again anywhere are cut; bytes left of a cut character become U+FFFD."""
    left = bwt_dedup.remove_repeats(_narrow(docs))
    whole = F.size("spans") == 0
    text = F.when(whole, F.col("text")).otherwise(F.make_valid_utf8(F.col("kept").cast("string")))
    n_chars = F.when(whole, F.col("_rest")["n_chars"]).otherwise(F.length("text").cast("long"))
    return _whole(left.withColumn("text", text), docs, n_chars=n_chars)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences, with the CRC-32 of their ids."""
    return packing.digests(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_duplicates", drop_near_copies),
          ("repeated_passages", cut_repeats), ("packing", pack)]
#: No SQL for the model, the MinHash join, the tokens; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
