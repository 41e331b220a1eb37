"""A training corpus from ``documents`` in five stages, each by one operator of ``orograph.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``.

Edge cases: extra columns of ``documents`` go through; null ids stay like others (they have no label);
several rows with one id are documents of their own unless their texts are near copies; null texts stay
null until they are encoded to no tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph.llm import byte_bpe, decontamination, near_copies, pii, quality
from orograph.llm.queries import QUALITY_LIMIT, remainder
from orograph.llm.registry import table
from orograph.llm.shared import written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the limit."""
    model = quality.train(docs, table(spark, sf_dir, "labels").filter(remainder(4) != 2))
    return docs.filter(quality.score_column(F.col("text"), model) >= QUALITY_LIMIT)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies; null ids come last.

    Rows are told apart by a hash of id and text, so different texts under one id are judged each by itself
    and null ids like all others. Of rows with equal id and text one stays.
    """
    row = F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull())
    named = docs.withColumn("_row", row)
    groups = near_copies.near_copies(named.select("_row", "text"), "_row").select("_row", "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    first = named.select("_row", "doc_id").join(groups, "_row").groupBy("component_id").agg(F.min(order).alias("first"))
    keep = first.select(F.col("first._row").alias("_row"))
    return named.join(keep, "_row", "left_semi").dropDuplicates(["_row"]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return docs.filter(~decontamination.hit_column(F.col("text"), table(spark, sf_dir, "benchmark")))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows the text."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with digests of the ids and of what they decode to."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.encode_and_decode(docs, ranks), keep=("ids",))


STAGES = [
    ("quality", keep_quality),
    ("near copies", keep_one_copy),
    ("decontamination", drop_contaminated),
    ("personal data", redact_personal_data),
    ("encoding", encode),
]
#: The classifier of the first stage is trained, which SQL cannot express; tests compare with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
