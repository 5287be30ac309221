"""A training-data pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept,
and returns a DataFrame, which is written and read again as the next stage's docs. All
but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomflow.llm.decontamination import decontaminate
from loomflow.llm.quality_rules import quality
from loomflow.llm.secret_scan import redact
from loomflow.llm.sentencepiece_codec import encode_decode
from loomflow.llm.simhash import among, similar_texts
from loomflow.llm.tables import fresh, row_key, table, written


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; null and empty texts go, and repeated rows are judged each."""
    (kept,) = fresh(docs, "kept")
    return quality(docs, features=False, kept_col=kept).where(kept).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that of the smallest id (a null id is larger than any other).

    Null and empty texts are one class; of equal rows one stays.
    """
    (key,) = fresh(docs, "row_key")
    found = written(similar_texts(docs), "classes")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row_key"))
    classes = written(found.groupBy("component").agg(F.count("*").alias("n"), first.alias("x")).where("n > 1").select("component", F.col("x.row_key").alias(key)), "several")
    # Most texts are alone in their class and stay: only the others are shuffled, with those few whose keys begin like one of theirs.
    several = found.join(classes.select("component"), "component", "left_semi").select(F.col("row_key").alias(key))
    maybe, alone = among(docs.withColumn(key, row_key(F.col("doc_id"), F.col("text"))), key, several)
    goes = several.distinct().join(classes.select(key), key, "left_anti")
    out = maybe.join(goes, key, "left_anti")
    repeated = found.groupBy("row_key").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if repeated:
        out = out.dropDuplicates([key])
    return out.unionByName(alone).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window; null and empty texts stay, and repeated rows are judged each."""
    (key,) = fresh(docs, "row_key")
    hit = decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("row_key").alias(key)).distinct()
    return docs.withColumn(key, row_key(F.col("doc_id"), F.col("text"))).join(hit, key, "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by [secret]; n_chars follows the text, and a null text stays null."""
    return redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document with begin and end, and digests of them and of the text that they decode to; null is empty."""
    return encode_decode(docs, _vocabulary(), text_out=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("sentencepiece", sentencepiece),
]

#: The field's spans and the near copies are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
