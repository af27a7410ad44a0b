"""The corpus pipeline: five stages over ``documents``, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymark.llm import jaccard, lines, packing, quality, tiling
from tallymark.llm.common import free_name, split_by_texts, stage, text_hashes, without_texts

#: Documents with this probability of quality at least are kept.
KEEP = 0.5
#: Near-duplicates: shingles of five words, four fifths of them shared.
WORDS, PERCENT = 5, 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, row by row."""
    return quality.accepted(docs, quality.fit_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), least=KEEP)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines; those of which nothing else is left go."""
    removed = F.col(free_name(docs, "removed_lines"))
    kept = lines.remove_boilerplate(docs).where((removed == 0) | F.col("text").rlike(r"\S"))
    return kept.withColumn("n_chars", F.when(removed > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest id, a null id last; of one id, that of the smallest text hash.

    Groups are groups of texts. A text in a group of several rows is settled by its hash: no row of it stays, or one of one id.
    """
    name = free_name(docs, "text_hash")
    h1, h2 = text_hashes("text")
    key = F.struct(h1.alias("h1"), h2.alias("h2"))
    grouped = jaccard.group_documents(docs.select("text", key.alias(name)), name, words=WORDS, percent=PERCENT)
    grouped = stage(grouped.where("n_shingles > 0").select(F.col(name).alias("key"), F.col("component_id").alias("component")), "groups")
    # Groups of one row, nearly all, need not be ranked.
    several = grouped.groupBy("component").agg(F.count("*").alias("rows")).where("rows > 1")
    texts = stage(grouped.join(several, "component", "left_semi").distinct(), "texts")
    rank = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", F.xxhash64("text").alias("text"), key.alias("key"))
    members = docs.select(key.alias("key"), rank.alias("rank")).join(texts, "key")
    first = members.groupBy("component").agg(F.min("rank").alias("first"))
    stays = F.when(F.col("key") == F.col("first.key"), F.struct(F.col("first.doc_id").alias("id")))
    settled = stage(texts.join(first, "component").select("key.h1", "key.h2", stays.alias("stays"), F.lit(True).alias("known")), "settled")
    those, others = split_by_texts(docs, "text", settled)
    own = F.col(f"c{docs.columns.index('doc_id')}")
    left = those.join(settled, ["h1", "h2"], "left").where(
        F.col("known").isNull() | F.col("stays").isNotNull() & own.eqNullSafe(F.col("stays.id")))
    left = left.withColumn("copy", F.row_number().over(Window.partitionBy("h1", "h2", own).orderBy(F.lit(0))))
    left = left.where(F.col("known").isNull() | (F.col("copy") == 1))
    return others.unionByName(left.select(*others.columns)).toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item leaks, text by text."""
    key = free_name(docs, "text_hash")
    h1, h2 = text_hashes("text")
    found = tiling.leaks(docs.select("text", F.struct(h1.alias("h1"), h2.alias("h2")).alias(key)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key)
    return without_texts(docs, "text", stage(found.select(f"{key}.*").distinct(), "leaked"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of at most 2048."""
    return packing.packed_documents(spark, docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("pack", pack),
]

#: No stage but the second can be said in SQL; the tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
