"""A corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing and packing over ``documents``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import line_dedup, mixing, ngram_join, packing, quality_rules
from vitrine.llm.common import written
from vitrine.llm.queries import SHARES


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or the learned rules reject go; null and empty texts fail the base. Repeated rows are judged
    each, an empty table stays empty, and without labels of both kinds only the base counts."""
    rules = quality_rules.learn(docs, _labels(spark, sf_dir))
    return quality_rules.judge(docs, rules).where("kept").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites go from every document; all documents stay, a null text too. ``n_chars`` follows the text."""
    cut = line_dedup.remove_boilerplate(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id. Equal rows become one. Documents without an id or
    without words all stay. An empty table stays empty."""
    keep = written(ngram_join.join(docs).where("doc_id = component_id").select("doc_id").distinct(), "kept")
    return docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id IS NULL")).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out by their rates; the clean domain keeps its size. Equal rows share a rate and a draw.
    An empty table stays empty."""
    rates = mixing.mix(docs, _labels(spark, sf_dir), SHARES, anchor="clean")
    return mixing.apply_rates(docs, rates)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 4096; a null or empty text is the end id alone."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("mixing", mixture), ("packing", sequences)]

#: The learned rules, the classifier and the tokenizer can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each one's rows written before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
