"""A corpus pipeline over the documents table; each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.shared import materialise, ship_package


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine predicts to be toxic go."""
    from palimpsest.llm.toxicity import train, without_toxic

    ship_package(spark)
    return without_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    from palimpsest.llm.extendible_dedup import without_copies

    ship_package(spark)
    return without_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (shingles of five words, a similarity of 0.8 or more) stays,
    that of the smallest doc_id."""
    from palimpsest.llm.jaccard_join import one_of_each

    ship_package(spark)
    return one_of_each(docs, k=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of domains with too few tokens are repeated; none is lost."""
    from palimpsest.llm.soft_mixing import mixed_documents

    ship_package(spark)
    return mixed_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), [0.85, 0.15], ["plain", "poor"])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, as pieces of documents with their ids."""
    from palimpsest.llm.packing import pack_documents
    from palimpsest.llm.queries import WORDS

    ship_package(spark)
    return pack_documents(docs, WORDS)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Stages use trained models and indexes of their own, which SQL can't express; the tests hold them against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table, each written and read again: pieces of sequences with their ids.

    Edge cases: null and empty texts aren't toxic, are one group of exact copies, link with nothing and have the end
    id alone; a null doc_id is kept as one more id; rows that repeat are copies of each other; an empty table gives
    no pieces; without labels nothing is toxic and all documents are of one mixture; more columns are carried through
    whatever their names, and the pieces don't have them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
