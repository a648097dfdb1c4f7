"""From raw documents to packed training sequences, one written table per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sumveil.llm import mixing, packing, quality_rules, rule_classifier, simhash
from sumveil.llm.common import materialize, table
from sumveil.llm.queries import PACK_END, tokenizer_path


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line-first rules: failing lines are removed, rejected documents go."""
    return quality_rules.clean(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    return rule_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated and cut to the target weights of their sources."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 ids.

    After four stages an executor's JVM has grown, so workers remember fewer words.
    """
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), PACK_END, remembered=150_000)


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("simhash near-dedup", near_duplicates), ("mixing", mix), ("packing", pack)]

#: Rule weights are fitted and ids come from a tokenizer: SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's table is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
