"""Registered queries of this subpackage: one per operator, over whole tables, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, kd_spelling, licenses, mixing, packing, periodic_runs, quality_rules, rp_forest, rule_classifier, simhash, template_extract, warc, wavelet
from .common import table

#: End ids the packed and the binary output use.
PACK_END, BINARY_END = 2, 0


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(table(spark, sf_dir, "documents")))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), PACK_END)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = wavelet.write_shards(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), BINARY_END)
    return wavelet.read_documents(folder, manifest)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(*warc.write(table(spark, sf_dir, "pages")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_extract.extract(table(spark, sf_dir, "pages"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), *vocabulary), *vocabulary))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = kd_spelling.letter_runs(table(spark, sf_dir, "documents"))
    return kd_spelling.variants(kd_spelling.frequent(kd_spelling.with_slips(runs)))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.runs(periodic_runs.with_loops(table(spark, sf_dir, "documents"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_mixing": op2_mixing,
    "op3_licenses": op3_licenses,
    "op4_embeddings": op4_embeddings,
    "op5_packing": op5_packing,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_token_binary": op7_token_binary,
    "op8_warc": op8_warc,
    "op9_simhash": op9_simhash,
    "op10_html": op10_html,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_spelling": op12_spelling,
    "op13_periodic_runs": op13_periodic_runs,
}
SQL: dict[str, str] = {"op1_quality_rules": quality_rules.SQL, "op2_mixing": mixing.SQL, "op3_licenses": licenses.SQL, "op8_warc": warc.SQL}
