"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sumveil.session import materialize, scratch_dir, ship

__all__ = ["WORD", "keep_where", "let", "materialize", "n_partitions", "open_fs", "scratch_dir", "ship", "table", "words"]

#: A word: no space and no control from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def keep_where(df: DataFrame, condition: Column, columns: list[Column]) -> DataFrame:
    """``columns`` of the rows that meet a condition on computed columns.

    A filter would be pushed below the projections that compute its columns, and evaluate
    them once per mention; a generator is not.
    """
    return df.select(F.explode(F.when(condition, F.array(F.struct(*columns)))).alias("_row")).select("_row.*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words of a text in order; none for null."""
    spaced = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(spaced, " ", -1), "")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def open_fs(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder named as Spark names it, also inside tasks."""
    if "://" in folder or folder.startswith("file:"):
        return pafs.FileSystem.from_uri(folder)
    return pafs.LocalFileSystem(), os.path.abspath(folder)
