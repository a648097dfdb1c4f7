"""Joins of aggregates with commits and tokens.

All are equi-joins on (universe, producer, window), a key that holds at most one row
per side after the window aggregate, so no join key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["universe_id", "producer_id", "ws"]


def in_time(commits: DataFrame, size_ms: int, deadline_ms: int, staged: Column | None = None) -> DataFrame:
    """Commits that arrived at most ``deadline_ms`` after their window was staged."""
    staged = F.col("ws") + size_ms if staged is None else staged
    return commits.filter(F.col("commit_ts") <= staged + deadline_ms)


def commit_join(aggregates: DataFrame, commits: DataFrame) -> DataFrame:
    """Aggregates whose producer committed to the window; arrival order does not matter."""
    return aggregates.join(commits.select(*KEY).distinct(), KEY, "left_semi")


def uncommitted(aggregates: DataFrame, commits: DataFrame) -> DataFrame:
    """Aggregates that are discarded because no commit came."""
    return aggregates.join(commits.select(*KEY), KEY, "left_anti")


def incomplete_commits(commits: DataFrame, complete: DataFrame) -> DataFrame:
    """Commits that are discarded because the value is missing or has gaps."""
    return commits.join(complete.select(*KEY), KEY, "left_anti")


def committed(complete: DataFrame, commits: DataFrame) -> DataFrame:
    """(universe, producer, window) with a complete value and a commit."""
    return complete.select(*KEY).join(commits.select(*KEY).distinct().hint("merge"), KEY, "left_semi")


def token_semi(tokens: DataFrame, expected: DataFrame) -> DataFrame:
    """One token per expected producer; tokens of others and repeats are ignored.

    A repeated token carries the same content, so any one of them may stay.
    """
    return tokens.join(expected.select(*KEY).hint("merge"), KEY, "left_semi").dropDuplicates(KEY)


def valid_token(variants: list[Column]) -> Column:
    """Exactly one variant of a token is set."""
    total = F.lit(0)
    for v in variants:
        total = total + v.isNotNull().cast("int")
    return total == 1
