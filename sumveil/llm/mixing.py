"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source whose target is at least its size is taken in complete epochs first; the rest of
the target is a weighted sample without replacement: every document gets an exponential
key ``-ln(u) / weight``, u from a hash of its id, and documents are taken by rising key
until the budget is reached.  The document at the edge is taken in part (its first
words), so a source meets its target to the word.

No source is sorted as a whole.  Keys fall into buckets; sums per (source, bucket) tell
which buckets are taken whole, and only the bucket at the edge is ordered.  Noisy texts
have longer keys than the buckets expect, so an edge bucket of more than EDGE rows is
dealt again, by the mean of its own keys, until it is small or its keys are all equal.  A source with a
third of all rows is thus spread like any other.

Sources are ranked by code point, null last (null and '' differ).  A null text has size
0 and is taken 0 words.  Equal ids get equal keys; such rows are ordered by size, and
rows equal in both are interchangeable.  An empty table gives no row.  Further input
columns may have any names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

WEIGHTS = (5.0, 2.0, 1.0)
#: Target of all sources together, and the most of one source, both relative to size.
TOTAL, MOST = 1.5, 2.0
BUCKETS = 4096
#: Rows of a source that one task may order.
EDGE = 50_000
#: Signs of noise: a document's weight falls from 1 to LEAST_WEIGHT with their share.
NOISE = r"[#*$%&|<>!]"
LEAST_WEIGHT = 0.05


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Between LEAST_WEIGHT and 1: less for texts with many signs of noise."""
    noise = F.regexp_count(text, F.lit(NOISE)) / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(F.lit(LEAST_WEIGHT), 1.0 - 10.0 * noise), F.lit(LEAST_WEIGHT))


def uniform(doc_id: Column, seed: int) -> Column:
    """In (0, 1), from 48 bits of a digest of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """``source, source_size`` with ``target``: weighted shares of the total, none above
    ``most`` times its size, the excess shared again by weight.

    Sources ordered by limit over weight reach their limits one after another; the level
    that the others share is the largest of the candidate levels.  One row per source
    meets in one task here.
    """
    named = Window.orderBy(F.asc_nulls_last("source"))
    rank = F.row_number().over(named) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    ranked = sizes.withColumns({"_rank": rank, "_w": weight, "_limit": most * F.col("source_size")})
    order = Window.orderBy(F.col("_limit") / F.col("_w"), "_rank")
    upto, after, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (total * F.sum("source_size").over(whole) - F.coalesce(F.sum("_limit").over(upto), F.lit(0.0))) / F.sum("_w").over(after)
    leveled = ranked.withColumn("_level", level)
    return leveled.select("source", "source_size", F.least("_limit", F.max("_level").over(whole) * F.col("_w")).alias("target"))


def _dealt(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows with what is taken before their bucket and its case: whole, none or edge.

    ``edges`` has per (source, bucket) the sum ``_sum``, what is taken before all buckets
    (``_start``) and what the source may take (``_rest``).
    """
    below = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("_before", F.col("_start") + F.coalesce(F.sum("_sum").over(below), F.lit(0)))
    whole = (F.col("_before") + F.col("_sum")) <= F.col("_rest")
    none = F.col("_before") >= F.col("_rest")
    edges = edges.withColumn("_case", F.when(whole, "whole").when(none, "none").otherwise("edge"))
    edges = edges.withColumnsRenamed({"source": "_source", "_bucket": "_b"})
    joined = rows.join(edges, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b")))
    return materialize(joined.drop("_source", "_b", "_sum", "_start"), "mix-rows")


def _by_own_mean(edge: DataFrame, buckets: int) -> DataFrame:
    """Edge rows in buckets of equal expected size if their keys are exponential beyond the least."""
    own = edge.groupBy(F.col("source").alias("_source")).agg(F.min("_key").alias("_low"), F.avg("_key").alias("_mean"))
    scaled = (F.col("_key") - F.col("_low")) / F.greatest(F.col("_mean") - F.col("_low"), F.lit(1e-300))
    bucket = F.least(F.lit(buckets - 1), F.floor(buckets * (1.0 - F.exp(-scaled)))).cast("int")
    return edge.join(own, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_bucket", bucket).drop("_source", "_low", "_mean")


def mix(docs: DataFrame, seed: int = 0, weights=WEIGHTS, total: float = TOTAL, most: float = MOST, buckets: int = BUCKETS) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, epochs and part.

    ``epochs`` whole copies are taken and the first ``part`` words of one more.
    """
    key = -F.log(uniform(F.col("doc_id"), seed)) / quality_weight(F.col("text"))
    sized = docs.select("doc_id", "source", size_in_words(F.col("text")).alias("size"), key.alias("_key"))
    bucket = F.least(F.lit(buckets - 1), F.floor(buckets * (1.0 - F.exp(-F.col("_key"))))).cast("int")
    sized = materialize(sized.withColumn("_bucket", bucket), "mix-sizes")
    sums = sized.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    plan = targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, total, most)
    plan = plan.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("_rest", F.floor(F.col("target")).cast("long") - F.col("_epochs") * F.col("source_size"))
    plan = plan.withColumnRenamed("source", "_source")
    edges = sums.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("_start", F.lit(0).cast("long"))
    rows = _dealt(sized, edges)
    edge, others = rows.filter("_case = 'edge'"), [rows.filter("_case <> 'edge'")]
    while edge.groupBy("source").agg(F.count("*").alias("n"), (F.max("_key") > F.min("_key")).alias("apart")).filter((F.col("n") > EDGE) & F.col("apart")).limit(1).count():
        again = _by_own_mean(edge.drop("_case"), buckets)
        kept = ["source", "_bucket", "source_size", "target", "_epochs", "_rest"]
        edges = again.groupBy(*kept).agg(F.sum("size").alias("_sum"), F.min("_before").alias("_start"))
        rows = _dealt(again.drop("source_size", "target", "_epochs", "_rest", "_before"), edges)
        edge, others = rows.filter("_case = 'edge'"), [*others, rows.filter("_case <> 'edge'")]
    earlier = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_rest") - F.col("_before") - F.coalesce(F.sum("size").over(earlier), F.lit(0))
    edge = edge.withColumn("_part", F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long"))
    other = reduce(DataFrame.unionByName, others).withColumn("_part", F.when(F.col("_case") == "whole", F.col("size")).otherwise(0).cast("long"))
    return other.unionByName(edge).select("doc_id", "source", "size", "source_size", "target", F.col("_epochs").alias("epochs"), F.col("_part").alias("part"))


def taken(mixed: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target and the words taken."""
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1), F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself in the input's columns: a row per epoch, and one with the further part.

    Documents are found again by id and text digest; rows equal in both take the same
    number of copies in sum.
    """
    same = Window.partitionBy("doc_id", "source", "size").orderBy("part")
    plan = mix(docs, seed).withColumn("_k", F.row_number().over(same))
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "source", size_in_words(F.col("text")).alias("_size"), F.xxhash64("text").alias("_digest"))
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", "source", "_size").orderBy("_digest")))
    plan = plan.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_n"), F.col("_k").alias("_j"), "epochs", "part")
    on = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_n")) & (F.col("_k") == F.col("_j"))
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col("epochs").cast("int")), F.when(F.col("part") > 0, F.array(F.col("part"))).otherwise(F.array().cast("array<long>")))
    out = rows.join(plan, on).select("_row", "_size", F.explode(F.when(F.col("_size") > 0, copies).otherwise(F.array(F.lit(-1).cast("long")))).alias("_words"))
    cut = (F.col("_words") >= 0) & (F.col("_words") < F.col("_size"))
    text = F.col("_row")["text"]
    new = {"text": F.when(cut, first_words(text, F.col("_words"))).otherwise(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length(first_words(text, F.col("_words"))).cast("long")).otherwise(F.col("_row")["n_chars"])
    return out.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])


SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
  (('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / {float(1 << 48)!r} AS u,
  coalesce(greatest({LEAST_WEIGHT}::DOUBLE, 1.0::DOUBLE - 10.0::DOUBLE * (len(regexp_extract_all(text, '{NOISE}'))::DOUBLE / greatest(length(text), 1))), {LEAST_WEIGHT}::DOUBLE) AS q FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, [{", ".join(f"{x}::DOUBLE" for x in WEIGHTS)}][1 + rank % {len(WEIGHTS)}] AS w, {MOST}::DOUBLE * source_size AS lim FROM r),
l AS (SELECT *, ({TOTAL}::DOUBLE * sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY lim / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(lim, max(level) OVER () * w) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
k AS (SELECT doc_id, size, source_size, target, epochs, floor(target)::BIGINT - epochs * source_size AS rest,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM k"""
