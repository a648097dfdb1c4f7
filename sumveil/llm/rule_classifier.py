"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of whole texts are native column expressions.  A small random forest is fitted
on labelled rows; every path from a root to a node is a rule, a conjunction of bounds on
statistics.  A logistic regression with L1 penalty weighs the rules, most of them with
zero, and the rules that are left are compiled into one column expression: scoring is a
single pass without Python.

Training rows are those with a label whose ``crc32(doc_id) mod 4`` is not 2, at most
about ``TRAINING_ROWS`` of them, chosen by a hash of the id; everything else covers all
rows.  Labels that are null are ignored, repeated labels of an id count as the lowest.
Without labels of both kinds the score is the share of label 1, or 0.5 without any.
Null and empty texts have zero statistics and are scored like others; null ids are not
held out; an empty table gives no row.  Language, source and ids are no inputs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, words

TRAINING_ROWS = 50_000
HELD_OUT = 2
THRESHOLD = 0.7
TREES, DEPTH, PENALTY = 24, 3, 0.001
#: Rules that hold for fewer training rows, or for all but so few, are left out.
FEWEST = 10
#: Statistics of a text; see ``statistics``.
NAMES = ("log_words", "word_length", "symbols", "emphasis", "capitals", "digits", "new_words", "new_lines", "separators", "stops", "line_words")


def statistics(text: Column, w: Column) -> dict[str, Column]:
    """NAMES, as doubles, from a text and its words."""
    n, lines = F.size(w), F.split(text, "\n", -1)
    per = lambda pattern, of: F.regexp_count(text, F.lit(pattern)) / F.greatest(of, F.lit(1))
    share = lambda a, b: a / F.greatest(b, F.lit(1))
    out = {
        "log_words": F.log1p(n.cast("double")),
        "word_length": share(F.length(F.array_join(w, "")), n),
        "symbols": per(r"[#*$%&|<>{}^~=_@\\]", F.length(text)),
        "emphasis": per(r"[!?][!?]+", n),
        "capitals": per(r"[A-Z\x{C0}-\x{DE}]", F.length(text)),
        "digits": per(r"[0-9]", F.length(text)),
        "new_words": share(F.size(F.array_distinct(w)), n),
        "new_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "separators": per(r"[|>\x{BB}\x{203A}\x{2022}\x{B7}]", n),
        "stops": per(r"[.!?]", n),
        "line_words": share(n, F.size(lines)),
    }
    return {k: v.cast("double") for k, v in out.items()}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, ``_digest`` of the text, held_out and the statistics of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("_text"), words(F.col("text")).alias("_words"))
    stats = statistics(F.col("_text"), F.col("_words"))
    return rows.select("doc_id", F.xxhash64("_text").alias("_digest"), held_out(F.col("doc_id")).alias("held_out"), *[v.alias(k) for k, v in stats.items()])


def paths(tree: str) -> list[tuple[tuple[int, str, float], ...]]:
    """Paths from the root to every node, from a tree's printed form."""
    out, stack = [], []
    for line in tree.splitlines():
        m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)", line)
        if m:
            depth = len(m[1])
            while stack and stack[-1][0] >= depth:
                stack.pop()
            stack.append((depth, (int(m[2]), m[3], float(m[4]))))
            out.append(tuple(x for _, x in stack))
    return out


def narrowed(path) -> tuple[tuple[int, str, float], ...]:
    """The path with one bound per statistic and direction, in a fixed order."""
    bounds: dict[tuple[int, str], float] = {}
    for k, side, x in path:
        old = bounds.get((k, side))
        bounds[k, side] = x if old is None else (min if side == "<=" else max)(old, x)
    return tuple(sorted((k, side, x) for (k, side), x in bounds.items()))


def condition(rule) -> Column:
    out = F.lit(True)
    for k, side, x in rule:
        out = out & (F.col(NAMES[k]) <= x if side == "<=" else F.col(NAMES[k]) > x)
    return out


class RuleModel:
    """``score = sigmoid(intercept + sum of the weights of rules that hold)``."""

    def __init__(self, intercept: float, rules: list, weights: list[float]):
        self.intercept, self.rules, self.weights = intercept, rules, weights

    def score(self) -> Column:
        total = F.lit(float(self.intercept))
        for rule, w in zip(self.rules, self.weights, strict=True):
            total = total + F.when(condition(rule), float(w)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def fit(measured: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, seed: int = 7) -> RuleModel:
    from math import log

    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min(F.when(F.col("quality") > 0, 1.0).otherwise(0.0)).alias("label"))
    known = known.filter(~held_out(F.col("doc_id")))
    count = max(1, known.count())
    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    sample = measured.join(known.filter(place < rows / count), "doc_id").select("label", *NAMES).coalesce(8)
    sample = materialize(sample, "rules-sample")
    n, good = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not n or good in (0, n):
        share = (good + 0.5) / (n + 1) if n else 0.5
        return RuleModel(log(share / (1 - share)), [], [])
    train = sample.select("label", array_to_vector(F.array(*NAMES)).alias("x"))
    forest = RandomForestClassifier(featuresCol="x", numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=5, subsamplingRate=0.7, featureSubsetStrategy="onethird", seed=seed).fit(train)
    found = sorted({narrowed(p) for t in forest.trees for p in paths(t.toDebugString)})
    held = sample.agg(*[F.count_if(condition(r)).alias(str(k)) for k, r in enumerate(found)]).first() if found else []
    rules = [r for r, h in zip(found, held, strict=True) if FEWEST <= h <= n - FEWEST] or found[:1]
    if not rules:
        return RuleModel(log(good / (n - good)), [], [])
    matrix = materialize(sample.select("label", F.array(*[F.when(condition(r), 1.0).otherwise(0.0) for r in rules]).alias("x")), "rules-matrix")
    lasso = LogisticRegression(featuresCol="x", elasticNetParam=1.0, regParam=PENALTY, maxIter=100).fit(matrix.select("label", array_to_vector("x").alias("x")))
    weights = [float(w) for w in lasso.coefficients]
    kept = [(r, w) for r, w in zip(rules, weights, strict=True) if w]
    return RuleModel(float(lasso.intercept), [r for r, _ in kept], [w for _, w in kept])


def scored(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """Per row: doc_id, ``_digest``, held_out, score and predicted."""
    measured = materialize(measure(docs), "rules-statistics")
    model = fit(measured, labels, rows)
    out = measured.withColumn("score", model.score())
    return out.select("doc_id", "_digest", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted."""
    return scored(docs, labels, rows).drop("_digest")


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """Rows whose predicted label is 1, in the input's columns.

    Texts are written once beside their statistics, so they are not measured twice.
    """
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), F.coalesce(F.col("text"), F.lit("")).alias("_text"), words(F.col("text")).alias("_words"))
    stats = [v.alias(k) for k, v in statistics(F.col("_text"), F.col("_words")).items()]
    whole = materialize(whole.select("_doc", *stats), "rules-documents")
    model = fit(whole.select(F.col("_doc.doc_id").alias("doc_id"), *NAMES), labels, rows)
    return whole.filter(model.score() >= THRESHOLD).select("_doc.*")
