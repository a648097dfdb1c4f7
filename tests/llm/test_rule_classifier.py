"""Rule ensemble: held-out accuracy, rules against Python, and odd inputs."""

import math
import zlib

from sumveil.llm import rule_classifier as rc

SF = "/root/testdata/sf0.01"
DOCS, LABELS = "doc_id long, text string, label int, score string, lang string", "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = rc.classify(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert sum(r.predicted == r.quality for r in held) >= 0.97 * len(held)
    good = [r for r in held if r.quality]
    assert sum(r.predicted for r in good) >= 0.98 * len(good)


def test_labels_that_are_held_out_do_not_matter(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    measured = rc.measure(docs)
    other = labels.withColumn("quality", rc.F.when(rc.held_out(rc.F.col("doc_id")), 1 - rc.F.col("quality")).otherwise(rc.F.col("quality")))
    a, b = rc.fit(measured, labels), rc.fit(measured, other)
    assert a.rules == b.rules and all(math.isclose(x, y, rel_tol=1e-6) for x, y in zip(a.weights, b.weights))


def test_compiled_score_and_paths(spark):
    tree = "DecisionTree\n  If (feature 0 <= 1.5)\n   If (feature 1 <= 2.0)\n    Predict: 0.0\n   Else (feature 1 > 2.0)\n    Predict: 1.0\n  Else (feature 0 > 1.5)\n   Predict: 1.0\n"
    assert rc.paths(tree) == [((0, "<=", 1.5),), ((0, "<=", 1.5), (1, "<=", 2.0)), ((0, "<=", 1.5), (1, ">", 2.0)), ((0, ">", 1.5),)]
    assert rc.narrowed([(0, "<=", 3.0), (1, ">", 1.0), (0, "<=", 2.0)]) == ((0, "<=", 2.0), (1, ">", 1.0))
    model = rc.RuleModel(0.5, [((0, "<=", 1.5),), ((0, ">", 1.0), (1, "<=", 2.0))], [2.0, -1.0])
    frame = spark.createDataFrame([(x, y) for x in (0.0, 1.2, 9.0) for y in (0.0, 3.0)], "log_words double, word_length double")
    for r in frame.withColumn("p", model.score()).collect():
        z = 0.5 + 2.0 * (r.log_words <= 1.5) - (r.log_words > 1.0 and r.word_length <= 2.0)
        assert math.isclose(r.p, 1 / (1 + math.exp(-z)))


def test_odd_rows_and_missing_labels(spark):
    docs = spark.createDataFrame([(1, None, 1, "s", "x"), (2, "", 1, None, None), (None, "Some text. More!", 1, "", ""), (3, "a " * 100_000, 1, "", ""), (3, "a " * 100_000, 1, "", "")], DOCS)
    none, one = spark.createDataFrame([], LABELS), spark.createDataFrame([(1, 1, 0), (4, None, 0), (None, 0, 0)], LABELS)
    assert {r.score for r in rc.classify(docs, none).collect()} == {0.5}
    rows = rc.classify(docs, one).collect()
    assert len(rows) == 5 and all(r.score >= 0.7 and r.predicted == 1 for r in rows)
    assert rc.keep_good(docs, one).count() == 5 and rc.keep_good(docs, none).count() == 0 and rc.keep_good(docs, one).columns == docs.columns
    assert rc.classify(spark.createDataFrame([], DOCS), one).count() == 0
