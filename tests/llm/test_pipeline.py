"""The pipeline's stages: columns, whole inputs, and decisions that take effect."""

import pytest
from sumveil.llm import quality_rules, rule_classifier, simhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, outputs = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        outputs.append(corpus_pipeline.materialize(stage(spark, outputs[-1], SF), name.replace(" ", "-")))
    raw, ruled, good, unique, mixed, packed = outputs
    assert all(o.columns == columns for o in outputs[:-1])
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(ruled) == ids(quality_rules.verdicts(raw).filter("kept"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert ids(good) == ids(rule_classifier.classify(ruled, labels).filter("predicted = 1"))
    assert ids(unique) == ids(simhash.near_duplicates(good).filter("doc_id = component_id")) and unique.count() == len(ids(unique))
    assert ids(mixed) <= ids(unique)
    texts = {r.doc_id: r.text for r in unique.collect()}
    sizes, total = {}, {}
    for r in unique.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    for r in mixed.collect():
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        total[r.source] = total.get(r.source, 0) + len(r.text.split())
    assert abs(sum(total.values()) - 1.5 * sum(sizes.values())) <= len(sizes) + 1
    assert all(total[s] <= 2 * sizes[s] for s in total)
    assert packed.select("row_id").distinct().count() == mixed.count()
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in packed.filter("start = 0").collect())
