"""Each stage of the pipeline against a plain version, on the rows that the stage before it kept."""

import corpus_pipeline
import pytest

from corpusmill.llm import ngram_join, toxicity


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = (before, docs.collect())
        assert name == "mixture" or docs.columns == columns
    before, after = kept["lines"]
    sites = {}
    for r in before:
        for line in r["text"].split("\n"):
            sites.setdefault(line.strip(), set()).add(r["source"])
    common = {x for x, s in sites.items() if x and len(s) >= 8}
    want = {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if x.strip() not in common) for r in before}
    assert {r["doc_id"]: r["text"] for r in after} == want
    before, after = kept["near_duplicates"]
    groups = ngram_join.brute([(r["doc_id"], r["text"]) for r in before], 5, 80)
    assert sorted(r["doc_id"] for r in after) == sorted(d for d, (_, c) in groups.items() if c == d)
    before, after = kept["benchmark"]
    items = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert not [r for r in after if any(i in r["text"] for i in items)]
    before, after = kept["mixture"]
    words = {r["doc_id"]: len(r["text"].split()) for r in before}
    assert {r["copy_no"] for r in after} <= {1, 2} and sum(words[r["doc_id"]] for r in after) == pytest.approx(1.5 * sum(words.values()), rel=0.1)


def test_toxic_documents_go(spark):
    root = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    left = toxicity.drop_toxic(docs, toxicity.fit(docs, labels)).select("doc_id").join(labels, "doc_id").groupBy("toxic").count()
    all_ = docs.select("doc_id").join(labels, "doc_id").groupBy("toxic").count()
    left, all_ = ({r[0]: r[1] for r in x.collect()} for x in (left, all_))
    assert left.get(1, 0) < 0.3 * all_[1] and left[0] > 0.98 * all_[0]
