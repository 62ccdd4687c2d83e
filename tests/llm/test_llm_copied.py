"""Documents that were copied to many sources."""

import corpus_pipeline


def test_copied_document_keeps_its_text(spark):
    article = "first line of the article\nsecond line of it\nand a third one"
    rows = [(i, article, "en", f"s{i}", len(article)) for i in range(12)]
    rows += [(20 + i, f"own words {i}\nall rights reserved\nmore words {i}", "en", f"s{i}", 40) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    cleaned = corpus_pipeline.lines(spark, docs, None)
    got = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert all(got[i] == article for i in range(12))
    assert all(got[20 + i] == f"own words {i}\nmore words {i}" for i in range(9))
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.near_duplicates(spark, cleaned, None).collect()}
    assert sorted(kept) == [0, *range(20, 29)] and kept[0] == article
