"""The queries against their SQL, or a brute-force version, on the smallest tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from compare import connect, same

from corpusmill.llm import ngram_join, queries, substrings

DOCS = "SELECT doc_id, text FROM documents"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, small, name):
    assert same(queries.QUERIES[name](spark, small), queries.SQL[name], small) > 0


def test_all_are_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES if n != "pipeline"} == set(range(1, 11))


def test_substrings_equal_brute_force(spark, small):
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op7_substring_dedup"](spark, small).collect()}
    assert got == substrings.brute(connect(small).execute(DOCS).fetchall())


def test_jaccard_groups_equal_brute_force(spark, small):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op10_ngram_jaccard_join"](spark, small).collect()}
    assert got == ngram_join.brute(connect(small).execute(DOCS).fetchall())


def test_search_recall_and_scores(spark, small):
    got = queries.QUERIES["op5_nearest"](spark, small).collect()
    rows = connect(small).execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        score = x @ x[ids == q][0]
        best = [i for i in ids[np.lexsort((ids, -score))] if i != q][:20]
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert all(abs(r["score"] - score[ids == r["vec_id"]][0]) < 1e-12 for r in own)
        hit, total = hit + len(set(best) & {r["vec_id"] for r in own}), total + 20
    assert hit / total >= 0.9


def test_decontamination_finds_every_whole_item(spark, small):
    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op3_decontaminate"](spark, small).collect()}
    whole = connect(small).execute("SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(d.text, b.text)").fetchall()
    assert whole and set(whole) <= got


def test_toxicity_contract(spark, small):
    got = queries.QUERIES["op6_toxicity"](spark, small).collect()
    assert len(got) == 200 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_held_out_toxicity(spark):
    root = "/root/testdata/sf0.1"
    labels = dict(connect(root).execute("SELECT doc_id, toxic FROM labels").fetchall())
    held = [r for r in queries.QUERIES["op6_toxicity"](spark, root).collect() if r["held_out"] and r["doc_id"] in labels]
    truth, said = np.array([labels[r["doc_id"]] for r in held]), np.array([r["predicted"] for r in held])
    assert (truth == said).mean() > 0.97 and said[truth == 1].mean() > 0.7


def test_html_text(spark, small):
    pages = {r["page_id"]: r for r in queries.QUERIES["op9_html_text"](spark, small).collect()}
    for page_id, html in connect(small).execute("SELECT page_id, html FROM pages").fetchall():
        inner = re.search(r"(?s)<article>(.*)</article>", html)[1]
        words = re.sub(r"<[^>]*>", " ", inner).split()
        import html as h

        assert pages[page_id]["text"].split() == h.unescape(" ".join(words)).split()
        assert pages[page_id]["n_chars"] == len(pages[page_id]["text"])


def test_secret_spans_stand_where_they_say(spark, small):
    texts = dict(connect(small).execute(DOCS).fetchall())
    kinds = {"assign": r"(?i)^(password|passwd|secret|token|api_?key)", "access": "^AKIA[A-Z0-9]+$", "hex": "^[0-9a-f]{24,}$", "opaque": "^[A-Za-z0-9_-]{24,}$"}
    for r in queries.QUERIES["op4_secret_scan"](spark, small).collect():
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        for kind, start, end in spans:
            assert re.search(kinds[kind], texts[r["doc_id"]][int(start) : int(end)])
        base = ",".join(":".join(s) for s in spans if s[0] != "opaque")
        assert hashlib.sha256(base.encode()).hexdigest() == r["base_sha256"]


def test_mix_comes_near_its_targets(spark, small):
    by = {}
    for r in queries.QUERIES["op2_mix_sources"](spark, small).join(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source"), "doc_id").collect():
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], [r["target"], 0, 0])
        by[r["source"]][1] += r["taken"]
        by[r["source"]][2] = max(by[r["source"]][2], r["size"])
    assert all(abs(taken - target) <= largest + 1 for target, taken, largest in by.values())
