"""Nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables for each operator."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import decontaminate, html_text, line_dedup, mixing, ngram_join, secret_scan, substrings, toxicity, url_filter, vector_search
from corpusmill.llm.common import components
from corpusmill.llm.near_duplicates import keep_one

LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
ODD = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "a"), (1, "alpha beta gamma delta epsilon zeta", "en", "a"), (2, "ALPHA beta gamma delta epsilon zeta", None, None),
    (3, None, "de", "b"), (4, "", "de", "b"), (None, "alpha beta gamma delta epsilon zeta", "en", "a"), (5, "   \n\t ", "fr", None), (6, LONG, "fr", "c"), (7, LONG + " tail", "fr", "c"), (8, "one", "es", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    """Also with columns named like those that operators use inside."""
    df = spark.createDataFrame(ODD, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in ("doc", "hash", "key", "size", "target", "copies", "spans", "label", "score", "n", "row", "live", "kept_text", "_row", "copy_no", "line")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substrings(odd, none):
    got = {(r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.substring_dedup(odd, window=5, gram=3).collect()}
    assert got == {(1, 6, 0), (1, 6, 6), (2, 6, 5), (3, 0, 0), (4, 0, 0), (None, 6, 6), (5, 0, 0), (6, 30_000, 0), (7, 30_001, 30_000), (8, 1, 0)}
    assert substrings.substring_dedup(none).count() == 0


def test_substrings_in_one_document_and_of_one_id(spark):
    passage = " ".join(f"p{i}" for i in range(8))
    df = spark.createDataFrame([(1, f"{passage} x {passage}"), (1, f"y {passage}"), (2, passage)], "doc_id long, text string")
    got = sorted(tuple(r)[:3] for r in substrings.substring_dedup(df, window=5, gram=3).collect())
    # which of the two texts of document 1 comes first is decided by a digest
    assert got[2] == (2, 8, 8) and sum(r[2] for r in got[:2]) == 16


def test_jaccard_groups(odd, none):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.similarity_groups(odd).collect()), key=str)
    assert got == sorted([(1, 4, 1), (1, 4, 1), (2, 4, 1), (3, 0, 3), (4, 0, 4), (None, 4, None), (5, 0, 5), (6, 29_998, 6), (7, 29_999, 6), (8, 1, 8)], key=str)
    assert ngram_join.similarity_groups(none).count() == 0
    kept = keep_one(odd, 3, 90)
    assert kept.columns == odd.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 3, 4, 5, 6, 8, None]


def test_large_families_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 15)
    rng, rows = np.random.default_rng(1), []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(60)]
        for _ in range(40):
            words = list(base)
            for at in rng.choice(60, rng.integers(0, 5), replace=False):
                words[at] = f"e{rng.integers(1e9)}"
            rows.append((len(rows), " ".join(words)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similarity_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect()}
    assert got == ngram_join.brute(rows, 3, 80)


def test_keys_are_held_pass_after_pass(spark, monkeypatch):
    """Keys that documents share aren't on disk all at once, and each key is looked at in one pass."""
    monkeypatch.setattr(ngram_join, "PASS_BYTES", 1000, raising=False)
    rng, rows, held = np.random.default_rng(7), [], []
    passage = [f"p{i}" for i in range(200)]
    for doc in range(90):
        words = [*passage, *(f"g{doc // 3}w{i}" for i in range(120))]
        for at in rng.choice(320, 12, replace=False):
            words[at] = f"e{rng.integers(1e9)}"
        rows.append((doc, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    checkpoint = type(df).checkpoint

    def counted(self, *args):
        out = checkpoint(self, *args)
        if "key" in out.columns and "point" not in out.columns:
            held.append(out.count())
        return out

    monkeypatch.setattr(type(df), "checkpoint", counted)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similarity_groups(df, 5, 80).collect()}
    assert got == ngram_join.brute(rows, 5, 80)
    keys = np.concatenate([ngram_join.class_keys(s, 80) >> np.uint64(20) for _, s in ngram_join._sets([text for _, text in rows], 5)]).astype(np.int64)
    _, of, count = np.unique(keys, return_inverse=True, return_counts=True)
    shared = int((count[of] > 1).sum())
    assert shared > 1000 and max(held) < 0.4 * shared
    whole = spark.createDataFrame([(doc, text) for doc, text in rows], "doc long, text string")
    dealt = [r["key"] for at in range(5) for r in whole.coalesce(1).mapInArrow(ngram_join._key_rows(5, 80, at, 4), "key long, doc long, pivot long").where("pivot is null").collect()]
    assert sorted(dealt) == sorted(keys.tolist())


def test_a_shared_passage_makes_no_family(spark, monkeypatch):
    """Unrelated documents of many words that share a passage aren't candidates of each other, whatever their number."""

    def divided(*_):
        raise AssertionError("a family of unrelated documents")

    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 15)
    monkeypatch.setattr(ngram_join, "PART_ROWS", 500)
    monkeypatch.setattr(ngram_join, "_divided", divided)
    rng, passage = np.random.default_rng(4), [f"p{i}" for i in range(60)]
    texts = [[*passage, *(f"d{doc}w{i}" for i in range(500 + 3 * doc))] for doc in range(60)]
    for of in (0, 7, 7, 30, 59):
        copy = list(texts[of])
        for at in rng.choice(len(copy), 9, replace=False):
            copy[at] = f"e{rng.integers(1e9)}"
        texts.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similarity_groups(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert got == ngram_join.brute(rows, 5, 80)


def test_linked_sets_share_a_class():
    rng = np.random.default_rng(2)
    for size in (1, 2, 5, 9, 18, 19, 20, 57, 300):
        a = rng.integers(0, 1 << 62, size, dtype=np.uint64)
        for percent in (80, 90):
            for _ in range(30):
                b = a[rng.permutation(size)[: max(1, int(np.ceil(size * percent / 100)))]]
                assert np.isin(ngram_join.class_keys(np.unique(a), percent), ngram_join.class_keys(np.unique(b), percent)).any()


def test_lines(spark, odd, none):
    out = line_dedup.line_dedup(odd)
    assert out.count() == len(ODD) and {(r["doc_id"], r["n_lines"]) for r in out.where("doc_id in (3, 4, 5)").collect()} == {(3, 0), (4, 1), (5, 2)}
    assert line_dedup.line_dedup(none).count() == 0
    rows = [(i, f"own {i}\n  boiler plate \nshared\n\nend {i}", f"s{i % 9}" if i < 9 else "s0") for i in range(20)] + [(20, "boiler plate", None)]
    rows = [(i, t if i < 7 or i > 8 else t.replace("shared", "other"), s) for i, t, s in rows]
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0]["kept_text"] == "own 0\nshared\n\nend 0" and got[0]["n_removed"] == 1
    assert (got[20]["kept_text"], got[20]["n_removed"]) == ("", 1)


def test_near_threshold_counts_are_exact(spark):
    rows = [(h, 1, f"s{i}") for h, n in ((1, 7), (2, 8), (3, 9), (4, 400)) for i in range(n) for _ in range(3)]
    got = line_dedup.boilerplate(spark.createDataFrame(rows, "hash long, length int, site string"))
    assert sorted(r["hash"] for r in got.collect()) == [2, 3, 4]


def test_secrets(spark, odd, none):
    assert secret_scan.secret_scan(odd).count() == len(ODD)
    assert secret_scan.secret_scan(none).count() == 0
    opaque = "Ab1" + "cD2_" * 7
    rows = [
        (1, f'é token = "abcdef" API_KEY:x Secret=123456', "a"), (2, "AKIA" + "A" * 15 + " AKIA" + "B" * 16, "a"), (3, "f" * 23 + "g" + "0" * 24, "a"),
        (4, f"{opaque} here", "a"), (5, f"{opaque} there", "a"), (6, None, None), (7, "password=token: abcdefghi", "a"),
    ]
    rows += [(10 + i, "Xy9" + "zZ8-" * 7, f"r{i}") for i in range(4)]
    got = {r["doc_id"]: r for r in secret_scan.secret_scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1]["spans"] == "assign:2:17,assign:29:42" and got[1]["n_assign"] == 2
    assert (got[2]["spans"], got[3]["spans"]) == ("access:20:40", "hex:24:48")
    assert got[4]["spans"] == got[5]["spans"] == "opaque:0:31" and got[10]["spans"] == "" and got[10]["n_example"] == 1
    assert (got[6]["spans"], got[7]["n_assign"]) == ("", 0)


def test_mixing(odd, none):
    got = mixing.copies(odd, keep=("lang", "target")).collect()
    assert len(got) == len(ODD) and all(r["copies"] == 0 for r in got if r["size"] == 0)
    sources = {r["source_size"]: r["target"] for r in got}
    assert sum(sources.values()) == pytest.approx(1.5 * sum(r["size"] for r in got))
    assert mixing.mix(none).count() == 0
    out = mixing.mix(odd)
    assert out.columns[-1] == "copy_no" and set(out.columns) == set(odd.columns)


def test_targets_share_what_full_sources_leave(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 100)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    # a is full at 20; the rest of 3165 goes 2 : 1 : 5 to b, c and the last, which is full at 200; then 2 : 1
    assert got["a"] == 20 and got[None] == 200 and got["b"] == pytest.approx(2945 * 2 / 3) and got["c"] == pytest.approx(2945 / 3)


def test_urls(spark):
    rows = [(1, "http://Example.ORG/es/a?b"), (2, "https://example.org/en/12"), (3, "x://www.example.org/en/2#f"), (4, "http://shop.com/de/"), (5, "http://notorg/x"), (6, None), (7, "nourl"), (8, "http://org"), (None, "http://com/fr/1"), (9, "http://a.net/en"), (9, "http://a.net/en"), (10, "")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("z"), "label": F.lit("z"), "score": F.lit("z")})
    got = url_filter.url_filter(df).collect()
    by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert len(got) == len(rows)
    assert by[1] == ("example.org", "/es/a", "example.org/es/", "block") and by[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert by[3] == ("www.example.org", "/en/2", "org/", "allow") and by[4] == ("shop.com", "/de/", "com/de/", "block")
    assert by[5][2] is None and by[6][:3] == by[7][:3] == ("", "", None) and by[8][:3] == ("org", "", None) and by[None][3] == "allow"
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.url_filter(empty).count() == 0
    alone = url_filter.url_filter(spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")).collect()
    assert alone[0]["verdict"] in ("allow", "block")


def test_vectors(spark):
    bad = [(90, None), (91, [0.0, 0.0]), (92, [float("nan"), 1.0]), (93, [float("inf"), 1.0]), (94, [1.0, None]), (95, [1.0]), (None, [1.0, 1.0])]
    rows = [(i, [1.0, 0.0]) for i in range(50)] + [(100 + i, [0.5, float(i)]) for i in range(5)] + [(0, [1.0, 0.0])] + bad
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    got = vector_search.nearest(df, F.col("vec_id") % 20 == 0, k=4).collect()
    by = {q: [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] for q in (0, 20, 40, 100)}
    assert by == {0: [1, 2, 3, 4], 20: [0, 1, 2, 3], 40: [0, 1, 2, 3], 100: [0, 1, 2, 3]}
    few = vector_search.nearest(df.where("vec_id in (0, 100, 101)"), F.col("vec_id") == 0, k=4)
    assert [r["vec_id"] for r in few.orderBy("rank").collect()] == [100, 101]
    assert vector_search.nearest(df.where("vec_id = 91"), F.lit(True)).count() == 0


def test_encoding_is_close():
    x = np.random.default_rng(0).normal(size=(2000, 16)).astype(np.float32)
    books = vector_search.fit(x, books=4, words=32)
    codes, norms = vector_search.encode(x, books)
    near = books[np.arange(4), codes].sum(1)
    assert ((x - near) ** 2).sum() < 0.6 * (x**2).sum() and np.allclose(norms, (near**2).sum(1), rtol=1e-3)


def test_decontamination(spark, odd, none):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, "ONE"), (3, None), (4, "..."), (5, LONG[:50])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(odd, items).collect()}
    assert got == {(1, 1), (2, 1), (None, 1), (8, 2), (6, 5), (7, 5)}
    assert decontaminate.contaminated(none, items).count() == 0 and decontaminate.contaminated(odd, items.limit(0)).count() == 0
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(odd, items).collect()) == [3, 4, 5]


def test_reordered_passages_are_found():
    item = list(range(30))
    doc = [99, *item[15:], 98, *item[:15], 97]
    assert sum(t[2] for t in decontaminate.tiles(item, doc)) == 30
    assert decontaminate.tiles(item, [99, *item[:4], 98], 5) == []
    # the longest match is marked first, and no word twice
    assert decontaminate.tiles([1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 9, 1, 2, 3, 4, 5, 6], 5) == [(0, 6, 6)]


def test_toxicity(spark, odd, none):
    train = [(i, ("kind words here " * 5 + ("vile " if i % 2 else "nice ") + "and so on") if i % 3 else ("vile" if i % 2 else "nice"), "en") for i in range(300)]
    docs = spark.createDataFrame(train, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic")).union(spark.createDataFrame([(None, 1), (5, None)], "doc_id long, toxic long"))
    model = toxicity.fit(docs, labels)
    scores = model.score(["so vile", "so nice", "", None, "nice " * 60_000 + "vile"])
    assert scores[0] > 0.5 > scores[1] and scores[2] == scores[3] and 0 <= scores[4] <= 1
    assert toxicity.toxicity(odd, model).count() == len(ODD) and toxicity.toxicity(none, model).count() == 0
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    blank = toxicity.fit(none, labels.limit(0))
    assert blank.score(["x", None]).tolist() == [0.5, 0.5]


def test_html(spark):
    page = "<html><head><title>t</title></head><body><header>top</header><nav><a href='/'>home</a></nav><div class='cookie-notice'>we use cookies</div><div id=main><h1>Head&amp;line</h1>" + "<p>A long paragraph of the article with  many\n words in it." * 6 + "<p>Short.</div><aside>side</aside><div class=comments><p>I say</div><footer>&copy; x</footer></body></html>"
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "plain &lt;text&gt;"), (4, "x", "<p>broken <b>bold words<p>next words follow <script>var a='</p>';"), (4, "x", "<article><p>a<div class=ad>buy</div><p>b</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = [r["text"] for r in html_text.main_text(df).collect()]
    assert got[0] == "Head&line\n" + "A long paragraph of the article with many words in it.\n" * 6 + "Short."
    assert got[1:] == ["", "", "plain <text>", "broken bold words\nnext words follow", "a\nb"]
    assert html_text.main_text(df.limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 7), (None, 1), (9, 8)], "a long, b long")
    assert sorted(tuple(r) for r in components(edges).collect()) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (8, 8), (9, 8)]
    assert components(edges.limit(0)).count() == 0


def test_secrets_in_long_texts(spark):
    """As many hits as make a quadratic scan take minutes; planted live and copied tokens."""
    many = " ".join(f"token={i:06d}x Zq{i:06d}Ab{i:06d}Cd{i:06d}" for i in range(50_000))
    live, copied, slug = "qW3_" * 7, "Er5-" * 7, "my-favourite-places-in-2024-and-after"
    rows = [(1, many, "a"), (2, f"{live} {copied} {slug}", "a"), *((10 + i, f"see {copied}", f"s{i}") for i in range(5))]
    got = {r["doc_id"]: r for r in secret_scan.secret_scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1]["n_assign"] == 50_000 and got[1]["spans"].count("opaque") == 50_000
    last = got[1]["spans"].split(",")[-1].split(":")
    assert int(last[2]) == len(many)
    # of three tokens, one is live, one an example, one names something
    assert got[2]["spans"] == f"opaque:0:{len(live)}" and got[2]["n_example"] == 1 and got[12]["spans"] == ""
