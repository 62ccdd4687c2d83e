"""Greedy string tiling against a plain version, and texts that repeat a word."""

import time

import numpy as np
from compare import connect

from corpusmill.llm import decontaminate
from corpusmill.llm.queries import QUERIES


def test_all_pairs_equal_brute_force(spark, small):
    c = connect(small)
    docs, items = (c.execute(q).fetchall() for q in ("SELECT doc_id, text FROM documents", "SELECT item_id, text FROM benchmark"))
    words = {i: len(decontaminate.Words([t.encode()], letters=True).hash) for i, t in items}
    got = {(r["doc_id"], r["item_id"], round(r["coverage"] * words[r["item_id"]]), r["n_tiles"]) for r in QUERIES["op3_decontaminate"](spark, small).collect()}
    assert got and got == decontaminate.brute(docs, items)


def test_random_sequences_equal_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(60):
        a, b = (rng.integers(0, 3, rng.integers(3, 25)).tolist() for _ in "ab")
        found = decontaminate.tiles(a, b, 3)
        text = [" ".join(f"w{x}" for x in s) for s in (a, b)]
        want = decontaminate.brute([(1, text[1])], [(1, text[0])], 3, 0.01)
        assert want == ({(1, 1, sum(t[2] for t in found), len(found))} if found else set())


def test_repeated_words_take_bounded_time():
    began = time.time()
    index = decontaminate.Index([(i, "same " * 60 + f"end{i}") for i in range(20)], 5)
    assert len(list(index.matches(["same " * 40_000, "other " * 40_000], 0.6))) == 20
    assert sum(t[2] for t in decontaminate.tiles([7] * 5_000, [7] * 8_000)) == 5_000
    assert time.time() - began < 20
