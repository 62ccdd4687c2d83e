"""Recall of the approximate search over several full blocks, of which a shortlist is a small share."""

import numpy as np
from compare import connect

from corpusmill.llm import vector_search


def test_recall_beyond_the_shortlist():
    size = 3 * vector_search.BLOCK
    rows = connect("/root/testdata/check_l").execute(f"SELECT vec_id, embedding FROM embeddings ORDER BY hash(vec_id) LIMIT {size}").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    assert len(x) == size > vector_search.SAMPLE
    books = vector_search.fit(x[: vector_search.SAMPLE].astype(np.float32))
    codes, norms = vector_search.encode(x.astype(np.float32), books)
    asked = np.flatnonzero(ids % 20 == 0)[:100]
    best = vector_search.Best(ids[asked], x[asked], books, 20, "ip")
    for at in range(0, size, vector_search.BLOCK):
        own = slice(at, at + vector_search.BLOCK)
        best.add([[i] for i in ids[own].tolist()], x[own], codes[own], norms[own])
    hit = 0
    for q, (_, found) in zip(asked, best.held, strict=True):
        score = x @ x[q]
        score[q] = -np.inf
        hit += len(set(ids[np.lexsort((ids, -score))[:20]].tolist()) & set(found.tolist()))
    assert hit / (20 * len(asked)) >= 0.9
