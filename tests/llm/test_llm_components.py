"""Components of graphs with long ways between their nodes."""

import numpy as np

from corpusmill.llm.common import components


def test_long_paths_with_shuffled_ids(spark):
    ids = np.random.default_rng(3).permutation(3000).tolist()
    paths = [ids[:500], ids[500:1000], sorted(ids[1000:2000]), sorted(ids[2000:])[::-1]]
    edges = [(p[i], p[i + 1]) for p in paths for i in range(len(p) - 1)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: min(p) for p in paths for x in p}
