"""Repeated ids of which one text has no words."""

from corpusmill.llm import ngram_join
from corpusmill.llm.near_duplicates import keep_one

ROWS = [
    (1, ""), (2, ""), (2, "alpha beta gamma delta epsilon zeta"), (3, None), (3, "one two three four five six"), (4, " \n"), (5, " \n"),
    (5, "red green blue white black grey"), (6, "alpha beta gamma delta epsilon zeta"),
]


def test_texts_without_words_link_nothing(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = sorted(tuple(r) for r in ngram_join.similarity_groups(df).collect())
    assert got == [(1, 0, 1), (2, 0, 2), (2, 4, 2), (3, 0, 3), (3, 4, 3), (4, 0, 4), (5, 0, 5), (5, 4, 5), (6, 4, 2)]


def test_ids_keep_their_text(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert sorted(tuple(r) for r in keep_one(df).collect()) == [(1, ""), (2, ROWS[2][1]), (3, ROWS[4][1]), (4, " \n"), (5, ROWS[7][1])]
