"""Near-duplicate removal on top of the n-gram Jaccard join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ngram_join import WORD, similarity_groups

#: Ids that are broadcast at most; beyond that texts and ids are both shuffled.
BROADCAST = 500_000


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, one of each group of linked documents: that of the smallest doc_id.

    Rows with a null doc_id all stay. Of rows that repeat a doc_id one stays, one with words if there is any. Texts without words are alone in
    their groups and stay. Columns and their order are those of docs. Only ids of rows to drop meet the texts.
    """
    groups = similarity_groups(docs, n, percent).where("doc_id is not null")
    ids = groups.groupBy("doc_id").agg(F.count("*").alias("rows"), F.bool_or(F.col("component_id") < F.col("doc_id")).alias("copy")).checkpoint()
    gone = ids.where("copy or rows > 1").select("doc_id")
    # names of this operator, so that those of docs cannot clash with them
    own = docs.select(F.col("doc_id"), *(F.col(c).alias(f"k_{c}") for c in docs.columns))
    kept = own.join(F.broadcast(gone) if gone.count() <= BROADCAST else gone, "doc_id", "left_anti").drop("doc_id")
    repeated = ids.where("not copy and rows > 1").select("doc_id")
    if repeated.limit(1).count():
        worded = F.coalesce(F.col("k_text").rlike(WORD), F.lit(False))
        order = Window.partitionBy("doc_id").orderBy(F.desc(worded), F.md5(F.coalesce("k_text", F.lit(""))))
        first = own.join(repeated, "doc_id", "left_semi").withColumn("nth", F.row_number().over(order)).where("nth = 1")
        kept = kept.union(first.select(kept.columns))
    return kept.select(*(F.col(f"k_{c}").alias(c) for c in docs.columns))
