"""Pages, byte budgets, chunks and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a page, of one without a limit, and the largest offset.
DEFAULT, MOST, LAST = 100, 10_000, 1_000_000


def page(df: DataFrame, *order, offset: int = 0, limit: int | None = None, count: int | None = None) -> DataFrame:
    """The rows of a page; limit goes before count, 0 asks for all up to MOST."""
    size = limit if limit is not None else count if count is not None else DEFAULT
    return df.orderBy(*order).offset(min(max(0, offset), LAST)).limit(MOST if size == 0 else min(size, MOST))


def page_info(df: DataFrame, offset: int, size: int) -> DataFrame:
    """total, has_more, next_offset, prev_offset, current_page, total_pages: one row."""
    total = F.count("*")
    size = MOST if size == 0 else size
    return df.agg(
        total.alias("total"), (total > offset + size).alias("has_more"), F.when(total > offset + size, F.lit(offset + size)).alias("next_offset"),
        F.lit(max(0, offset - size) if offset else None).cast("int").alias("prev_offset"), F.lit(offset // size + 1).alias("current_page"),
        F.ceil(total / size).alias("total_pages"),
    )


def search_window(df: DataFrame, offset: int = 0, count: int | None = None) -> DataFrame:
    """total, returned, next_offset (always present), has_more of a search page of 50 rows, 200 at most: one row."""
    size = min(200, max(1, count if count is not None else 50))
    total = F.count("*")
    returned = F.greatest(F.least(total - offset, F.lit(size)), F.lit(0))
    return df.agg(total.alias("total"), returned.alias("returned"), (returned + offset).alias("next_offset"), (total > returned + offset).alias("has_more"))


def top_n(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group; the planner cuts groups before it shuffles them."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def pack(items: DataFrame, by: str, order: str, size: str, budget: int) -> DataFrame:
    """by, order, page, oversize: items put greedily on pages of a byte budget; a larger item has a page of its own.

    A page begins where the last ended, so items of one group are read in order; groups are independent.
    """
    import pandas as pd

    def run(batches):
        state = (None, 0, 0)
        for pdf in batches:
            pages, over = [], []
            for group, n in zip(pdf[by], pdf[size], strict=True):
                last, at, used = state
                if group != last:
                    at, used = 0, 0
                elif used + n > budget:
                    at, used = at + 1, 0
                state = (group, at, used + n)
                pages.append(at)
                over.append(bool(n > budget))
            yield pd.DataFrame({by: pdf[by], order: pdf[order], "page": pages, "oversize": over})

    rows = items.select(by, order, size).repartition(by).sortWithinPartitions(by, order)
    kinds = dict(items.dtypes)
    return rows.mapInPandas(run, f"{by} {kinds[by]}, {order} {kinds[order]}, page int, oversize boolean")


def chunks(rows: DataFrame, key: str, text: str, size: int = 8000) -> DataFrame:
    """key, chunk, bytes, text: texts cut into pieces of at most size UTF-8 bytes, never within a character."""
    import pandas as pd

    def cut(raw: bytes) -> list[str]:
        out, at = [], 0
        while at < len(raw):
            end = min(at + size, len(raw))
            while end < len(raw) and raw[end] & 0xC0 == 0x80:
                end -= 1
            out.append(raw[at:end].decode())
            at = end
        return out or [""]

    def run(batches):
        for pdf in batches:
            found = [(k, i, len(c.encode()), c) for k, t in zip(pdf[key], pdf[text], strict=True) if t is not None for i, c in enumerate(cut(t.encode()))]
            yield pd.DataFrame(found, columns=[key, "chunk", "bytes", "text"])

    return rows.select(key, text).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, chunk int, bytes int, text string")


def chunk_plan(jobs: DataFrame) -> DataFrame:
    """total, start, chunk (bytes) to offset, len, is_final of each transfer; an empty final one when all is done."""
    start = F.least(F.col("start"), F.col("total"))
    n = F.greatest(F.ceil((F.col("total") - start) / F.col("chunk")), F.lit(1)).cast("long")
    at = jobs.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    offset = start + F.col("i") * F.col("chunk")
    size = F.least(F.col("chunk"), F.col("total") - offset)
    return at.select("total", "start", "chunk", offset.alias("offset"), size.alias("len"), (offset + size >= F.col("total")).alias("is_final"))


def evict(groups: DataFrame, quota: int, current: str, low: float = 0.8) -> DataFrame:
    """hash, size, last_used of the cache entries to drop: the oldest but the current one until low * quota is left."""
    every = Window.partitionBy(F.lit(1))
    order = Window.orderBy(F.col("last_used").asc_nulls_first(), "hash").rowsBetween(Window.unboundedPreceding, -1)
    total = groups.withColumn("total", F.sum("size").over(every)).where(F.col("hash") != current)
    freed = F.coalesce(F.sum("size").over(order), F.lit(0))
    return total.withColumn("freed", freed).where((F.col("total") > quota) & (F.col("total") - F.col("freed") > low * quota)).select("hash", "size", "last_used")


def dense_ids(df: DataFrame, name: str, prefix: int = 6) -> DataFrame:
    """df with class_no, the position of a name in order, from 0. Names are numbered within prefixes, after a count of each
    prefix, so no task sorts all of them."""
    head = F.substring(F.col(name), 1, prefix)
    counts = df.groupBy(head.alias("_head")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_head", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_head").orderBy(name))
    out = df.withColumn("_head", head).withColumn("_nth", nth).join(offsets, "_head")
    return out.withColumn("class_no", F.col("_before") + F.col("_nth") - 1).drop("_head", "_nth", "_before")


def clamp(value: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))
