"""Cosine top-k, retrieval per document set and the context text."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP_K, SEND_ALL = 6, 10
_EPS = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + _EPS) * (norm(b) + _EPS))


def cosine_top_k(vectors: DataFrame, query: DataFrame, k: int = TOP_K, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k nearest rows to a one-row ``query`` (column ``embedding``); ties by key.

    Each task keeps its own k best, so only k rows per task travel.
    """
    q = query.select(F.col("embedding").alias("q"))
    scored = vectors.withColumn("_q", q.scalar()).withColumn("similarity", cosine(F.col(embedding), F.col("_q")))
    return scored.drop("_q").orderBy(F.desc("similarity"), key).limit(k)


def retrieve(chunks: DataFrame, query: DataFrame, set_key: str = "doc_set", order: str = "chunk_id", k: int = TOP_K) -> DataFrame:
    """Per document set: every chunk when there are at most ten, else the k nearest; with ``rank``.

    The sets' sizes come from an aggregate; ranking keeps at most ten rows of a
    set per task before anything is shuffled.
    """
    q = query.select(F.col("embedding").alias("q"))
    sizes = chunks.groupBy(set_key).agg(F.count("*").alias("_n"))
    scored = chunks.withColumn("_q", q.scalar()).withColumn("similarity", cosine(F.col("embedding"), F.col("_q"))).drop("_q")
    near = Window.partitionBy(set_key).orderBy(F.desc("similarity"), order)
    best = scored.withColumn("_rank", F.row_number().over(near)).where(F.col("_rank") <= max(SEND_ALL, k)).join(sizes, set_key)
    kept = best.where((F.col("_n") <= SEND_ALL) | (F.col("_rank") <= k))
    in_order = Window.partitionBy(set_key).orderBy(order)  # at most ten rows each
    return kept.withColumn(
        "rank", F.when(F.col("_n") <= SEND_ALL, F.row_number().over(in_order)).otherwise(F.col("_rank"))
    ).drop("_rank", "_n")


def context_block(retrieved: DataFrame, set_key: str = "doc_set") -> DataFrame:
    """Ranked context text and the sorted pages it came from."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] (p."), F.coalesce(F.col("page").cast("string"), F.lit("?")),
                    F.lit(") "), F.col("text"))
    items = F.array_sort(F.collect_list(F.struct("rank", line.alias("t"))))
    return retrieved.groupBy(set_key).agg(
        F.array_join(F.transform(items, lambda s: s["t"]), "\n\n").alias("context"),
        F.sort_array(F.collect_set(F.when(F.col("page") != 0, F.col("page")))).alias("source_pages"),
        F.count("*").alias("chunks_used"),
    )
