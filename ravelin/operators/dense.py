"""Exact dense retrieval: a stated, small set of query vectors against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ravelin.functions.text import dot

MOST_QUERIES = 1024


def dense_topk(queries: dict[int, list[float]], vectors: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """Top k by inner product of each query: ``(q_ord, key, score, rank)``; ties by key.

    The queries are literals of the plan (``MOST_QUERIES`` at most), so every row is scored where
    it is read, and each task keeps k rows a query before anything is shuffled. Vectors of
    another size, null vectors and null keys are left out.
    """
    if len(queries) > MOST_QUERIES:
        raise ValueError(f"at most {MOST_QUERIES} queries at once")
    dim = len(next(iter(queries.values()))) if queries else 0
    asked = F.array(*[F.struct(F.lit(q).alias("q_ord"), F.array(*[F.lit(float(x)) for x in v]).alias("q")) for q, v in sorted(queries.items())])
    usable = vectors.select(key, F.col(vector).alias("v")).filter(F.col(key).isNotNull() & (F.size("v") == dim))
    scored = usable.select(key, "v", F.explode(asked).alias("a")).select(F.col("a.q_ord").alias("q_ord"), key, F.round(dot(F.col("v"), F.col("a.q")), 6).alias("score"))
    order = W.partitionBy("q_ord").orderBy(F.col("score").desc(), key)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def dense_search(queries: dict[int, list[float]], vectors: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """``dense_topk`` of any number of queries: in blocks of ``MOST_QUERIES``, each a pass over the vectors."""
    listed = sorted(queries.items())
    blocks = [dict(listed[at : at + MOST_QUERIES]) for at in range(0, max(1, len(listed)), MOST_QUERIES)]
    found = [dense_topk(block, vectors, key, vector, k) for block in blocks]
    for more in found[1:]:
        found[0] = found[0].unionByName(more)
    return found[0]
