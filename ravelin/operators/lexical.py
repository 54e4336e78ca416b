"""BM25 over an inverted table of postings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from ravelin.functions.text import bm25_tokens

K1, B, EPSILON = 1.5, 0.75, 0.25


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, term, tf)``; terms are counted before the shuffle."""
    return docs.select(key, F.explode(bm25_tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def index_postings(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``(keys, term, tf, dl)``: postings that carry the length of their text, as an index stores them."""
    tokens = docs.select(*keys, bm25_tokens(F.col(text)).alias("tokens")).select(*keys, F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    return tokens.groupBy(*keys, "dl", "term").agg(F.count(F.lit(1)).alias("tf")).select(*keys, "term", "tf", "dl")


def lengths(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.size(bm25_tokens(F.col(text))).alias("dl"))


def corpus_stats(docs: DataFrame, text: str) -> DataFrame:
    """One row: number of documents and their mean length in tokens."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size(bm25_tokens(F.col(text)))).alias("avgdl"))


def term_stats(posts: DataFrame, stats: DataFrame) -> DataFrame:
    """``(term, df, idf)``: terms in over half of the documents get a fraction of the mean idf instead of a negative one."""
    counted = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = counted.join(F.broadcast(stats)).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = F.broadcast(raw.agg(F.avg("raw").alias("mean")))
    return raw.join(mean).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25_stored(queries: list[str], posts: DataFrame, sizes: DataFrame, key: str, k: int) -> DataFrame:
    """Top k of each query from stored postings ``(key, term, tf, dl)`` and lengths ``(key, dl)``: as ``bm25`` gives them from the texts.

    Only postings of the queries' terms are read (a filter that reaches the scan); they carry the
    lengths, so nothing is joined to the collection. What comes to the driver is a row per query
    term. The mean idf of all terms is asked for only if a term is in over half of the texts.
    """
    spark = posts.sparkSession
    asked = spark.createDataFrame([(n, q) for n, q in enumerate(queries)], "q_ord int, query string")
    terms = asked.select("q_ord", F.explode(bm25_tokens(F.col("query"))).alias("term")).groupBy("q_ord", "term").count().collect()
    stats = sizes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl")).first()
    hits = posts.filter(F.col("term").isin(sorted({r.term for r in terms})))
    held = {r.term: r["count"] for r in hits.groupBy("term").count().collect()}
    raw = {t: math.log(stats.n - df + 0.5) - math.log(df + 0.5) for t, df in held.items()}
    mean = 0.0
    if min(raw.values(), default=0.0) < 0:
        df = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        mean = df.agg(F.avg(F.log(F.lit(stats.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("mean")).first()["mean"]
    weights = spark.createDataFrame([(r.q_ord, r.term, r["count"] * (raw[r.term] if raw[r.term] >= 0 else EPSILON * mean)) for r in terms if r.term in raw], "q_ord int, term string, weight double")
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(stats.avgdl or 1.0))))
    scored = hits.join(F.broadcast(weights), "term").groupBy("q_ord", key).agg(F.round(F.sum(part), 6).alias("score"))
    order = W.partitionBy("q_ord").orderBy(F.col("score").desc(), key)
    return scored.filter("score > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def bm25(queries: list[str], docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """Top k of each query: ``(q_ord, key, score, rank)``; ties by key, scores of 0 and below are left out.

    The documents are read once for the postings of the query terms (a filter before the
    shuffle) and once for the statistics of all terms. Repeated query terms count repeatedly.
    """
    spark = docs.sparkSession
    asked = spark.createDataFrame([(n, q) for n, q in enumerate(queries)], "q_ord int, query string")
    terms = asked.select("q_ord", F.explode(bm25_tokens(F.col("query"))).alias("term"))
    stats = corpus_stats(docs, text)
    weights = term_stats(postings(docs, key, text), stats).join(F.broadcast(terms), "term").groupBy("q_ord", "term", "idf").agg(F.count(F.lit(1)).alias("qtf"))
    counted = docs.select(key, bm25_tokens(F.col(text)).alias("tokens")).select(key, F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    hits = counted.join(F.broadcast(terms.select("term").distinct()), "term").groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.join(F.broadcast(weights), "term").join(F.broadcast(stats)).groupBy("q_ord", key).agg(F.round(F.sum(part), 6).alias("score"))
    order = W.partitionBy("q_ord").orderBy(F.col("score").desc(), key)
    return scored.filter("score > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
