"""From ranked hits to contexts: fusion, reranking, grouping by parent, budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

RRF_K = 60


def rrf(hits: DataFrame, key: str, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ``(q_ord, query, src_ord, source, key, rank)``.

    ``(key, rrf_score, dense_rank, bm25_rank, matched_queries, retrieval_sources, place)``, the
    first k; ties by the first touch in query, source, rank order. Contributions are added in
    that order, so the sum does not depend on the shuffle.
    """
    fused = hits.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("q_ord", "src_ord", (F.lit(1.0) / (rrf_k + F.col("rank"))).alias("c")))).alias("parts"),
        F.min(F.struct("q_ord", "src_ord", "rank")).alias("first"),
        F.min(F.when(F.col("source") == "dense", F.col("rank"))).alias("dense_rank"),
        F.min(F.when(F.col("source") == "bm25", F.col("rank"))).alias("bm25_rank"),
        F.sort_array(F.collect_set("query")).alias("matched_queries"),
        F.sort_array(F.collect_set("source")).alias("retrieval_sources"),
    )
    scored = fused.withColumn("rrf_score", F.round(F.aggregate(F.transform("parts", lambda x: x["c"]), F.lit(0.0), lambda s, c: s + c), 9))
    top = scored.orderBy(F.col("rrf_score").desc(), "first").limit(k)
    place = F.row_number().over(W.orderBy(F.col("rrf_score").desc(), "first"))  # k rows
    return top.withColumn("place", place).drop("parts", "first")


def rerank(candidates: DataFrame, score: str, order: str, k: int, group: str | None = None) -> DataFrame:
    """The k best by ``score`` with their ``rerank_rank``, of each ``group`` if named; ties keep ``order``, null scores come last."""
    by = W.partitionBy(*([group] if group else [])).orderBy(F.col(score).desc_nulls_last(), order)
    top = candidates if group else candidates.orderBy(F.col(score).desc_nulls_last(), order).limit(k)
    return top.withColumn("rerank_rank", F.row_number().over(by)).filter(F.col("rerank_rank") <= k)


def by_parent(candidates: DataFrame, group: str | None = None) -> DataFrame:
    """One row per parent window of reranked candidates: chunks in rank order, best scores, united queries and sources."""
    keys = [group] if group else []
    return candidates.groupBy(*keys, "parent_window_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rerank_rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("source_chunks"),
        F.max(F.coalesce("rerank_score", F.lit(float("-inf")))).alias("best_rerank_score"),
        F.max("rrf_score").alias("best_rrf_score"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("matched_queries")))).alias("matched_queries"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("retrieval_sources")))).alias("retrieval_sources"),
        F.min_by("doc_id", "rerank_rank").alias("doc_id"),
        F.min("rerank_rank").alias("first"),
    )


def contexts(grouped: DataFrame, lookup: DataFrame, documents: DataFrame, most: int, group: str | None = None) -> DataFrame:
    """The ``most`` best parents with their text; the limit comes before the text is resolved, ranks are numbered after.

    Parents that cannot be resolved (the sentinel ``none``, an unknown window or document) are
    dropped, so fewer may remain. Window ids and document ids are looked up once, however often
    they are repeated.
    """
    keys = [group] if group else []
    by = W.partitionBy(*keys).orderBy(F.col("best_rerank_score").desc(), "first")
    best = grouped.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= most).drop("_n")
    spans = lookup.groupBy("parent_window_id").agg(F.min(F.struct("doc_id", "char_start", "char_end")).alias("s")).select("parent_window_id", F.col("s.doc_id").alias("span_doc"), "s.char_start", "s.char_end")
    found = best.filter("parent_window_id <> 'none'").join(spans, "parent_window_id")
    wanted = documents.select(F.col("doc_id").alias("span_doc"), "full_text").join(found.select("span_doc").distinct(), "span_doc", "left_semi").groupBy("span_doc").agg(F.max("full_text").alias("full_text"))
    resolved = found.join(wanted, "span_doc").withColumn("parent_text", F.substring("full_text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")))
    return resolved.filter("parent_text is not null").withColumn("rank", F.row_number().over(by)).select(
        *keys, "rank", "parent_window_id", "doc_id", "parent_text", "source_chunks", "best_rerank_score", "best_rrf_score", "matched_queries", "retrieval_sources"
    )


def budget(ranked: DataFrame, max_tokens: int, group: str | None = None) -> DataFrame:
    """The prefix of ``(rank, doc_id, parent_window_id, parent_text, best_rerank_score)`` whose blocks fit ``max_tokens`` of four characters.

    A parent counts once, at its best score. A block is a header with the document's number, the
    text and a line's end. The running length only grows, so the filter is a break.
    """
    keys = [group] if group else []
    first = W.partitionBy(*keys, "parent_window_id").orderBy(F.col("best_rerank_score").desc(), "rank")
    kept = ranked.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    order = W.partitionBy(*keys).orderBy(F.col("best_rerank_score").desc(), "rank")
    numbered = kept.withColumn("number", F.row_number().over(order))
    block = F.concat(F.lit("[Document "), F.col("number").cast("string"), F.lit("] "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("parent_text"), F.lit("\n"))
    sized = numbered.withColumn("block", block).withColumn("used", F.sum(F.length("block")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return sized.filter(F.col("used") <= max_tokens * 4)
