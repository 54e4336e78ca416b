"""Filling fixed-capacity containers: best fit decreasing under conflicts."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ravelin.llm.tokens import TOKENIZER, token_counts
from ravelin.session import cut

SHARD_ITEMS = 4096
PACKED = "doc_id long, piece_no int, token_start long, n_tokens long, container_id long"


def best_fit(sizes: Sequence[int], sources: Sequence[int], clusters: Sequence[int], capacity: int, foes: dict[int, int]) -> list[int]:
    """The bin of each item, items being taken as given.

    Open bins stand in the order of their residual. From the least residual that holds the item
    the search goes on until a bin is compatible: its cluster bitmap lacks the item's duplicate
    cluster and its source bitmap meets none of the sources the item's source is kept apart from.
    Clusters of -1 have no duplicates.
    """
    order: list[tuple[int, int]] = []
    seen_sources: list[int] = []
    seen_clusters: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters):
        bit, foe = (1 << cluster) if cluster >= 0 else 0, foes.get(source, 0)
        at = bisect_left(order, (size, -1))
        while at < len(order):
            b = order[at][1]
            if not (seen_clusters[b] & bit or seen_sources[b] & foe):
                break
            at += 1
        if at < len(order):
            residual, b = order.pop(at)
        else:
            residual, b = capacity, len(seen_sources)
            seen_sources.append(0)
            seen_clusters.append(0)
        seen_sources[b] |= 1 << source if source >= 0 else 0
        seen_clusters[b] |= bit
        insort(order, (residual - size, b))
        out.append(b)
    return out


def pack(docs: DataFrame, capacity: int, apart: Sequence[tuple[str, str]] = (), tokenizer: str = TOKENIZER, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Assign every document to a container; ``(doc_id, piece_no, token_start, n_tokens, container_id)``.

    ``docs``: ``doc_id, text, source``. A document above ``capacity`` tokens is cut into full
    containers and a rest; every other stays whole. Copies of one text never share a container,
    the rests of cut ones included, nor do sources in a pair of ``apart``. Items are spread evenly over shards of about
    ``shard_items``, so a hot source or cluster is spread too; a shard packs its own containers,
    and only its last few are less than full.

    Null and empty texts take no room but get a container. Repeated rows of a doc_id are one
    item (the longest). Null sources conflict with nothing. Other columns are ignored; an empty
    table gives an empty table.
    """
    counted = token_counts(docs, tokenizer).groupBy("doc_id").agg(F.max(F.struct("n_tokens", "cluster", "source")).alias("d")).select("doc_id", "d.*")
    last = F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / capacity) - 1)
    items = counted.select(
        "doc_id", "source", "cluster", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece_no"), last.alias("last")
    ).select(
        "doc_id", F.col("piece_no").cast("int").alias("piece_no"), "source", F.when(F.col("piece_no") == F.col("last"), F.col("cluster")).alias("cluster"), (F.col("piece_no") * capacity).alias("token_start"),
        F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece_no") * capacity).alias("n_tokens"),
    )
    items = cut(items)
    shards = max(1, -(-items.count() // shard_items))

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id", "piece_no"], ascending=[False, True, True])
        names = {s: n for n, s in enumerate(sorted(set(rows.source.dropna()) | {s for pair in apart for s in pair}))}
        foes: dict[int, int] = {}
        for a, b in apart:
            foes[names[a]] = foes.get(names[a], 0) | 1 << names[b]
            foes[names[b]] = foes.get(names[b], 0) | 1 << names[a]
        several = rows.cluster.dropna().value_counts()
        several = {c: n for n, c in enumerate(several[several > 1].index)}
        clusters = [several.get(c, -1) for c in rows.cluster]
        bins = best_fit(rows.n_tokens.tolist(), [names.get(s, -1) for s in rows.source], clusters, capacity, foes)
        shard = int(rows.shard.iloc[0]) if len(rows) else 0
        return pd.DataFrame({"doc_id": rows.doc_id, "piece_no": rows.piece_no, "token_start": rows.token_start, "n_tokens": rows.n_tokens, "container_id": [(shard << 24) + b for b in bins]})

    sharded = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(shards)))
    return sharded.groupBy("shard").applyInPandas(fill, PACKED)


def oversized(packed: DataFrame) -> DataFrame:
    """Documents that lie in more than one container."""
    return packed.groupBy("doc_id").agg(F.min("container_id").alias("first"), F.max("container_id").alias("last")).filter("first <> last").select("doc_id")


def conflict_report(packed: DataFrame, docs: DataFrame, capacity: int, apart: Sequence[tuple[str, str]] = (), tokenizer: str = TOKENIZER) -> DataFrame:
    """One row of what must be 0: containers over their capacity, with copies, with sources kept apart; tokens that are not in the containers."""
    kinds = token_counts(docs, tokenizer).groupBy("doc_id").agg(F.max(F.struct("n_tokens", "cluster", "source")).alias("d")).select("doc_id", F.col("d.n_tokens").alias("whole"), "d.cluster", "d.source")
    kinds = cut(kinds)
    placed = packed.join(kinds, "doc_id").withColumn("cluster", F.when(F.col("token_start") + F.col("n_tokens") == F.col("whole"), F.col("cluster")))
    bins = placed.groupBy("container_id", "cluster").agg(F.sum("n_tokens").alias("t"), F.count("cluster").alias("copies"), F.collect_set("source").alias("sources"))
    bins = bins.groupBy("container_id").agg(F.sum("t").alias("t"), F.max("copies").alias("copies"), F.array_distinct(F.flatten(F.collect_list("sources"))).alias("sources"))
    mixed = F.lit(False)
    for a, b in apart:
        mixed = mixed | (F.array_contains("sources", a) & F.array_contains("sources", b))
    out = bins.agg(F.count_if(F.col("t") > capacity).alias("over_capacity"), F.count_if(F.col("copies") > 1).alias("copies_together"), F.count_if(mixed).alias("sources_together"), F.coalesce(F.sum("t"), F.lit(0)).alias("packed"))
    return out.join(kinds.agg(F.coalesce(F.sum("whole"), F.lit(0)).alias("given"))).select("over_capacity", "copies_together", "sources_together", (F.col("given") - F.col("packed")).alias("lost_tokens"))  # one row each


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, items, tokens and the share of the room that is used."""
    bins = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    return bins.agg(
        F.count(F.lit(1)).alias("containers"), F.sum("n").alias("items"), F.sum("t").alias("tokens"),
        (F.sum("t") / (F.count(F.lit(1)) * capacity)).alias("fill"),
    )
