"""Mixing sources to target weights: balanced sampling by the cube method."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ravelin.llm.tokens import TOKENIZER, token_counts
from ravelin.session import cut

BLOCK_ITEMS = 4096
HEAVY = 64
LENT = 14
EPSILON = 1e-9


def flight(share: np.ndarray, size: np.ndarray, rng: np.random.Generator, heavy: int = HEAVY) -> np.ndarray:
    """Move inclusion probabilities until at most two are fractional, keeping their sum and their sum weighted by ``size``.

    Of three open items a vector in the null space of the two constraints is followed, forwards
    or backwards with the chances that keep every expectation, until one of them is 0 or 1. The
    first ``heavy`` items (the largest, as the rows come sorted) are settled among themselves
    before, for beside smaller ones they would stay open to the end; the last two of them go by the
    weighted sum alone.
    """
    p = share.astype(float).copy()
    size = size.astype(float)

    def settle(items: np.ndarray, width: int) -> None:
        active: list[int] = []
        todo = iter(items)
        while True:
            while len(active) < width:
                k = next(todo, None)
                if k is None:
                    return
                if EPSILON < p[k] < 1 - EPSILON:
                    active.append(k)
            s = size[active]
            u = np.array([s[1], -s[0]]) if width == 2 else np.array([s[1] - s[2], s[2] - s[0], s[0] - s[1]])
            if not u.any():
                u = np.array([1.0, -1.0, 0.0][:width])
            q = p[active]
            with np.errstate(divide="ignore", invalid="ignore"):
                up = np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf)).min()
                down = np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf)).min()
            p[active] = q + up * u if rng.random() < down / (up + down) else q - down * u
            active = [k for k in active if EPSILON < p[k] < 1 - EPSILON]

    settle(np.arange(min(heavy, len(p))), 3)
    settle(np.arange(min(heavy, len(p))), 2)
    settle(np.arange(len(p)), 3)
    return np.where(p < EPSILON, 0.0, np.where(p > 1 - EPSILON, 1.0, p))


def landing(share: np.ndarray, size: np.ndarray, owed: float, owed_items: float) -> np.ndarray:
    """0 or 1 for the items that are left open and the settled ones lent to the landing.

    Their size comes nearest to ``owed`` and their number to ``owed_items``, one more or less of
    which counts as a tenth of the mean size; a settled item that changes costs a hundredth of it,
    so few do.
    """
    if not len(share):
        return share
    choices = (np.arange(1 << len(share))[:, None] >> np.arange(len(share)) & 1).astype(float)
    settled = (share == 0) | (share == 1)
    changed = (np.abs(choices - share) * settled).sum(axis=1)
    amiss = np.abs(choices @ size - owed) + 0.1 * size.mean() * np.abs(choices.sum(axis=1) - owed_items)
    return choices[np.argmin(amiss + 0.01 * size.mean() * changed)]


def plan(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """A row per target source: documents, tokens, quota of tokens, copies per document.

    The mix has as many tokens as all documents that have a source; a source's quota is its
    share of them. Sums are made with map-side combine, a row per source.
    """
    held = counted.filter("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("n_tokens").alias("largest"))
    whole = held.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("whole")).first().whole
    wanted = targets.select(F.col("source").alias("name"), F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats")
    out = wanted.join(held, "source", "left").fillna(0, ["tokens", "documents", "largest"])
    out = out.withColumn("quota", F.col("target_share") * F.lit(float(whole)))
    return out.withColumn("rate", F.when(F.col("tokens") > 0, F.least(F.col("max_repeats").cast("double"), F.col("quota") / F.col("tokens"))).otherwise(0.0))


def _flyer(seed: int, turn: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def fly(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id"], ascending=[False, True], ignore_index=True)  # large ones are settled first, small ones are left
        key = [seed, turn, int(rows.block.iloc[0]), *str(rows.source.iloc[0]).encode()]
        return rows.assign(share=flight(rows.share.to_numpy(), rows.n_tokens.to_numpy(), np.random.default_rng(key)))[["doc_id", "source", "n_tokens", "share"]]

    return fly


def mix(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = 5, block_items: int = BLOCK_ITEMS) -> tuple[DataFrame, DataFrame]:
    """How often each document is used, ``(doc_id, source, n_tokens, copies)``, and the report per source.

    ``docs``: ``doc_id, text, source``; ``targets``: ``source, target_share, max_repeats``. Every
    document of a source is used ``floor(rate)`` times, and once more with the chance of the
    rest; who is, is decided by the cube method: in blocks of a source the probabilities move
    through the null space of the token total and the document total until two at most are left
    open, these are gathered into new blocks, and the last of a source, with ``LENT`` settled ones (half of
    them the largest),
    land nearest its quota.
    A source of any size is many blocks; rounds shrink the open items by thousands.

    Report: ``source, target_share, tokens, quota, reachable, reached_tokens, reached_share,
    largest, documents, quota_documents, reached_documents`` (``largest``: tokens of the largest document). A source that cannot reach its share uses every
    document ``max_repeats`` times; one that came to that and is below its quota is not reachable. Null sources,
    and sources without a target, are not used (the latter count in the total); texts without
    tokens are used like others. Repeated rows of a doc_id are one document. Empty tables give
    no copies and a report of zeros.
    """
    spark = docs.sparkSession
    counted = cut(token_counts(docs, tokenizer).groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("d")).select("doc_id", "d.source", "d.n_tokens"))
    planned = cut(plan(counted, targets))
    rates = {r.source: r.rate for r in planned.select("source", "rate").collect()}  # a row per target source
    rate = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair]) if rates else F.create_map(F.lit(""), F.lit(0.0))
    used = counted.withColumn("rate", F.try_element_at(rate, F.col("source"))).filter("rate is not null")
    used = used.withColumn("base", F.floor(F.col("rate") + EPSILON)).withColumn("share", F.greatest(F.lit(0.0), F.col("rate") - F.col("base")))
    open_ = used.select("doc_id", "source", "n_tokens", "share")
    settled, owed, turn = [], cut(open_.groupBy("source").agg(F.sum(F.col("share") * F.col("n_tokens")).alias("owed"), F.sum("share").alias("owed_items"))), 0
    while True:
        sizes = {r.source: r["count"] for r in open_.groupBy("source").count().collect()}
        blocks = {s: max(1, -(-n // block_items)) for s, n in sizes.items()}
        if all(n <= 2 for n in sizes.values()):
            break
        last = all(b == 1 for b in blocks.values())
        spread = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair])

        blocked = open_.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(turn)), spread[F.col("source")]).cast("int"))
        flown = cut(blocked.groupBy("source", "block").applyInPandas(_flyer(seed, turn), "doc_id long, source string, n_tokens long, share double"))
        settled.append(flown.filter("share in (0, 1)"))
        open_ = flown.filter("share not in (0, 1)")
        turn += 1
        if last:
            break
    done = spark.createDataFrame([], "doc_id long, source string, n_tokens long, share double")
    for part in settled:
        done = done.unionByName(part)
    done = cut(done)
    by_hash, by_size = W.partitionBy("source").orderBy(F.xxhash64("doc_id", F.lit(seed))), W.partitionBy("source").orderBy(F.desc("n_tokens"), "doc_id")
    lent = [done.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= LENT // 2).drop("n") for w in (by_hash, by_size)]
    lent = lent[0].unionByName(lent[1]).distinct()
    last = cut(open_.unionByName(lent))
    kept = done.join(last.select("doc_id"), "doc_id", "left_anti")
    reached = kept.groupBy("source").agg(F.sum(F.col("share") * F.col("n_tokens")).alias("got"), F.sum("share").alias("got_items"))
    left = [(F.col(w) - F.coalesce(g, F.lit(0.0))).alias(w) for w, g in (("owed", "got"), ("owed_items", "got_items"))]
    rest = last.join(owed.join(reached, "source", "left").select("source", *left), "source")

    def land(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(share=landing(rows.share.to_numpy(), rows.n_tokens.to_numpy(), float(rows.owed.iloc[0]), float(rows.owed_items.iloc[0])).astype(float))[["doc_id", "source", "n_tokens", "share"]]

    landed = rest.groupBy("source").applyInPandas(land, "doc_id long, source string, n_tokens long, share double")
    extra = kept.unionByName(landed).select("doc_id", F.col("share").alias("more"))
    copies = cut(
        used.join(extra, "doc_id", "left").select("doc_id", "source", "n_tokens", (F.col("base") + F.coalesce("more", F.lit(0.0))).cast("int").alias("copies"))
        .filter("copies > 0")
    )
    got = copies.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("reached_tokens"), F.sum("copies").alias("reached_documents"))
    mixed = got.agg(F.sum("reached_tokens").alias("mixed")).first().mixed or 0
    report = planned.join(got, "source", "left").fillna(0, ["reached_tokens", "reached_documents"])
    spent = F.col("reached_documents") >= F.col("documents") * F.col("max_repeats")
    share = F.col("reached_tokens") / F.lit(float(mixed)) if mixed else F.lit(0.0)
    return copies, report.select(F.col("name").alias("source"), "target_share", "tokens", "quota", (~spent | (F.col("reached_tokens") >= F.col("quota"))).alias("reachable"), "reached_tokens", share.alias("reached_share"),
        "largest", "documents", (F.col("documents") * F.col("rate")).alias("quota_documents"), "reached_documents")
