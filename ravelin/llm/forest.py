"""Most similar vectors for every vector: a forest of sorted hash-prefix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ravelin.session import cut

BITS = 64
LEAF = 4096
#: Rows of a block on average, the most rows of one, and the bits by which a fuller one is split.
BLOCK, FULLEST, STEP = 8 * LEAF, 64 * LEAF, 4
CANDIDATES = "vid long, packed binary"


def trees_for(rows: int, leaf: int = LEAF) -> int:
    """Trees for a recall of 0.9 among ``rows`` vectors.

    Two vectors with a cosine of 0.45, as have the nearest ones of vectors that are like no other,
    agree in a bit with a chance of 0.65, so the chance to share a leaf falls with the power 0.62 of
    the rows. 14 trees were measured to suffice for 150,000 rows in leaves of 4,096.
    """
    return max(12, int(np.ceil(14 * (rows / 150_000 * LEAF / leaf) ** 0.62)))


def hyperplanes(dim: int, tree: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng([seed, tree]).standard_normal((dim, BITS)).astype(np.float32)


def labels_of(vectors: np.ndarray, tree: int) -> np.ndarray:
    """Hash strings of BITS signs as integers that sort like the strings."""
    bits = vectors @ hyperplanes(vectors.shape[1], tree) > 0
    packed = np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)
    return (packed ^ np.uint64(1 << 63)).view(np.int64)


def prefix_leaves(labels: np.ndarray, cap: int) -> list[tuple[int, int]]:
    """Ranges of sorted labels that share the shortest prefix that leaves at most ``cap``; equal labels stay together."""
    keys = labels.view(np.uint64) ^ np.uint64(1 << 63)
    out, todo = [], [(0, len(keys), 0)]
    while todo:
        low, high, depth = todo.pop()
        if high - low <= cap or depth == BITS:
            if high > low:
                out.append((low, high))
            continue
        bit = np.uint64(1) << np.uint64(BITS - 1 - depth)
        middle = low + int(np.searchsorted((keys[low:high] & bit) != 0, True))
        todo += [(middle, high, depth + 1), (low, middle, depth + 1)]
    return sorted(out)


def top_columns(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, not sorted: folds to column classes, then looks inside the best classes."""
    n, width = sims.shape
    if width <= 8 * k or width < 256:
        return np.argpartition(-sims, min(k, width) - 1, axis=1)[:, :k] if width > k else np.tile(np.arange(width), (n, 1))
    folds = max(1, int(np.log2(width / 128)))
    classes = -(-width // (1 << folds))
    padded = np.full((n, classes << folds), -np.inf, np.float32)
    padded[:, :width] = sims
    best = padded
    for _ in range(folds):
        half = best.shape[1] // 2
        best = np.maximum(best[:, :half], best[:, half:])
    chosen = np.argpartition(-best, k - 1, axis=1)[:, :k]
    columns = (chosen[:, :, None] + classes * np.arange(1 << folds)).reshape(n, -1)
    values = np.take_along_axis(padded, columns, 1)
    return np.take_along_axis(columns, np.argpartition(-values, k - 1, axis=1)[:, :k], 1)


def _pack(ids: np.ndarray, sims: np.ndarray) -> pa.Array:
    """A row of int64 ids, then float32 similarities, as one binary value per row."""
    n = len(ids)
    body = np.concatenate([np.ascontiguousarray(ids).view(np.uint8).reshape(n, -1), np.ascontiguousarray(sims).view(np.uint8).reshape(n, -1)], axis=1)
    offsets = np.arange(n + 1, dtype=np.int32) * body.shape[1]
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))])


def _bodies(column: pa.Array, dtype: str) -> np.ndarray:
    size = len(column[0].as_py())
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), size // np.dtype(dtype).itemsize)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def neighbours_in_block(labels: np.ndarray, ids: np.ndarray, units: np.ndarray, k: int, leaf: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of one tree's sorted block: for each row the k best of its leaf and of half a leaf to either side (the ascent)."""
    for low, high in prefix_leaves(labels, leaf):
        for at in range(low, high, 512):
            stop = min(at + 512, high)
            inner = high - low <= leaf
            first, last = max(0, (low if inner else at - leaf // 2) - leaf // 2), min(len(ids), (high if inner else stop + leaf // 2) + leaf // 2)
            sims = units[at:stop] @ units[first:last].T
            sims[np.arange(stop - at), np.arange(at - first, stop - first)] = -2
            columns = top_columns(sims, k)
            values = np.take_along_axis(sims, columns, 1)
            found = ids[first:last][columns]
            if columns.shape[1] < k:
                pad = k - columns.shape[1]
                values = np.pad(values, ((0, 0), (0, pad)), constant_values=-2)
                found = np.pad(found, ((0, 0), (0, pad)))
            yield ids[at:stop], found, values


class Blocks:
    """Which block of a tree a row belongs to: the rows that share a prefix of its hash string.

    The prefix has ``depth`` bits and ``STEP`` more as long as it is one of ``full``, the prefixes
    that too many rows share. Rows that share all bits are dealt out by their ids. Blocks depend
    on the vectors alone, not on how these are partitioned.
    """

    def __init__(self, depth: int):
        self.depth, self.full = depth, {}

    def of(self, tree: int, labels: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(bits, prefix)`` of each row; the prefix is the label with the other bits zero, or salted."""
        keys = labels.view(np.uint64) ^ np.uint64(1 << 63)
        bits = np.full(len(keys), self.depth, np.int32)
        prefix = self._cut(keys, self.depth)
        for depth in range(self.depth, BITS + STEP, STEP):
            at = self.full.get((tree, min(depth, BITS)))
            if not at:
                continue
            full = np.array(sorted(at), np.uint64)
            inside = np.flatnonzero((bits == min(depth, BITS)) & (full[np.minimum(np.searchsorted(full, prefix), len(full) - 1)] == prefix))
            if depth >= BITS:
                parts = np.array([at[int(p)] for p in prefix[inside]], np.uint64)
                salt = (ids[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % parts
                bits[inside], prefix[inside] = BITS + 1, prefix[inside] ^ salt
            else:
                bits[inside], prefix[inside] = min(depth + STEP, BITS), self._cut(keys[inside], min(depth + STEP, BITS))
        return bits, prefix

    @staticmethod
    def _cut(keys: np.ndarray, bits: int) -> np.ndarray:
        return keys >> np.uint64(BITS - bits) << np.uint64(BITS - bits) if bits else np.zeros_like(keys)

    def split(self, tree: int, bits: int, prefix: int, rows: int) -> None:
        self.full.setdefault((tree, bits), {})[prefix] = -(-rows // FULLEST)


def _raw(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(batch.num_rows, -1)


def _blocks(vectors: DataFrame, trees: int, rows: int) -> Blocks:
    """Blocks none of which is overfull. What leaves the tasks are prefixes that more than ``FULLEST`` rows share, one per so many rows at most."""
    blocks = Blocks(max(0, int(np.ceil(np.log2(max(rows, 1) / BLOCK)))))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units, ids = unit_rows(_raw(batch)), batch.column("vid").to_numpy()
            for tree in range(trees):
                bits, prefix = blocks.of(tree, labels_of(units, tree), ids)
                both, n = np.unique(np.stack([bits.astype(np.uint64), prefix]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), tree, np.int32)), pa.array(both[0].astype(np.int32)), pa.array(both[1].view(np.int64)), pa.array(n)], names=["tree", "bits", "prefix", "n"])

    while True:
        sizes = vectors.select("vid", "vector").mapInArrow(counted, "tree int, bits int, prefix long, n long").groupBy("tree", "bits", "prefix").agg(F.sum("n").alias("n"))
        fuller = sizes.filter((F.col("n") > FULLEST) & (F.col("bits") <= BITS)).collect()
        if not fuller:
            return blocks
        for r in fuller:
            blocks.split(r.tree, r.bits, r.prefix % (1 << 64), r.n)


def forest_neighbours(vectors: DataFrame, k: int = 5, trees: int | None = None, leaf: int = LEAF) -> DataFrame:
    """The k most similar other rows of ``(vid long, vector array<float>)``: ``(vid, nid, similarity)``.

    Each tree orders all vectors by a string of 64 signs of random projections; the order is made
    block by block (see ``Blocks``), a block being the rows that share a prefix, so no task sees
    more than ``FULLEST`` rows of it. In the sorted array the rows with the longest common prefixes
    stand together: each row ascends, in all trees alike, from its longest match to the shortest
    prefix that leaves at most ``leaf`` rows and on to the prefixes beside it, and the candidates of
    all trees are merged. ``trees`` grow with the rows (see ``trees_for``) unless given. Vectors
    travel in half precision; the similarity is the cosine of what travelled (within 1e-3). The
    result does not depend on how the rows are partitioned.

    ``vid`` must be unique, vectors non-null, of one size, not zero, finite: see
    ``usable_vectors``. Rows with fewer than k others get fewer. Ties may go either way. An empty
    table gives an empty table.
    """
    rows = vectors.count()
    trees = trees or trees_for(rows, leaf)
    blocks = _blocks(vectors, trees, rows)
    tasks = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows * trees // (2 * BLOCK)))

    def planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = _raw(batch)
            scaled = (raw / np.abs(raw).max(axis=1, keepdims=True)).astype(np.float16) if np.abs(raw).max() > 6e4 or np.abs(raw).max(axis=1).min() < 1e-2 else raw.astype(np.float16)
            units, ids = unit_rows(raw), batch.column("vid").to_numpy()
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * (2 * raw.shape[1])
            body = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(scaled))])
            for tree in range(trees):
                labels = labels_of(units, tree)
                bits, prefix = blocks.of(tree, labels, ids)
                block = (prefix * np.uint64(0x9E3779B97F4A7C15) ^ (bits.astype(np.uint64) << np.uint64(32)) ^ np.uint64(tree)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(batch.num_rows, tree, np.int32)), pa.array(block), pa.array(labels), pa.array(ids), body], names=["tree", "block", "label", "vid", "half"]
                )

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def search(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            units = unit_rows(_bodies(table.column("half").chunk(0), "<f2").astype(np.float32))
            for mine, found, values in neighbours_in_block(table.column("label").to_numpy(), table.column("vid").to_numpy(), units, k, leaf):
                yield pa.RecordBatch.from_arrays([pa.array(mine), _pack(found, values)], names=["vid", "packed"])

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, block = batch.column("tree").to_numpy(), batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(tree) != 0) | (np.diff(block) != 0)) + 1), batch.num_rows]
            for low, high in zip(edges, edges[1:]):
                if held and last != (tree[low], block[low]):
                    yield from search(pa.Table.from_batches(held))
                    held = []
                last = (tree[low], block[low])
                held.append(batch.slice(low, high - low))
        if held:
            yield from search(pa.Table.from_batches(held))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def best(vid: np.ndarray, nid: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
            order = np.lexsort((-sim, nid, vid))
            vid, nid, sim = vid[order], nid[order], sim[order]
            keep = np.ones(len(vid), bool)
            keep[1:] = (vid[1:] != vid[:-1]) | (nid[1:] != nid[:-1])
            vid, nid, sim = vid[keep], nid[keep], sim[keep]
            order = np.lexsort((nid, -sim, vid))
            vid, nid, sim = vid[order], nid[order], sim[order]
            starts = np.flatnonzero(np.r_[True, vid[1:] != vid[:-1]])
            rank = np.arange(len(vid)) - np.repeat(starts, np.diff(np.r_[starts, len(vid)]))
            keep = rank < k
            return pa.RecordBatch.from_arrays([pa.array(vid[keep]), pa.array(nid[keep]), pa.array(sim[keep].astype(np.float64))], names=["vid", "nid", "similarity"])

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], last: bool):
            vid, nid, sim = (np.concatenate(x) for x in zip(*parts))
            end = len(vid) if last else int(np.searchsorted(vid, vid[-1]))
            real = sim[:end] > -1.5
            return best(vid[:end][real], nid[:end][real], sim[:end][real]) if real.any() else None, (vid[end:], nid[end:], sim[end:])

        for batch in batches:
            if not batch.num_rows:
                continue
            body = _bodies(batch.column("packed"), "u1")
            nid = np.ascontiguousarray(body[:, : 8 * k]).view(np.int64).ravel()
            sim = np.ascontiguousarray(body[:, 8 * k :]).view(np.float32).ravel()
            held.append((np.repeat(batch.column("vid").to_numpy(), k), nid, sim))
            if sum(len(x[0]) for x in held) > 500_000:
                out, rest = flush(held, False)
                held = [rest]
                if out is not None:
                    yield out
        if held:
            out, _ = flush(held, True)
            if out is not None:
                yield out

    planted_rows = vectors.select("vid", "vector").mapInArrow(planted, "tree int, block long, label long, vid long, half binary")
    ordered = planted_rows.repartition(tasks, "tree", "block").sortWithinPartitions("tree", "block", "label", "vid")
    candidates = ordered.mapInArrow(searched, CANDIDATES)
    return candidates.repartition("vid").sortWithinPartitions("vid").mapInArrow(merged, "vid long, nid long, similarity double")


def usable_vectors(embedded: DataFrame, chunks: DataFrame, dim: int) -> DataFrame:
    """One row ``(vid, hash, vector)`` per text hash with a usable vector.

    The hash is the lower-case embed_text_hash, recomputed from the chunk's embed_text where
    null. A vector is usable if it has ``dim`` finite components, not all zero; of several the
    latest stands for its hash. Rows without a hash (null and no chunk) are left out.
    """
    good = (F.size("dense_vector") == dim) & F.forall("dense_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e30)) & F.exists("dense_vector", lambda x: F.abs(x) > 1e-18)
    rows = embedded.select("chunk_id", "dense_vector", F.lower("embed_text_hash").alias("hash"), "generated_at").filter(good)
    lost = rows.filter("hash is null").drop("hash").join(chunks.select("chunk_id", F.sha2("embed_text", 256).alias("hash")).distinct(), "chunk_id")
    every = rows.filter("hash is not null").select("hash", "dense_vector", "generated_at").unionByName(lost.select("hash", "dense_vector", "generated_at"))
    kept = every.groupBy("hash").agg(F.max_by("dense_vector", F.struct("generated_at", F.col("dense_vector"))).alias("vector"))
    return cut(kept.filter("hash is not null").withColumn("vid", F.monotonically_increasing_id()))


def exact_similarity(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs ``(vid, nid, ...)`` with both hashes and the cosine in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
    left = vectors.select(F.col("vid"), F.col("hash").alias("hash_v"), F.col("vector").alias("x"))
    right = vectors.select(F.col("vid").alias("nid"), F.col("hash").alias("hash_n"), F.col("vector").alias("y"))
    return pairs.join(left, "vid").join(right, "nid").withColumn("cosine", dot("x", "y") / F.sqrt(dot("x", "x") * dot("y", "y"))).drop("x", "y")


def mutual_neighbours(embedded: DataFrame, chunks: DataFrame, dim: int = 64, k: int = 5, least: float = 0.92) -> DataFrame:
    """Pairs ``(hash_a, hash_b)`` among each other's k most similar, with a cosine of ``least`` at least."""
    vectors = usable_vectors(embedded, chunks, dim)
    near = forest_neighbours(vectors, k).filter(F.col("similarity") >= least - 0.01)
    both = near.select(F.least("vid", "nid").alias("vid"), F.greatest("vid", "nid").alias("nid")).groupBy("vid", "nid").count().filter("count = 2").drop("count")
    exact = exact_similarity(both, vectors).filter(F.col("cosine") >= least)
    return exact.select(F.least("hash_v", "hash_n").alias("hash_a"), F.greatest("hash_v", "hash_n").alias("hash_b"))


def all_neighbours(embedded: DataFrame, chunks: DataFrame, dim: int = 64, k: int = 5) -> DataFrame:
    """The k most similar other texts of every text with a usable vector: ``(hash, neighbour, similarity)``."""
    vectors = usable_vectors(embedded, chunks, dim)
    named = vectors.select("vid", "hash")
    near = forest_neighbours(vectors, k)
    return near.join(named, "vid").join(named.select(F.col("vid").alias("nid"), F.col("hash").alias("neighbour")), "nid").select("hash", "neighbour", "similarity")
