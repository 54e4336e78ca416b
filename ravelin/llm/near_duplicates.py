"""Near-duplicate records by an inverted join on the rarest common word runs, with counted collisions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ravelin.session import cut, release

WORD = re.compile(r"[^\W_]+")
#: Counters of word runs, and the pages they travel in.
COUNTERS = 1 << 22
PAGE = 1 << 13
#: Common shingles for which a pair has to be met once more.
MEETING = 16
EXPANDED = 64
#: Texts of a list that are merged in one place; a longer list is spread over blocks of so many.
LIST = 4096
#: A posting as it travels: key, text, size on a scale of ``STEPS`` a power of e times 4 plus flags, share of the shingles from its place on.
POSTING = np.dtype([("key", "<u4"), ("doc", "<i8"), ("size", "<u2"), ("rest", "u1")])
STEPS = 750
BUCKET_BYTES = 16 << 20
CHUNK = 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str, cache: dict[str, int]) -> np.ndarray:
    """A 64-bit hash per word; words are runs of letters and digits in lower case."""
    words = WORD.findall(text.lower())
    if len(cache) > 500_000:
        cache.clear()
    for w in words:
        if w not in cache:
            cache[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter((cache[w] for w in words), np.uint64, len(words))


def shingle_set(hashes: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct 32-bit hashes of all runs of ``words`` words."""
    n = len(hashes) - words + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    mixed = np.zeros(n, np.uint64)
    for k in range(words):
        mixed = (mixed ^ hashes[k : k + n]) * _MIX
        mixed ^= mixed >> np.uint64(29)
    return np.unique((mixed >> np.uint64(32)).astype(np.uint32))


def prefix(shingles: np.ndarray, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The shingles a set is posted under and their places in the order rarest first.

    The order is that of the counters, then of the shingles, and so the same for every set. Two
    sets at or above ``threshold`` have ``least`` shingles or more in common, so that the first
    ``1 + least // MEETING`` of these are in the prefixes of both. Shingles counted once are in
    no other set.
    """
    n = len(shingles)
    seen = counts[shingles % COUNTERS]
    least = int(np.ceil(threshold * n - 1e-9))
    first = np.lexsort((shingles, seen))[: n - least + 1 + least // MEETING]
    shared = seen[first] > 1
    return shingles[first][shared], np.flatnonzero(shared)


def _binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def prepared(records: DataFrame, words: int) -> DataFrame:
    """``(record_kind, id, doc, shingles)``: ``doc`` is a hash of the kind and the word sequence, the same for copies."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                kinds, texts = part.column(0).to_pylist(), part.column(2).to_pylist()
                docs, sets = [], []
                for kind, text in zip(kinds, texts):
                    hashes = word_hashes(text or "", cache)
                    docs.append(xxhash.xxh3_64_intdigest(hashes.tobytes() + (kind or "").encode()) - (1 << 63))
                    sets.append(shingle_set(hashes, words).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(docs, pa.int64()), _binary(sets)], names=["record_kind", "id", "doc", "shingles"])

    return records.select("record_kind", "id", "text").mapInArrow(rows, "record_kind string, id string, doc long, shingles binary")


def shingle_counts(texts: DataFrame) -> np.ndarray:
    """How many rows hold a shingle, in ``COUNTERS`` counters (a shingle's counter is never below its count)."""
    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                if raw:
                    np.add.at(counts, np.frombuffer(raw, np.uint32) % COUNTERS, 1)
        if counts.any():
            parts = counts.reshape(-1, PAGE)
            narrow = [x.astype(np.uint8 if x.max() < 1 << 8 else np.uint16 if x.max() < 1 << 16 else np.uint32) for x in parts]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), _binary([x.tobytes() for x in narrow])], names=["page", "counts"])

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        added = np.zeros(PAGE, np.uint64)
        for raw in rows.counts:
            added += np.frombuffer(raw, f"<u{len(raw) // PAGE}")
        return pd.DataFrame({"page": rows.page.iloc[:1], "counts": [np.minimum(added, 2**32 - 1).astype(np.uint32).tobytes()]})

    counts = np.zeros((COUNTERS // PAGE, PAGE), np.uint32)
    for r in texts.select("shingles").mapInArrow(pages, "page int, counts binary").groupBy("page").applyInPandas(total, "page int, counts binary").collect():
        counts[r.page] = np.frombuffer(bytes(r.counts), np.uint32)
    return counts.ravel()


def _log_size(n: np.ndarray | int) -> np.ndarray:
    """Sizes on a scale of steps of about a thousandth, rounded down."""
    return np.floor(np.log(n) * STEPS).astype(np.uint16)


def _size(logs: np.ndarray) -> np.ndarray:
    """The least size that has the place ``logs`` on the scale."""
    return np.ceil(np.exp(logs / STEPS) - 1e-9)


def spread(keys: np.ndarray, doc: int, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(key, position in keys, flags)`` of a text's postings, those of long lists spread over blocks.

    A list that needs ``lists`` parts has a block for every two parts and for every part alone, each
    with a key of its own; a text of part s is posted in the blocks that s belongs to. Flags: 1 for a
    block of two parts, 2 for the second of them.
    """
    at = np.arange(len(keys))
    plain = lists <= 1
    out = [(keys[plain], at[plain], np.zeros(plain.sum(), np.uint16))]
    for k in np.flatnonzero(~plain):
        parts = int(lists[k])
        mine, other = doc % parts, np.arange(parts)
        low, high = np.minimum(mine, other).astype(np.uint64), np.maximum(mine, other).astype(np.uint64)
        mixed = ((keys[k].astype(np.uint64) << np.uint64(32) | low << np.uint64(16)) + high + np.uint64(1)) * _MIX
        out.append(((mixed >> np.uint64(32)).astype(np.uint32), np.full(parts, k), ((low != high) + 2 * ((low != high) & (high == mine))).astype(np.uint16)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _postings(texts: DataFrame, threshold: float) -> DataFrame:
    """``(bucket, packed)``: the postings of all texts under the shingles of their prefixes, packed by buckets of keys.

    A task posts a text once, however many copies it meets. A list longer than ``LIST`` is spread
    over blocks (see ``spread``), its length being that of its counter above the mean.
    """
    table = shingle_counts(texts)
    counts = texts.sparkSession.sparkContext.broadcast(table)
    total, mean = int(table.sum()), int(table.mean())
    buckets = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total * POSTING.itemsize // BUCKET_BYTES))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            packed = []
            for doc, raw, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if not raw or doc in seen:
                    continue
                seen.add(doc)
                shingles = np.frombuffer(raw, np.uint32)
                n = len(shingles)
                posted, place = prefix(shingles, counts.value, threshold)
                long = 1 + np.maximum(0, counts.value[posted % COUNTERS].astype(np.int64) - mean) // LIST
                keys, at, flags = spread(posted ^ np.uint32(xxhash.xxh32_intdigest(kind or "")), doc, np.minimum(long, 1 << 16))
                own = np.empty(len(keys), POSTING)
                own["key"], own["doc"], own["size"] = keys, doc, _log_size(n) << 2 | flags
                own["rest"] = np.ceil((n - place[at]) * (255 / n))
                if len(own):
                    packed.append(own)
            if len(seen) > 1_000_000:
                seen.clear()
            if packed:
                every = np.concatenate(packed)
                bucket = ((every["key"] * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)
                order = np.argsort(bucket, kind="stable")
                every, bucket = every[order], bucket[order]
                starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                parts = np.split(every, starts[1:])
                yield pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32)), _binary([x.tobytes() for x in parts])], names=["bucket", "packed"])

    posts = texts.select("doc", "shingles", "record_kind").mapInArrow(rows, "bucket int, packed binary")
    return posts.repartitionById(buckets, F.col("bucket"))


def meetings(posts: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(a, b, met, needed)``: pairs of texts that meet in the lists of a bucket, how often, and how often they must in all.

    A list is ordered by size, so that each text is merged with those of a size alike and skips
    the others; meetings under a shingle with too few behind it are left out.
    """
    posts = np.unique(posts)  # copies were posted by several tasks
    size = (posts["size"] >> 2).astype(np.int64)
    order = np.lexsort((size, posts["key"]))
    posts, size = posts[order], size[order]
    docs, flags = posts["doc"], posts["size"] & 3
    place = posts["key"].astype(np.int64) << 16 | size
    reach = np.searchsorted(place, place + int(np.ceil(-np.log(threshold) * STEPS)) + 1, "right")
    reach = np.minimum(reach, np.searchsorted(posts["key"], posts["key"], "right"))
    many = reach - np.arange(len(posts)) - 1
    least_size, rest = _size(size), posts["rest"]
    names, code = np.unique(docs, return_inverse=True)
    ends = np.cumsum(many)
    at = 0
    while at < len(posts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        left = np.repeat(np.arange(at, stop), many[at:stop])
        right = left + 1 + np.arange(len(left)) - np.repeat(ends[at:stop] - many[at:stop] - (ends[at - 1] if at else 0), many[at:stop])
        at = stop
        least = np.ceil((least_size[left] + least_size[right]) * (threshold / (1 + threshold)) - 1e-6)
        times = np.floor(least / MEETING) + 1
        over = np.minimum(rest[left] * _above(size[left]), rest[right] * _above(size[right])) / 255
        apart = (flags[left] & 1 == 0) | (flags[left] != flags[right])
        good = (code[left] != code[right]) & apart & (over > least - times - 1e-6)
        left, right, times = left[good], right[good], times[good]
        low, high = np.minimum(code[left], code[right]), np.maximum(code[left], code[right])
        pair, first, met = np.unique(low * np.int64(len(names)) + high, return_index=True, return_counts=True)
        yield names[pair // len(names)], names[pair % len(names)], met.astype(np.int32), times[first].astype(np.int32)


def _above(logs: np.ndarray) -> np.ndarray:
    """A size not below any that has the place ``logs`` on the scale."""
    return np.exp((logs + 1) / STEPS)


def similar_texts(texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(a, b, similarity)`` of different texts (``record_kind, doc, shingles``) of one kind at or above ``threshold``.

    The coordinates of a text are its word runs, ordered by how rare they are in all texts. No pair
    is lost: similar texts share ``least`` runs, the first ``1 + least // MEETING`` of them in their
    prefixes (see ``prefix``), under which both are posted. The lists are merged bucket by bucket
    (see ``meetings``), the collisions of a pair are counted, and a pair with enough of them is a
    candidate; its exact share of common runs decides. Long lists are split into even blocks.
    """
    posts = _postings(texts, threshold)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = b"".join(x for batch in batches for x in batch.column(1).to_pylist())
        for columns in meetings(np.frombuffer(packed, POSTING), threshold) if packed else ():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["a", "b", "met", "needed"])

    met = posts.mapInArrow(merged, "a long, b long, met int, needed int").repartition("a")  # meetings of one text travel side by side
    pairs = cut(met.groupBy("a", "b").agg(F.sum("met").alias("met"), F.min("needed").alias("needed")).filter("met >= needed").select("a", "b"))
    release(texts.sparkSession, at_once=True)  # counts, postings and meetings are no longer needed on disk
    sets = texts.filter(F.length("shingles") > 0).groupBy("doc").agg(F.first("shingles").alias("shingles"), F.first("record_kind").alias("kind"))
    left, right = (sets.select(F.col("doc").alias(d), F.col("shingles").alias(x), F.col("kind").alias(k)) for d, x, k in (("a", "x", "kx"), ("b", "y", "ky")))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", F.col("kx").eqNullSafe(F.col("ky")).alias("alike"))  # as a filter it would be a key of the join, and all sets shuffled again

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sims = np.empty(len(rows))
            for n, (x, y) in enumerate(zip(rows.x, rows.y)):
                u, v = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                common = len(np.intersect1d(u, v, assume_unique=True))
                sims[n] = common / (len(u) + len(v) - common)
            yield pd.DataFrame({"a": rows.a, "b": rows.b, "similarity": sims})[(sims >= threshold) & rows.alike.to_numpy(bool)]

    return both.mapInPandas(exact, "a long, b long, similarity double")


def near_duplicates(records: DataFrame, words: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Links between different texts ``(a, b, similarity)`` and members ``(record_kind, id, doc)`` of every text.

    ``records``: ``record_kind, id, text``; only records of one kind are compared. The
    similarity is the share of common runs of ``words`` words. Copies (equal word sequences) are
    one text with several members. Null and empty texts, and those with fewer than ``words``
    words, are members but have no links. Repeated ids count once; a null id is left out. Other
    columns are ignored. Empty tables give empty tables.
    """
    rows = cut(prepared(records.filter("id is not null"), words))
    members = rows.select("record_kind", "id", "doc", (F.length("shingles") > 0).alias("long")).distinct()
    return similar_texts(rows.select("record_kind", "doc", "shingles"), threshold), members


def near_duplicate_pairs(records: DataFrame, words: int, threshold: float, expanded: int = EXPANDED) -> DataFrame:
    """All pairs ``(record_kind, id_a, id_b)`` of different ids at or above the threshold, the smaller id first.

    A group of more than ``expanded`` copies is not expanded: its members are paired with its
    smallest id only, and links to other texts are given for that id and from it to each member.
    """
    links, members = near_duplicates(records, words, threshold)
    members = cut(members.filter("long").drop("long"))
    groups = members.groupBy("doc").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    sized = members.join(groups, "doc")
    small, hub = F.col("n") <= expanded, F.col("id") == F.col("first")
    expand = sized.filter(small | hub).select("doc", "record_kind", "id")
    several = sized.filter(small & (F.col("n") > 1)).select("doc", "record_kind", "id")
    other = several.select("doc", F.col("id").alias("other"))
    copies = several.join(other, "doc").filter("id < other").select("record_kind", F.col("id").alias("x"), F.col("other").alias("y"))
    stars = sized.filter(~small & ~hub).select("record_kind", F.col("first").alias("x"), F.col("id").alias("y"))
    linked = links.join(expand.select(F.col("doc").alias("a"), "record_kind", F.col("id").alias("x")), "a").join(expand.select(F.col("doc").alias("b"), F.col("id").alias("y")), "b")
    every = copies.unionByName(stars).unionByName(linked.select("record_kind", "x", "y"))
    return every.select("record_kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).filter("id_a <> id_b").distinct()


def near_duplicate_classes(records: DataFrame, words: int = 5, threshold: float = 0.8, rounds: int = 60) -> DataFrame:
    """One row per record, ``(record_kind, id, class_id, n_links)``: the connected class and the links of its text.

    Classes are found by passing the smallest text along the links and jumping to the label of
    that label; each round is a join and an aggregation, its lineage cut. Should ``rounds`` not be
    enough, that is an error.
    """
    links, members = near_duplicates(records, words, threshold)
    links, members = cut(links.select("a", "b")), cut(members)
    both = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")))
    for _ in range(rounds):
        seen = both.join(labels.select(F.col("a").alias("b"), F.col("label").alias("theirs")), "b").groupBy("a").agg(F.min("theirs").alias("theirs"))
        new = labels.join(seen, "a").select("a", F.least("label", "theirs").alias("new"), F.col("label").alias("old"))
        jump = new.select(F.col("a").alias("j"), F.col("new").alias("jumped"))
        new = cut(new.join(jump, F.col("new") == F.col("j"), "left").select("a", F.least("new", F.coalesce("jumped", "new")).alias("label"), "old"))
        labels = new.select("a", "label")
        if not new.filter("label <> old").limit(1).count():
            break
    else:
        raise RuntimeError(f"the classes still change after {rounds} rounds")
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("n_links"))
    out = members.join(labels.withColumnRenamed("a", "doc"), "doc", "left").join(degree.withColumnRenamed("a", "doc"), "doc", "left")
    return out.select("record_kind", "id", F.coalesce("label", "doc").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
