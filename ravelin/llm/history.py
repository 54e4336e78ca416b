"""Deduplicating new batches against everything accepted before, through a segment index."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ravelin.session import cut, drop_path, planned_once, release, scratch_path

TAU = 1
ORDER = ("batch_no", "arrival_no", "doc_id")
#: The most sets of a slice that may look for partners under one hash.
MEETING = 256
#: Records and hashes of a batch to a partition of its steps, of which there are no more than the session's shuffle partitions.
SHARE = 2048
#: Lengths of the strings of an index, unless given: a SHA-256 in hex, and up to two digits lost or added.
LENGTHS = (62, 63, 64, 65, 66)
#: Table, columns (the first is the one its buckets are made by).
TABLES = {"segments": "key long, s string, canon string", "posts": "key long, node long, n int, lead boolean", "nodes": "node long, keys array<long>"}


def real_hash(column: Column) -> Column:
    """A SHA-256 in lower-case hex however it is spelled; null for placeholders and anything else."""
    bare = F.regexp_replace(F.lower(F.trim(column)), r"^(sha-?256\s*[:=\-]?\s*|0x)", "")
    bare = F.regexp_replace(bare, r"[\s:\-]", "")
    return F.when(bare.rlike("^[0-9a-f]{62,66}$") & ~bare.rlike(r"^(.)\1*$"), bare)


def segment_bounds(length: int, tau: int) -> list[tuple[int, int]]:
    """``tau + 1`` even segments ``(position, length)`` of a string of ``length`` characters."""
    base, longer = divmod(length, tau + 1)
    out, at = [], 0
    for n in range(tau + 1):
        size = base + (n >= tau + 1 - longer)
        out.append((at, size))
        at += size
    return out


def probe_bounds(length: int, indexed: int, tau: int) -> list[tuple[int, int, int, int]]:
    """Substrings ``(segment, indexed position, start, size)`` of a probe that may equal a segment of a string of ``indexed`` characters.

    Of the starts within ``tau``, those that a bounded alignment can reach from the left (segment
    n allows n edits before it) and from the right (the others behind it) are kept; they suffice.
    """
    shift = length - indexed
    out = []
    for n, (at, size) in enumerate(segment_bounds(indexed, tau)):
        low, high = max(at - n, at + shift - (tau - n)), min(at + n, at + shift + (tau - n))
        for start in range(max(0, low), min(length - size, high) + 1):
            out.append((n, at, start, size))
    return out


def within(a: str, b: str, tau: int) -> bool:
    """Whether the edit distance is at most ``tau``: a band of the table, left early."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > tau:
        return False
    big = tau + 1
    row = {j: j for j in range(min(len(b), tau) + 1)}
    for i in range(1, len(a) + 1):
        new = {}
        for j in range(max(0, i - tau), min(len(b), i + tau) + 1):
            new[j] = i if j == 0 else min(row.get(j - 1, big) + (a[i - 1] != b[j - 1]), row.get(j, big) + 1, new.get(j - 1, big) + 1)
        if min(new.values()) > tau:
            return False
        row = new
    return row.get(len(b), big) <= tau


def segments(strings: DataFrame, tau: int, *more: str) -> DataFrame:
    """Index rows ``(scope, length, n, segment, s)``, and the columns ``more``, of distinct ``(scope, s)``."""
    size = F.length("s")
    posts = []
    for n in range(tau + 1):
        base, longer = F.floor(size / (tau + 1)).cast("int"), size % (tau + 1)
        at = base * n + F.greatest(F.lit(0), F.lit(n) - (F.lit(tau + 1) - longer))
        width = base + F.when(F.lit(n) >= F.lit(tau + 1) - longer, 1).otherwise(0)
        posts.append(F.struct(F.lit(n).alias("n"), F.col("s").substr(at + 1, width).alias("segment")))
    return strings.select("scope", size.alias("length"), "s", *more, F.explode(F.array(*posts)).alias("p")).select("scope", "length", "p.n", "p.segment", "s", *more)


def probes(strings: DataFrame, lengths: Sequence[int], tau: int) -> DataFrame:
    """Probe rows ``(scope, length, n, segment, s)`` of distinct ``(scope, s)`` for indexed ``lengths``."""
    parts = []
    for own in sorted({x + d for x in lengths for d in range(-tau, tau + 1)}):
        posts = [
            F.struct(F.lit(x).alias("length"), F.lit(n).alias("n"), F.substring("s", start + 1, size).alias("segment"))
            for x in lengths if abs(x - own) <= tau for n, _, start, size in probe_bounds(own, x, tau)
        ]
        parts.append(F.when(F.length("s") == own, F.array(*posts)))
    parts = parts or [F.array().cast("array<struct<length:int,n:int,segment:string>>")]
    return strings.select("scope", "s", F.explode(F.coalesce(*parts)).alias("p")).select("scope", "p.length", "p.n", "p.segment", "s")


def keyed(posts: DataFrame) -> DataFrame:
    """Segment or probe rows ``(key, scope, s, ...)`` under the hash of their scope, length, position and segment."""
    return posts.withColumn("key", F.xxhash64("scope", "length", "n", "segment")).drop("length", "n", "segment")


def matches(asked: DataFrame, index: DataFrame) -> DataFrame:
    """Candidates ``(scope, s, t, canon)``: keyed probes met with keyed segments ``(key, s, canon)``.

    The probes are the side that is hashed and moved; an index bucketed by ``key`` stays where it is.
    """
    return asked.hint("shuffle_hash").join(index.select("key", F.col("s").alias("t"), "canon"), "key").select("scope", "s", "t", "canon")


def verified(found: DataFrame, tau: int) -> DataFrame:
    """The candidates whose strings ``s`` and ``t`` are within ``tau`` edits."""
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows[[within(a, b, tau) for a, b in zip(rows.s, rows.t)]]

    return found.mapInPandas(verify, found.schema)


class HistoryIndex:
    """Everything accepted so far, as bucketed tables in ``path`` that batches are probed against and appended to.

    ``segments``: for each distinct string (a real content hash or a chunk's text hash, in its
    scope, which is the knowledge base and the kind) its ``tau + 1`` segments by length and
    position. ``nodes``: each distinct set of strings that a record is known by: its chunk hashes,
    or its content hash alone. ``posts``: each node under each of its strings. All hold only what
    accepted records brought and nothing twice. A probe moves the batch's own keys to the buckets;
    the tables are read where they are, and only rows the batch meets go further, so that what is
    shuffled, sorted and checked grows with the batch. Strings are keyed by 64-bit hashes.
    """

    def __init__(self, spark: SparkSession, path: str, tau: int = TAU, buckets: int | None = None, lengths: Sequence[int] = LENGTHS):
        self.spark, self.path, self.tau, self.lengths = spark, path, tau, lengths
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"history_{xxhash.xxh3_64_hexdigest(path)}"
        for table, ddl in TABLES.items():
            by = ddl.split()[0]
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name}_{table} ({ddl}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{path}/{table}'")

    def _read(self, table: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{table}")

    def _write(self, df: DataFrame, table: str) -> None:
        columns = [c.split()[0] for c in TABLES[table].split(", ")]
        df.select(*columns).repartition(self.buckets, columns[0]).write.insertInto(f"{self.name}_{table}")

    def drop(self) -> None:
        for table in TABLES:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{table}")
        drop_path(self.spark, self.path)

    def _canonical(self, strings: DataFrame) -> DataFrame:
        """Each distinct batch string with the one that stands for it: an indexed match's, else the smallest batch string within ``tau``; ``known`` if the very string is indexed."""
        asked = keyed(probes(strings, self.lengths, self.tau))
        own = matches(asked, keyed(segments(strings, self.tau)).withColumn("canon", F.col("s"))).withColumn("old", F.lit(False))
        found = verified(own.unionByName(matches(asked, self._read("segments")).withColumn("old", F.lit(True))), self.tau)
        best = F.min_by(F.when(F.col("old"), F.col("canon")), F.struct(~F.col("old"), F.col("s") != F.col("t"), F.col("canon")))
        return found.groupBy("scope", "s").agg(F.coalesce(best, F.min("canon")).alias("canon"), F.max(F.col("old") & (F.col("s") == F.col("t"))).alias("known"))

    def take(self, records: DataFrame, hashes: DataFrame) -> DataFrame:
        """Accept or refuse the records of a batch; ``(doc_id, scope, accepted)``, appended to the index.

        ``records``: ``doc_id, scope, batch_no, arrival_no, content_hash``, one row each;
        ``hashes``: ``doc_id, hash``. Records are taken in their order; a record is refused if an
        earlier accepted one of its scope has its real content hash, or shares at least half of
        the distinct hashes of whichever of the two has fewer. Hashes within ``tau`` edits are
        the same hash; those of another length than ``lengths`` say nothing. Records without
        hashes match by content only. Nulls: a null scope is the scope of nulls; a record with a
        null doc_id is ignored, null hashes say nothing.
        """
        refused = self.refused(records, hashes).withColumn("accepted", F.lit(False))
        recs = records.filter("doc_id is not null").select("doc_id", "scope")
        return recs.join(refused, "doc_id", "left").select("doc_id", "scope", F.coalesce("accepted", F.lit(True)).alias("accepted"))

    def refused(self, records: DataFrame, hashes: DataFrame) -> DataFrame:
        """As ``take``, but only the records that are refused, ``(doc_id)``.

        A batch is one slice unless a hash has more than ``MEETING`` sets that look for partners
        under it: then the records up to there are settled and appended first, and the others,
        of which the index now refuses nearly all, are probed again. No group is paired out.
        """
        recs = records.filter("doc_id is not null").select(
            "doc_id", F.coalesce("scope", F.lit("\0null")).alias("scope"), F.struct(*ORDER).alias("at"), real_hash(F.col("content_hash")).alias("bytes")
        )
        own = hashes.filter(F.length("hash").isin(*self.lengths)).join(recs.select("doc_id", "scope", "at"), "doc_id").select("doc_id", "at", F.concat(F.lit("c/"), "scope").alias("scope"), F.lower("hash").alias("s"))
        posted = own.unionByName(recs.filter("bytes is not null").select("doc_id", "at", F.concat(F.lit("b/"), "scope").alias("scope"), F.col("bytes").alias("s")))
        posted = cut(posted.join(self._canonical(posted.select("scope", "s").distinct()), ["scope", "s"]))
        sets = posted.groupBy("doc_id", "scope", "at").agg(F.array_sort(F.collect_set(F.xxhash64("scope", "canon"))).alias("keys"))
        left = cut(sets.select("doc_id", "at", F.xxhash64("scope", "keys").alias("node"), "keys"))
        refused = []
        while True:
            posts = self._posts(left)
            until = self._until(posts, left)
            part = left if until is None else cut(left.filter(F.col("at") < until))
            here = posts if until is None else posts.join(part.select("node").withColumn("old", F.lit(False)).distinct(), ["node", "old"], "left_semi").unionByName(posts.filter("old"))
            state = self._resolve(part, self._links(here, part))
            self._append(posted, posts, part, state.filter("accepted").select("doc_id").distinct())
            refused.append(state.filter("not accepted").select("doc_id").distinct())
            if until is None:
                return reduce(DataFrame.unionByName, refused)
            left = cut(left.join(part.select("doc_id").distinct(), "doc_id", "left_anti"))

    def _posts(self, owns: DataFrame) -> DataFrame:
        """``(key, node, n, lead, old, df)``: the batch's nodes under their strings, and what the index holds under the same.

        Of the smaller node of a linked pair any ``floor(n / 2) + 1`` strings must meet one of the
        larger; the rarest of them, counted over index and batch, are its ``lead``.
        """
        posts = owns.groupBy("node").agg(F.first("keys").alias("keys")).select("node", F.size("keys").alias("n"), F.explode("keys").alias("key"))
        met = self._read("posts").join(posts.select("key").distinct().hint("shuffle_hash"), "key").select("key", "node", "n", "lead", F.lit(True).alias("old"))
        both = posts.select("key", "node", "n", F.lit(False).alias("lead"), F.lit(False).alias("old")).unionByName(met)
        both = both.join(both.groupBy("key").agg(F.count(F.lit(1)).alias("df")), "key")
        rarest = F.row_number().over(W.partitionBy("node", "old").orderBy("df", "key"))
        return cut(both.withColumn("lead", F.when(F.col("old"), F.col("lead")).otherwise(rarest <= F.floor(F.col("n") / 2) + 1)))

    def _until(self, posts: DataFrame, left: DataFrame) -> Column | None:
        """The place from which on records wait, because too many before it meet under one string; None if none do."""
        if (posts.filter("lead and not old").agg(F.max("df")).first()[0] or 0) <= MEETING:
            return None
        leads = posts.filter("lead and not old and df > 1")
        hot = leads.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > MEETING)
        if hot.isEmpty():
            return None
        placed = leads.join(hot.select("key"), "key", "left_semi").join(left.groupBy("node").agg(F.min("at").alias("at")), "node")
        ranked = placed.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy("at"))).filter(F.col("r") <= MEETING + 1)
        at = ranked.filter(F.col("r") == MEETING + 1).agg(F.min("at").alias("at")).first().at
        return F.struct(*[F.lit(value).cast(kind) for value, kind in zip(at, ("int", "long", "string"))])

    def _links(self, posts: DataFrame, owns: DataFrame) -> DataFrame:
        """Links ``(node, other, old)`` of the slice's nodes to each other, both ways, and to indexed ones.

        The lead of the smaller meets the other under a string; the candidates share at least half
        of the strings of the smaller, or are the same set.
        """
        shared = posts.filter("df > 1")
        small = shared.filter("lead").select("key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("old").alias("oa"))
        met = small.join(shared.select("key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("old").alias("ob")), "key").filter("na <= nb and not (oa and ob) and (a <> b or oa <> ob)")
        mine, theirs = F.when(F.col("oa"), F.col("b")).otherwise(F.col("a")), F.when(F.col("oa"), F.col("a")).otherwise(F.col("b"))
        pairs = cut(met.select(mine.alias("node"), theirs.alias("other"), (F.col("oa") | F.col("ob")).alias("old")).distinct())
        nodes = owns.groupBy("node").agg(F.first("keys").alias("x"))
        inside = pairs.filter("not old").join(nodes.withColumnsRenamed({"node": "other", "x": "y"}), "other")
        sets = self._read("nodes").join(pairs.filter("old").select(F.col("other").alias("node")).distinct().hint("shuffle_hash"), "node").select(F.col("node").alias("other"), F.col("keys").alias("y"))
        both = inside.unionByName(pairs.filter("old").join(sets, "other")).join(nodes, "node")
        linked = both.filter(2 * F.size(F.array_intersect("x", "y")) >= F.least(F.size("x"), F.size("y"))).select("node", "other", "old")
        ways = F.when(F.col("old"), F.array(F.struct("node", "other"))).otherwise(F.array(F.struct("node", "other"), F.struct(F.col("other").alias("node"), F.col("node").alias("other"))))
        return linked.select("old", F.explode(ways).alias("w")).select("w.node", "w.other", "old")

    def _resolve(self, owns: DataFrame, links: DataFrame) -> DataFrame:
        """Greedy acceptance in order, ``(doc_id, accepted, ...)``, in rounds over the records still open.

        Only the earliest accepted record of a node can matter to later ones, so a round compares
        each record with one place per node, never the pairs of a group of copies. A record with an
        earlier accepted rival is refused; one without an earlier open rival is accepted.
        """
        watched = owns.select("doc_id", "at", "node", F.lit(True).alias("own"), F.lit(False).alias("hit"))
        rivals = owns.select("doc_id", "at", "node").join(links, "node").select("doc_id", "at", F.col("other").alias("node"), F.lit(False).alias("own"), F.col("old").alias("hit"))
        state = watched.unionByName(rivals).withColumn("accepted", F.lit(None).cast("boolean"))
        first = lambda which: F.min(F.when(F.col("own") & which, F.col("at")))
        while True:
            places = state.groupBy("node").agg(first(F.col("accepted")).alias("taken"), first(F.col("accepted").isNull()).alias("ahead"))
            judged = state.filter("accepted is null").join(places, "node").groupBy("doc_id").agg(
                F.max(F.col("hit") | F.coalesce(F.col("taken") < F.col("at"), F.lit(False))).alias("refused"), F.max(F.coalesce(F.col("ahead") < F.col("at"), F.lit(False))).alias("blocked")
            ).select("doc_id", F.when(F.col("refused"), False).when(~F.col("blocked"), True).alias("now"))
            state = cut(state.join(judged, "doc_id", "left").withColumn("accepted", F.coalesce("accepted", "now")).drop("now"))
            if state.filter("accepted is null").isEmpty():
                return state

    def _append(self, posted: DataFrame, posts: DataFrame, part: DataFrame, accepted: DataFrame) -> None:
        """Add what the accepted records bring: their nodes, the postings of these, the segments of new strings."""
        nodes = part.join(accepted, "doc_id", "left_semi").groupBy("node").agg(F.first("keys").alias("keys"))
        fresh = posted.filter("not known").join(accepted, "doc_id", "left_semi").groupBy("scope", "s").agg(F.first("canon").alias("canon"))
        tables = {"nodes": nodes, "posts": posts.filter("not old").join(nodes.select("node"), "node", "left_semi"), "segments": keyed(segments(fresh, self.tau, "canon"))}
        with ThreadPoolExecutor(len(tables)) as writers:  # three small jobs side by side
            for written in [writers.submit(self._write, rows, table) for table, rows in tables.items()]:
                written.result()


def refuse_repetitions(documents: DataFrame, chunks: DataFrame, tau: int = TAU) -> DataFrame:
    """Records that are not accepted, ``(doc_id)``: batch 0 makes the history, each later batch is probed and appended in turn.

    ``documents``: ``doc_id, kb_id, batch_no, arrival_no, content_hash``; ``chunks``: ``doc_id,
    embed_text``. A chunk's hash is the SHA-256 of its embed_text, so hashes that are null,
    misspelled or missing (chunks never embedded) are right as well. Repeated rows of a doc_id
    are one record, at its earliest place. A null batch_no is batch 0, a null arrival_no sorts
    first, rows with a null doc_id are ignored. Empty tables give an empty result.
    """
    spark = documents.sparkSession
    records = (
        documents.select("doc_id", "kb_id", F.coalesce(F.col("batch_no").cast("int"), F.lit(0)).alias("batch_no"), "arrival_no", "content_hash").filter("doc_id is not null").groupBy("doc_id")
        .agg(F.min(F.struct("batch_no", "arrival_no", "kb_id")).alias("r"), F.max(real_hash(F.col("content_hash"))).alias("content_hash"))
        .select("doc_id", F.col("r.kb_id").alias("scope"), "r.batch_no", F.col("r.arrival_no").cast("long").alias("arrival_no"), "content_hash")
    )
    hashes = chunks.select("doc_id", F.sha2("embed_text", 256).alias("hash")).filter("hash is not null").distinct()
    path = scratch_path(spark, "history")
    staged = {"records": records, "hashes": hashes.join(records.select("doc_id", "batch_no"), "doc_id")}
    for name, rows in staged.items():  # each batch by itself, as it would arrive
        rows.withColumn("batch", F.col("batch_no")).repartition("batch", F.pmod(F.xxhash64("doc_id"), F.lit(8))).write.partitionBy("batch").parquet(f"{path}/{name}")
    steps = planned_once(spark)
    records, hashes = (steps.read.schema(rows.schema.add("batch", "integer")).parquet(f"{path}/{name}") for name, rows in staged.items())
    index = HistoryIndex(steps, f"{path}/index", tau)
    batches = records.select("batch").unionByName(hashes.select("batch")).groupBy("batch").count().orderBy("batch").collect()  # a row per batch
    refused = []
    for batch, rows in batches:
        steps.conf.set("spark.sql.shuffle.partitions", str(min(index.buckets, -(-rows // SHARE))))
        here = F.col("batch") == batch
        refused.append(index.refused(records.filter(here), hashes.filter(here)))
        release(spark)
    if refused:
        reduce(DataFrame.unionByName, refused).write.parquet(f"{path}/refused")
    index.drop()
    found = cut(spark.read.schema("doc_id string").parquet(f"{path}/refused") if refused else spark.createDataFrame([], "doc_id string"))
    drop_path(spark, path)
    return found
