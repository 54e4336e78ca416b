"""One ranking from several differently-scaled scores: leximin over percentile vectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ravelin.operators.ranking import has_hot_group, spread_row_number

HOT_GROUP_ROWS = 200_000


def _oriented(df: DataFrame, group: str, item: str, scores: Mapping[str, str]) -> DataFrame:
    """One row per (group, item) with columns s0.. where larger is better; repeated rows keep the best."""
    picked = []
    for n, (name, better) in enumerate(scores.items()):
        value = F.col(f"`{name}`").cast("double")
        value = F.when(F.isnan(value), None).otherwise(value)
        picked.append((F.max(-value) if better == "small" else F.max(value)).alias(f"s{n}"))
    return df.groupBy(F.col(f"`{group}`").alias("g"), F.col(f"`{item}`").alias("i")).agg(*picked)


def _vector(marks: Sequence[Column]) -> Column:
    return F.array_sort(F.array(*marks))


def _window_marks(rows: DataFrame, n: int) -> DataFrame:
    """Percentiles with windows: a task per group, groups of bounded size."""
    whole, marks = W.partitionBy("g"), []
    size = F.count(F.lit(1)).over(whole)
    for k in range(n):
        by = W.partitionBy("g").orderBy(F.col(f"s{k}").asc_nulls_first())
        below, upto = F.rank().over(by) - 1, F.cume_dist().over(by) * size
        mark = (below + F.round(upto) - 1) / 2 / (size - 1)
        marks.append(
            F.when(F.count(f"s{k}").over(whole) == 0, F.lit(1.0))
            .when(F.col(f"s{k}").isNull(), F.lit(0.0))
            .otherwise(F.when(size == 1, F.lit(1.0)).otherwise(mark))
            .alias(f"m{k}")
        )
    return rows.select("g", "i", *marks)


def _spread_marks(rows: DataFrame, n: int) -> DataFrame:
    """The same percentiles for groups of any size: counts of distinct values, placed by range."""
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("size"), *[F.count(f"s{k}").alias(f"c{k}") for k in range(n)])
    out = rows
    for k in range(n):
        counts = rows.filter(F.col(f"s{k}").isNotNull()).groupBy("g", F.col(f"s{k}").alias("v")).agg(F.count(F.lit(1)).alias("c"))
        placed = spread_row_number(counts, ["g"], ["v"], "at").withColumn("slab", F.floor((F.col("at") - 1) / 4096))
        inside = W.partitionBy("g", "slab").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
        before = W.partitionBy("g").orderBy("slab").rowsBetween(W.unboundedPreceding, -1)
        slabs = placed.groupBy("g", "slab").agg(F.sum("c").alias("sc")).withColumn("sb", F.coalesce(F.sum("sc").over(before), F.lit(0)))
        below = placed.withColumn("lb", F.coalesce(F.sum("c").over(inside), F.lit(0))).join(slabs.drop("sc"), ["g", "slab"])
        below = below.select(F.col("g").alias("vg"), "v", (F.col("lb") + F.col("sb")).alias(f"b{k}"), F.col("c").alias(f"t{k}"))
        out = out.join(below, F.col("g").eqNullSafe(F.col("vg")) & (F.col(f"s{k}") == F.col("v")), "left").drop("vg", "v")
    out = out.join(sizes.withColumnRenamed("g", "sg"), F.col("g").eqNullSafe(F.col("sg")))
    marks = []
    for k in range(n):
        absent = F.col("size") - F.col(f"c{k}")
        mark = (2 * (F.col(f"b{k}") + absent) + F.col(f"t{k}") - 1) / 2 / (F.col("size") - 1)
        marks.append(
            F.when(F.col(f"c{k}") == 0, F.lit(1.0))
            .when(F.col(f"s{k}").isNull(), F.lit(0.0))
            .otherwise(F.when(F.col("size") == 1, F.lit(1.0)).otherwise(mark))
            .alias(f"m{k}")
        )
    return out.select("g", "i", *marks)


def leximin_rank(df: DataFrame, group: str, item: str, scores: Mapping[str, str], k: int | None = None, hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """Rank the items of each group by all scores at once; ``(group, item, percentiles, place)``.

    ``scores`` maps a column to "large" or "small", whichever is better. Each score becomes its
    mid-rank percentile inside the group, so scale, spread and outliers do not count. An item's
    percentiles are sorted ascending and compared lexicographically, larger first: the weakest
    score decides, then the next weakest. Equal vectors are ordered by the item. ``k`` keeps the
    first k places.

    Nulls and NaN: an absent score is percentile 0, unless the whole group lacks it (then 1 for
    all, which decides nothing). Repeated (group, item) rows count once with their best values. A
    null group is a group, a null item an item. Other columns are ignored. An empty table gives
    an empty table. Groups above ``hot_rows`` rows are ranked by range partitions, not in one task.
    """
    n = len(scores)
    hot = has_hot_group(df.select(F.col(f"`{group}`").alias("g")), ["g"], hot_rows)
    rows = _oriented(df if hot else df.select(*{group: 0, item: 0, **scores}).repartition(F.col(f"`{group}`")), group, item, scores)
    marked = (_spread_marks if hot else _window_marks)(rows, n)
    vectors = marked.withColumn("v", _vector([F.col(f"m{x}") for x in range(n)]))
    if hot and k is None:
        flipped = vectors.select("*", *[(-F.col("v")[x]).alias(f"o{x}") for x in range(n)])
        placed = spread_row_number(flipped, ["g"], [*[f"o{x}" for x in range(n)], "i"], "place")
    else:
        placed = vectors.withColumn("place", F.row_number().over(W.partitionBy("g").orderBy(F.col("v").desc(), "i")))
        placed = placed if k is None else placed.filter(F.col("place") <= k)
    return placed.select(F.col("g").alias(group), F.col("i").alias(item), F.array(*[F.col(f"m{x}") for x in range(n)]).alias("percentiles"), "place")
