"""Ordering operators that do not pull a hot group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16
# Spark's default bound of the window group limit, and the parts of a group beyond it.
GROUP_LIMIT, PARTS = 1000, 64


def ordinal_within(
    df: DataFrame, keys: list[str], order: str, out: str, block: Column | None = None, block_size: int = BLOCK
) -> DataFrame:
    """Number the rows of each group from 0 by the unique ``order``: a whole number, or any column if ``block`` is given.

    A plain ``row_number`` sorts a whole group in one task. Here a group is cut into blocks of the
    order value: rows are numbered inside their block, and the running count of the blocks before
    it (a table smaller by the block size) is added.
    """
    cut = block if block is not None else F.floor(F.col(order) / block_size)
    rows = df.withColumn("_block", cut)
    counts = rows.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    numbered = rows.withColumn("_at", F.row_number().over(inside) - 1)
    return numbered.join(offsets, [*keys, "_block"]).withColumn(out, F.col("_before") + F.col("_at")).drop(
        "_block", "_at", "_before"
    )


def first_k(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows of each group, ranked from 1.

    Spark limits each group before the shuffle (window group limit) while ``k`` is small, so a hot
    group sends at most ``k`` rows per task. Above that limit the group is cut by hash first, and the
    first ``k`` of each part meet.
    """
    if k > GROUP_LIMIT:
        df = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(PARTS)))
        inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
        df = df.withColumn("_at", inside).where(F.col("_at") <= k).drop("_at", "_part")
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(out) <= k)


def first_seen(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key: the one with the smallest ``order`` columns."""
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return kept.select(*keys, "_row.*").select(*df.columns)


def cap_per_site(df: DataFrame, cap: int, keys: list[str], *order: str) -> DataFrame:
    """First ``cap`` rows per site plus whether there were more."""
    sizes = df.groupBy(*keys).agg((F.count(F.lit(1)) > cap).alias("capped"))
    return first_k(df, keys, [F.col(c) for c in order], cap, "_rank").drop("_rank").join(sizes, keys)


def even_sample_index(n: Column, k: int = 8) -> Column:
    """0-based positions of an even sample of ``k`` out of ``n``; all of them if ``n <= k``."""
    all_of_them = F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    spread = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor((i / F.lit(float(k - 1))) * (n - 1)).cast("int")
    )
    return F.when(n <= k, all_of_them).otherwise(spread)


def sanitize_cap(cap: Column, default: int = 10, most: int = 50) -> Column:
    """Page cap as a whole number in 1..``most``; the default where it is not positive and finite."""
    finite = cap.isNotNull() & ~F.isnan(cap) & (cap > 0) & (cap < F.lit(float("inf")))
    return F.least(F.greatest(F.floor(F.when(finite, cap).otherwise(F.lit(float(default))) + 0.5), F.lit(1)), F.lit(most)).cast("bigint")


def newest_per_url(runs: DataFrame, keep: int = 12) -> DataFrame:
    """History: newest entry of each URL, newest ``keep`` URLs overall.

    ``runs(url, grade, overall, scanned_at, seq)``; ``seq`` breaks ties in time.
    """
    newest = runs.groupBy("url").agg(
        F.max_by(F.struct("grade", "overall", "scanned_at", "seq"), F.struct("scanned_at", "seq")).alias("e")
    )
    return newest.select("url", "e.*").orderBy(F.desc("scanned_at"), F.desc("seq")).limit(keep)


def feed_order(progress: DataFrame, keys: list[str], top: int = 8) -> DataFrame:
    """Live feed: pages in flight, then done, then queued; higher index first; top rows per run.

    ``progress`` has ``done`` and ``started`` flags and ``page_index``.
    """
    rank = F.when(F.col("done"), 1).when(F.col("started"), 0).otherwise(2)
    status = F.when(F.col("done"), "done").when(F.col("started"), "inFlight").otherwise("queued")
    return first_k(progress.withColumn("feed_status", status), keys, [rank.asc(), F.desc("page_index")], top, "feed_pos")
