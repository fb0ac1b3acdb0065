"""Relational kernels of image forensics: tiles, percentiles, entropy, nearest neighbours, translation clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.session import cut


def zscores(tiles: DataFrame, by: str, value: str) -> DataFrame:
    """Adds z = (value - mean) / (population deviation + 1e-6) over each group.

    The moments are partial aggregates joined back, not a window, so a group of any size is never in one task.
    """
    m = tiles.groupBy(by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return tiles.join(m, by).withColumn("z", (F.col(value) - F.col("_m")) / (F.col("_s") + 1e-6)).drop("_m", "_s")


def tile_summary(tiles: DataFrame, by: str, value: str) -> DataFrame:
    """max_tile_z, mean and deviation of the tile values of each group."""
    m = tiles.groupBy(by).agg(F.max(value).alias("hi"), F.avg(value).alias("mean_abs_resid"), F.stddev_pop(value).alias("std_tile"))
    return m.select(by, ((F.col("hi") - F.col("mean_abs_resid")) / (F.col("std_tile") + 1e-6)).alias("max_tile_z"), "mean_abs_resid", "std_tile")


def quantiles(df: DataFrame, by: str, value: str, ps: dict[str, float]) -> DataFrame:
    """(by, one column per name): exact percentiles by linear interpolation of the values that are neither null nor NaN.

    A group of any size is spread over tasks: its distinct values with their counts are partitioned by range, ranked in
    each partition, and ranks go on from the counts of the partitions before. Nothing holds the values of a group. Groups
    without any value have no row; a null group is a group.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = F.col(value).cast("double")
    counts = df.select(F.col(by).alias("_by"), x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x")).groupBy("_by", "_x").agg(F.count("*").alias("_c"))
    ranged = cut(counts.repartitionByRange(n, "_by", "_x").withColumn("_part", F.spark_partition_id()))
    # One row for each group and partition that it reaches into: as many as groups and partitions together.
    each = ranged.groupBy("_by", "_part").agg(F.sum("_c").alias("_s"))
    before = Window.partitionBy("_by").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select(F.col("_by").alias("_g"), F.col("_part").alias("_p"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"), F.sum("_s").over(Window.partitionBy("_by")).alias("_n"))
    inside = Window.partitionBy("_by", "_part").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranged.withColumn("_upto", F.sum("_c").over(inside)).join(each, F.col("_by").eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    ranked = ranked.withColumn("_to", F.col("_before") + F.col("_upto")).withColumn("_from", F.col("_to") - F.col("_c"))
    at = {k: (F.col("_n") - 1) * p for k, p in ps.items()}
    value_at = lambda i: F.max(F.when((F.col("_from") <= i) & (i < F.col("_to")), F.col("_x")))
    g = ranked.groupBy("_by").agg(F.first("_n").alias("_n"), *[c for k, i in at.items() for c in (value_at(F.floor(i)).alias(f"_lo_{k}"), value_at(F.ceil(i)).alias(f"_hi_{k}"))])
    return g.select(F.col("_by").alias(by), *[(F.col(f"_lo_{k}") + (i - F.floor(i)) * (F.col(f"_hi_{k}") - F.col(f"_lo_{k}"))).alias(k) for k, i in at.items()])


def _beside(df: DataFrame, found: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """Join a group's row to its rows; null groups meet, too."""
    return df.join(found.withColumnRenamed(by, "_g"), F.col(by).eqNullSafe(F.col("_g")), how).drop("_g")


def percentiles(df: DataFrame, by: str, value: str, ps: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    return quantiles(df, by, value, {f"p{round(p * 100)}": p for p in ps})


def above_percentile(df: DataFrame, by: str, value: str, p: float = 0.993) -> DataFrame:
    """Rows at or above the group's percentile."""
    return _beside(df, quantiles(df, by, value, {"_t": p}), by).where(F.col(value) >= F.col("_t")).drop("_t")


def median_mad(df: DataFrame, by: str, value: str) -> DataFrame:
    """Median and median absolute deviation, in two passes."""
    m = cut(quantiles(df, by, value, {"median": 0.5}))
    off = _beside(df.select(by, value), m, by).select(by, F.abs(F.col(value) - F.col("median")).alias("_d"))
    return _beside(m, quantiles(off, by, "_d", {"mad": 0.5}), by)


def entropy(df: DataFrame, by: str, symbol: Column) -> DataFrame:
    """Shannon entropy in bits of the symbols of each group."""
    c = df.groupBy(by, symbol.alias("_x")).agg(F.count("*").alias("c"))
    n = c.groupBy(by).agg(F.sum("c").alias("n"))
    p = F.col("c") / F.col("n")
    return c.join(n, by).groupBy(by).agg((-F.sum(p * F.log2(p))).alias("entropy"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v)


def knn_ratio(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", ratio: float = 0.75, block_rows: int = 20_000, block_queries: int = 2_000) -> DataFrame:
    """(query, neighbour, d1, d2, good): the nearest other vector of each query and whether it passes the ratio test.

    Squared distances; good where d1 < ratio^2 * d2. A stated query set meets all vectors block by block: the numbers of
    blocks of both sides follow their counts, so a task compares at most about ``block_rows`` x ``block_queries``. A
    block keeps its two nearest per query, and only those are compared across blocks. Ties go to the smaller id. Exact.
    """
    nb = max(4, -(-vectors.count() // block_rows))
    nq = max(1, -(-queries.count() // block_queries))
    q = queries.select(F.col(id_col).alias("query"), F.col(vec_col).alias("qv")).withColumn("qb", F.pmod(F.xxhash64("query"), F.lit(nq)))
    q = q.withColumn("bb", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    base = vectors.select(F.col(id_col).alias("neighbour"), F.col(vec_col).alias("bv")).withColumn("bb", F.pmod(F.xxhash64("neighbour"), F.lit(nb)))
    base = base.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    d = q.join(base, ["qb", "bb"]).where("query <> neighbour").withColumn("d", _dot(F.col("qv"), F.col("bv")))
    top = F.row_number().over(Window.partitionBy("query", "bb").orderBy("d", "neighbour"))
    two = d.select("query", "bb", "d", "neighbour").withColumn("r", top).where("r <= 2")
    g = two.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "neighbour"))), 1, 2).alias("near"))
    d1, d2 = F.get("near", 0), F.get("near", 1)
    return g.select("query", d1["neighbour"].alias("neighbour"), d1["d"].alias("d1"), d2["d"].alias("d2"), (d1["d"] < ratio * ratio * d2["d"]).alias("good"))


def translation_clusters(matches: DataFrame, by: str, bin_size: float = 14, least: int = 18, top: int = 2, pad: int = 12) -> DataFrame:
    """The largest clusters of equal translation per group, with padded boxes of both ends.

    ``matches``: by, x, y, tx, ty. Counts are partial aggregates; only bins with at least ``least`` matches are ranked.
    """
    b = lambda a, z: F.floor((F.col(z) - F.col(a)) / bin_size).cast("long")
    box = []
    for n, (x, y) in {"src": ("x", "y"), "dst": ("tx", "ty")}.items():
        x0, y0 = F.greatest(F.min(x) - pad, F.lit(0)), F.greatest(F.min(y) - pad, F.lit(0))
        box += [x0.alias(f"{n}_x"), y0.alias(f"{n}_y"), F.greatest(F.max(x) + pad - x0, F.lit(1)).alias(f"{n}_w"), F.greatest(F.max(y) + pad - y0, F.lit(1)).alias(f"{n}_h")]
    g = matches.groupBy(by, b("x", "tx").alias("bin_x"), b("y", "ty").alias("bin_y")).agg(F.count("*").alias("n"), *box).where(F.col("n") >= least)
    r = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "bin_x", "bin_y"))
    return g.withColumn("rank", r).where(F.col("rank") <= top)
