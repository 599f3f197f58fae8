"""Percentile cutoffs and the dual gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perigee.operators.ranks import cell_sums, with_cells
from perigee.params import top_fraction


def cutoffs(rows: DataFrame, column: str, fractions: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., fraction, cutoff): the value at rank max(1, ceil(n * fraction)) of the descending order; -Infinity for
    a fraction that keeps all.

    Values are counted, counts are summed over ranges of values, and only the range that holds a rank is sorted.
    """
    by = by or []
    counted = rows.groupBy(*by, F.coalesce(column, F.lit(0.0)).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    placed = with_cells(counted, "v", by)
    cells = cell_sums(placed, "n", by, descending=True)
    asked = cells.withColumn("fraction", F.explode(F.array(*map(F.lit, fractions))))
    keep = F.greatest(F.lit(1.0), F.ceil(F.col("total") * F.col("fraction")).cast("double"))
    hit = asked.withColumn("keep", keep).where("ahead < keep AND keep <= ahead + own").select(*by, "cell", "fraction", "keep", "ahead")
    w = Window.partitionBy(*by, "fraction").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.join(hit, [*by, "cell"]).withColumn("through", F.col("ahead") + F.sum("n").over(w))
    cut = F.when(F.col("fraction") >= 0.999, F.lit(float("-inf"))).otherwise(F.max(F.when(F.col("through") >= F.col("keep"), F.col("v"))))
    return ranked.groupBy(*by, "fraction").agg(cut.alias("cutoff"))


def cutoff(rows: DataFrame, column: str, fraction: float, by: list[str] | None = None) -> DataFrame:
    """(by..., cutoff) of one fraction; without rows and groups one null (or -Infinity)."""
    by = by or []
    if fraction >= 0.999:
        return rows.groupBy(*by).agg(F.lit(float("-inf")).alias("cutoff"))
    return cutoffs(rows, column, [fraction], by).groupBy(*by).agg(F.max("cutoff").alias("cutoff"))


def dual_gate(novelty: Column, authorship: Column, override: Column, cut_n: Column, cut_a: Column, select_n: float, select_a: float) -> Column:
    """Both signals reach their cutoff and, above selectivity 1, the selectivity itself; a prominent author
    stands in for the authorship signal."""
    nov = (novelty >= cut_n) & (F.lit(select_n <= 1) | (novelty >= F.lit(float(select_n))))
    auth = (authorship >= cut_a) & (F.lit(select_a <= 1) | (authorship >= F.lit(float(select_a))))
    return nov & (auth | F.coalesce(override, F.lit(False)))


def gated(rows: DataFrame, select_n: float, select_a: float, by: list[str] | None = None) -> DataFrame:
    """The rows (novelty, authorship, override) that pass, cutoffs taken over all rows (of each group)."""
    by = by or []
    n = cutoff(rows, "novelty", top_fraction(select_n), by).withColumnRenamed("cutoff", "cut_n")
    a = cutoff(rows, "authorship", top_fraction(select_a), by).withColumnRenamed("cutoff", "cut_a")
    if by:
        both = rows.join(n, by).join(a, by)
    else:  # one row each
        both = rows.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(a))
    nov, auth = F.coalesce("novelty", F.lit(0.0)), F.coalesce("authorship", F.lit(0.0))
    return both.where(dual_gate(nov, auth, F.col("override"), F.col("cut_n"), F.col("cut_a"), select_n, select_a))
