"""Running sums over sorted values without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a group's values are cut into, and the greatest value that is told apart when they are.
CELLS, LARGEST = 65_536, 8e307


def _number(value: str) -> Column:
    """A finite double in the order of the values (which may then tie): NaN is the greatest, as in a sort."""
    x = F.col(value).cast("double")
    return F.least(F.lit(LARGEST), F.greatest(F.lit(-LARGEST), F.nanvl(x, F.lit(LARGEST))))


def with_cells(counted: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The rows with `cell`: equal ranges between the least and the greatest value of each group. Any cut gives the
    same sums; even ones spread the work."""
    x = _number(value)
    bounds = counted.groupBy(*by).agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    both = counted.join(bounds, by) if by else counted.crossJoin(F.broadcast(bounds))  # one row
    share = F.when(F.col("__hi") > F.col("__lo"), (x - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(F.lit(0.0))
    return both.withColumn("cell", F.floor(share * CELLS)).drop("__lo", "__hi")


def cell_sums(placed: DataFrame, amount: str, by: list[str], descending: bool) -> DataFrame:
    """(by..., cell, own, ahead, total): each cell's sum, that of the cells before it, and the group's. The window
    holds CELLS + 1 rows of a group at most."""
    sums = placed.groupBy(*by, "cell").agg(F.sum(amount).alias("own"))
    w = Window.partitionBy(*by)
    order = F.desc("cell") if descending else F.asc("cell")
    ahead = F.sum("own").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return sums.select(*by, "cell", "own", F.coalesce(ahead, F.lit(0)).alias("ahead"), F.sum("own").over(w).alias("total"))


def running(counted: DataFrame, value: str, amount: str, by: list[str], descending: bool = False) -> DataFrame:
    """Rows of distinct values (by..., value, amount) with `before`, the sum of the amounts ahead of a value in its
    group, and `total`."""
    placed = with_cells(counted, value, by)
    w = Window.partitionBy(*by, "cell").orderBy(F.desc(value) if descending else F.asc(value)).rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum(amount).over(w), F.lit(0))
    rows = placed.join(cell_sums(placed, amount, by, descending), [*by, "cell"])
    return rows.withColumn("before", F.col("ahead") + within).drop("cell", "own", "ahead")
