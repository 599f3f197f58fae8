"""Feeds: trailing windows, gates, order and pages."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigee.operators.gates import gated
from perigee.params import WINDOWS, windows_within

SORT_KEYS = {"balanced": "discovery", "novelty": "novelty", "researcher": "authorship", "newest": "first_release"}


def horizon(depth: Column, indexed: Column) -> Column:
    """How far back a feed may look, in days: the depth (30 if there is none), no further than what is indexed."""
    top = F.when(depth > 0, depth).otherwise(F.lit(30))
    return F.greatest(F.lit(1), F.least(top, F.when(indexed > 0, indexed).otherwise(top)))


def windows_offered(depth: Column) -> Column:
    """How many windows lie within a depth."""
    return F.size(F.filter(F.array(*[F.lit(n) for n in WINDOWS.values()]), lambda n: n <= F.greatest(F.lit(1), depth)))


def within(rows: DataFrame, as_of: date, days: int) -> DataFrame:
    return rows.where(F.col("first_release") >= F.date_sub(F.lit(as_of), days))


def order(sort: str, matched: Column | None = None) -> list[Column]:
    """Interest matches first, then the sort's key, then the id, so every order is total."""
    key = F.col(SORT_KEYS.get(sort, "discovery")).desc()
    return [*([matched.desc()] if matched is not None else []), key, F.col("id").asc()]


def page(rows: DataFrame, sort: str, offset: int = 0, limit: int = 120, matched: Column | None = None) -> DataFrame:
    """A page of a feed: a distributed top-k, as limit and offset follow the order."""
    limit = min(250, max(1, limit))
    ordered = rows.orderBy(*order(sort, matched))
    return (ordered.offset(offset) if offset > 0 else ordered).limit(limit)


def page_report(rows: DataFrame, offset: int = 0, limit: int = 120) -> DataFrame:
    """(total, has_more) of the rows that a page is cut from."""
    end = max(0, offset) + min(250, max(1, limit))
    return rows.agg(F.count(F.lit(1)).alias("total")).select("total", (F.col("total") > end).alias("has_more"))


def feed(rows: DataFrame, as_of: date, window: str, sort: str, select_n: float, select_a: float, horizon: float = 90, offset: int = 0, limit: int = 120, matched: Column | None = None) -> DataFrame:
    """Rows (id, first_release, novelty, authorship, discovery, override) of a window that pass the gates
    of that window, in order, one page."""
    days = int(min(WINDOWS.get(window, 7), horizon))
    return page(gated(within(rows, as_of, days), select_n, select_a), sort, offset, limit, matched)


def bundle(rows: DataFrame, as_of: date, depth: int, select_n: float, select_a: float) -> DataFrame:
    """(window, result_count, screened_count) of all windows on offer, from one scan: each row goes to every
    window that holds it, and gates are per window."""
    names = windows_within(depth)
    age = F.datediff(F.lit(as_of), F.col("first_release"))
    offer = F.array(*[F.struct(F.lit(w).alias("window"), F.lit(min(WINDOWS[w], depth)).alias("days")) for w in names])
    each = rows.select("*", F.explode(F.filter(offer, lambda w: age <= w["days"])).alias("w")).select("*", F.col("w.window").alias("window")).drop("w")
    screened = each.groupBy("window").agg(F.count(F.lit(1)).alias("screened_count"))
    passed = gated(each, select_n, select_a, ["window"]).groupBy("window").agg(F.count(F.lit(1)).alias("result_count"))
    return screened.join(passed, "window", "left").select("window", F.coalesce("result_count", F.lit(0)).alias("result_count"), "screened_count")
