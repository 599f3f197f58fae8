"""Scans: deterministic samples, cursors with dedup, keyed lookups, pushed filters, fallback chains."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.functions.text import title_key
from perigee.operators.resolve import first_wins


def sample_scan(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in the order of a seeded hash of the key: the same rows every time, a distributed top-k."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def search_scan(rows: DataFrame, hit, day: str, key: str, n: int) -> DataFrame:
    """The n newest rows that match."""
    return rows.where(hit).orderBy(F.desc(day), key).limit(n)


def cursor_scan(rows: DataFrame, key: str, seq: str, limit: int) -> DataFrame:
    """The first row of each key in the order of the cursor, up to the limit."""
    return first_wins(rows, key, seq).orderBy(seq).limit(limit)


def cursor_report(rows: DataFrame, key: str, limit: int, page: int = 100) -> DataFrame:
    """(total, kept, pages, truncated) of a cursor scan."""
    kept = F.least(F.lit(limit), F.count_distinct(key))
    return rows.agg(F.count(F.lit(1)).alias("total"), kept.alias("kept"), F.ceil(F.count(F.lit(1)) / page).alias("pages"), (F.count_distinct(key) > limit).alias("truncated"))


def lookup(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is asked for; keys may repeat and be null."""
    return rows.join(keys.where(F.col(key).isNotNull()), key, "left_semi")


def pushed(rows: DataFrame, since: str | date, until: str | date, kinds: tuple[str, ...] = ("article", "preprint"), **equal) -> DataFrame:
    """A closed interval of days and allowed kinds, as conjuncts that reach the Parquet scan."""
    out = rows.where((F.col("date") >= F.lit(str(since)).cast("timestamp_ntz")) & (F.col("date") < F.date_add(F.lit(str(until)).cast("date"), 1).cast("timestamp_ntz")) & F.col("kind").isin(*kinds))
    for c, v in equal.items():
        out = out.where(F.col(c).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    return out


def title_lookup(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(ord, id): for each wanted title the first row whose normalized title is equal."""
    own = rows.select("id", title_key(F.col("title")).alias("k")).where("k <> ''").groupBy("k").agg(F.min("id").alias("id"))
    return wanted.select("ord", title_key(F.col("title")).alias("k")).join(own, "k").select("ord", "id")


def fallback(frames: list[DataFrame]) -> DataFrame:
    """The rows of the first frame that has any: fresh cache, source, stale cache, built-in values."""
    tagged = None
    for i, f in enumerate(frames):
        f = f.withColumn("__source", F.lit(i))
        tagged = f if tagged is None else tagged.unionByName(f)
    best = tagged.agg(F.min("__source").alias("__best"))
    return tagged.join(F.broadcast(best), F.col("__source") == F.col("__best")).drop("__source", "__best")


def fresh(rows: DataFrame, fetched: str, now, days: int = 30) -> DataFrame:
    """Rows fetched within the freshness period; the others are fetched again."""
    return rows.where(F.col(fetched) >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))
