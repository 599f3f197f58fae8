"""State that passes keep: upserts, retention, usage, inbox, due and rate-limited events."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perigee.operators.resolve import last_wins


def upsert(stored: DataFrame, incoming: DataFrame, key: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """The stored rows with whole rows replaced by key; of equal incoming keys the last by `seq` wins, of equal `seq`
    the first by `ties`, columns that aren't stored."""
    new = last_wins(incoming, key, "seq", ties).drop("seq", *ties)
    return stored.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(new)


def retain(works: DataFrame, as_of: date, days: int = 400) -> DataFrame:
    """Without the candidates older than the retention; baseline rows and rows without a date stay."""
    old = (F.col("date") < F.date_sub(F.lit(as_of), days)) & ~F.coalesce(F.col("is_baseline"), F.lit(False))
    return works.where(~F.coalesce(old, F.lit(False)))


def drop_baseline(works: DataFrame) -> DataFrame:
    return works.where(~F.coalesce(F.col("is_baseline"), F.lit(False)))


def budget_prefix(requests: DataFrame, cap: float, order: str, cost: str, buckets: int = 64) -> DataFrame:
    """Requests, in order, as long as their running cost stays within the cap.

    The running sum goes in two steps: sums per range of the order, then within ranges; no task holds all.
    """
    bounds = requests.agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    span = F.greatest(F.lit(1.0), (F.col("hi") - F.col("lo") + 1).cast("double"))
    cut = requests.crossJoin(F.broadcast(bounds)).withColumn("bucket", F.floor((F.col(order) - F.col("lo")) / span * buckets))
    sums = cut.groupBy("bucket").agg(F.sum(cost).alias("own"))
    ahead = sums.select("bucket", F.coalesce(F.sum("own").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("ahead"))
    w = Window.partitionBy("bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    running = cut.join(F.broadcast(ahead), "bucket").withColumn("running_cost", F.col("ahead") + F.sum(cost).over(w))
    return running.where(F.col("running_cost") <= cap + 1e-9).drop("lo", "hi", "bucket", "ahead")


def daily_usage(requests: DataFrame) -> DataFrame:
    """(day, requests, cost, estimated, last_remaining) of (ts, cost, estimated, remaining)."""
    return requests.groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("cost").alias("cost"), F.bool_or("estimated").alias("estimated"), F.max_by("remaining", F.when(F.col("remaining").isNotNull(), F.col("seq"))).alias("last_remaining")
    )


def due(scans: DataFrame, hours: int, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Rows whose predecessor is `hours` or more before (or isn't there)."""
    last = F.lag(ts).over(Window.partitionBy(key).orderBy(ts, "event_id"))
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(last.cast("timestamp"))
    return scans.withColumn("gap", gap).where(F.col("gap").isNull() | (F.col("gap") >= hours * 3_600_000_000)).drop("gap")


def rate_limited(events: DataFrame, hours: int = 6, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Events let through when at most one per `hours` is: each is measured against the last one let through.

    A fold over a key's sorted events, in the JVM.
    """
    span = hours * 3_600_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = events.select(key, "event_id", ts, at.alias("at"))
    per = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "event_id", ts))).alias("list"))
    kind = per.schema["list"].dataType.simpleString()
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast(kind).alias("kept"))
    take = lambda acc, x: F.struct(x["at"].alias("last"), F.array_append(acc["kept"], x).alias("kept"))
    passed = F.aggregate("list", start, lambda acc, x: F.when(acc["last"].isNull() | (x["at"] - acc["last"] >= span), take(acc, x)).otherwise(acc), lambda acc: acc["kept"])
    return per.select(key, F.explode(passed).alias("e")).select(key, "e.event_id", f"e.{ts}")


def inbox(new: DataFrame, old: DataFrame, cap: int = 250) -> DataFrame:
    """New entries before old ones, none twice, `cap` at most. rows: work_id, created, place, unread."""
    fresh = new.join(old.select("work_id"), "work_id", "left_anti").withColumn("age", F.lit(0))
    return fresh.unionByName(old.withColumn("age", F.lit(1))).orderBy("age", "place", "work_id").limit(cap)


def mark_read(box: DataFrame, ids: list | None) -> DataFrame:
    """Entries as read; without ids all of them."""
    hit = F.col("work_id").isin(*ids) if ids else F.lit(True)
    return box.withColumn("unread", F.when(hit, F.lit(False)).otherwise(F.col("unread")))


def unread_badge(box: DataFrame) -> DataFrame:
    n = F.count_if("unread")
    return box.agg(n.alias("unread"), F.when(n > 99, "99+").when(n > 0, n.cast("string")).otherwise("").alias("badge"))


def coverage(lanes: DataFrame, records: DataFrame) -> DataFrame:
    """(available, distinct_available, records, percent) of lane totals (lane, total) and records (id)."""
    total = lanes.agg(F.sum("total").alias("available"))
    got = records.agg(F.count_distinct("id").alias("records"))
    percent = F.when(F.col("available") > 0, F.least(F.lit(100.0), F.lit(100.0) * F.col("records") / F.col("available"))).otherwise(F.lit(100.0))
    return total.crossJoin(got).select("available", "records", percent.alias("percent"))


def to_rescore(new: DataFrame, stored: DataFrame, version: int, signature: str) -> DataFrame:
    """The population of a scoring pass: new rows, then the stored ones whose score is of another version or other
    settings (score_version, signature) or isn't there; each id once."""
    stale = ~(F.coalesce(F.col("score_version"), F.lit(-1)) == version) | ~(F.coalesce("signature", F.lit("")) == signature)
    old = stored.where(stale).join(new.select("id"), "id", "left_anti")
    return new.withColumn("is_new", F.lit(True)).unionByName(old.withColumn("is_new", F.lit(False)), allowMissingColumns=True)


def valid_baseline(meta: DataFrame, version: int, signature: str) -> DataFrame:
    """One row: whether the stored baseline (version, signature) may be used; it is built again otherwise."""
    ok = F.count_if((F.col("version") == version) & (F.col("signature") == signature)) > 0
    return meta.agg(ok.alias("usable"))


def search_history(old: DataFrame, entry: DataFrame, cap: int = 12) -> DataFrame:
    """(signature, at, params) with the new entry first; an entry of the same signature is replaced."""
    kept = old.join(entry.select("signature"), "signature", "left_anti")
    return entry.unionByName(kept).orderBy(F.desc("at"), "signature").limit(cap)
