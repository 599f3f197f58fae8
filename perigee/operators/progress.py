"""Progress of a pass: what is said about it, which states are written, when it counts as stalled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Milliseconds between written states, seconds without a change, minutes that a run is watched.
WRITE_MS, STALL_S, WATCH_MIN = 750, 120, 45


def describe(status: Column, phase: Column, lane: Column, fetched: Column, total: Column) -> Column:
    """`phase · lane · n of m` of a running pass; nothing of any other."""
    count = lambda n: F.format_number(n.cast("long"), 0)
    blank = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    # a number that isn't there counts as zero in a sum, and as a number where there is a total
    have = F.coalesce(fetched, F.lit(0))
    counted = F.when(F.coalesce(total, F.lit(0)) != 0, F.concat(count(have), F.lit(" of "), count(total))).when(have != 0, F.concat(count(have), F.lit(" so far")))
    said = F.concat_ws(" · ", F.coalesce(blank(phase), F.lit("starting")), blank(lane), counted)
    return F.when(status == "running", said).otherwise(F.lit(""))


def summary(states: DataFrame, now: Column, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Of the states of each run (ts, status): how many are written when states closer than WRITE_MS to the last
    written one are left out (but a change of status always is), the last status, whether a running one has stalled,
    and what it is after a restart: an interrupted run becomes ready."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    per = states.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(micros(F.col(ts)).alias("at"), "event_id", "status"))).alias("list"))
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.lit("").alias("status"), F.lit(0).alias("n"))
    put = lambda acc, x: F.struct(x["at"].alias("last"), x["status"].alias("status"), (acc["n"] + 1).alias("n"))
    close = lambda acc, x: acc["last"].isNotNull() & (x["at"] - acc["last"] < WRITE_MS * 1000) & (x["status"] == acc["status"])
    written = F.aggregate("list", start, lambda acc, x: F.when(close(acc, x), acc).otherwise(put(acc, x)), lambda acc: acc["n"])
    last = F.element_at("list", -1)
    running = last["status"] == "running"
    stalled = running & (micros(now) - last["at"] > STALL_S * 1_000_000)
    return per.select(key, written.alias("written"), last["status"].alias("status"), stalled.alias("stalled"), F.when(running, F.lit("ready")).otherwise(last["status"]).alias("recovered"))
