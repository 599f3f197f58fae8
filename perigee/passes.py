"""A pass over a source: lanes, entity resolution, author enrichment, scores, notifications, with its state."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.engine import Engine
from perigee.operators import authorship, resolve, state
from perigee.params import pass_mode, scan_due
from perigee.session import materialize
from perigee.sources.scan import fresh

#: The version of the scoring rules, gap rows at most, hours between two fills of a gap, days that
#: author profiles stay fresh.
VERSION, GAP_ROWS, GAP_HOURS, AUTHOR_DAYS = 3, 400, 6, 30


class Source(Protocol):
    """Where a pass reads from: works of a lane and a span of days, authorships of works, profiles of authors."""

    lanes: tuple[str, ...]

    def works(self, lane: str, since: date, until: date, cap: float) -> DataFrame: ...

    def authorships(self, works: DataFrame) -> DataFrame: ...

    def authors(self, ids: DataFrame) -> DataFrame: ...


@dataclass
class Passes:
    """Runs passes over an engine's store. Its state (status, mode, times, counts) is a table of the store, so a pass
    that was interrupted is known after a restart: it counts as ready, and the next one reads its days again."""

    engine: Engine
    source: Source
    baseline: DataFrame | None = None
    _running: bool = field(default=False, repr=False)

    def last(self) -> dict | None:
        rows = self.engine.store.read("passes")
        first = None if rows is None else rows.orderBy(F.desc("at")).first()
        return None if first is None else first.asDict()

    def _note(self, at: datetime, status: str, mode: str, **counts: int) -> None:
        row = (at, status, mode, self.engine.params.filter_signature(), counts.get("available", 0), counts.get("fetched", 0), counts.get("rescored", 0))
        rows = self.engine.spark.createDataFrame([row], "at timestamp, status string, mode string, signature string, available long, fetched long, rescored long")
        self.engine.store.put("passes", rows, "at")

    def recover(self) -> None:
        """After a restart: a pass that was running is none any more."""
        rows = self.engine.store.read("passes")
        if rows is not None:
            self.engine.store.write("passes", materialize(rows.withColumn("status", F.when(F.col("status") == "running", F.lit("ready")).otherwise(F.col("status")))))

    def run_if_due(self, now: datetime) -> bool:
        """The scheduler's call, every half hour: a pass if the interval has gone by, none is running and there is a
        scope. The attempt is noted before the pass."""
        p, last = self.engine.params, self.last()
        if self._running or not (p.fields or p.subfields or p.groups or p.codes or p.queries):
            return False
        if not scan_due(p.auto_scan_hours, None if last is None else last["at"], now):
            return False
        self.run("schedule", now)
        return True

    def run(self, reason: str, now: datetime) -> dict:
        """One pass: full after a manual call, incremental after a full one under the same settings, else limited."""
        if self._running:
            return self.last() or {}
        p, store, last = self.engine.params, self.engine.store, self.last()
        same = last is not None and last["signature"] == p.filter_signature()
        mode, since = pass_mode(reason, bool(same and last["mode"] == "full"), int(p.max_timeframe_days), now.date(), p)
        self._running = True
        self._note(now, "running", mode)
        try:
            counts = self._ingest(since, now, p.full_scan_budget if mode == "full" else p.incremental_scan_budget)
            counts["rescored"] = self._score()
            self._note(now, "ready", mode, **counts)
        except Exception:
            self._note(now, "error", mode)
            raise
        finally:
            self._running = False
        if p.notifications:
            self.engine.notify(now.date())
        store.write("history", materialize(self._history(now)))
        return self.last()

    def _ingest(self, since: date, now: datetime, budget: float) -> dict[str, int]:
        """Lanes, each id once and the last lane's row, then the profiles of their authors that aren't fresh."""
        cap = budget / max(1, len(self.source.lanes))  # the run's cap, split beforehand
        lanes = [self.source.works(lane, since, now.date(), cap) for lane in self.source.lanes]
        works = materialize(resolve.union_lanes(lanes, "id").drop("lane"))
        every = works if self.baseline is None or self.engine.store.read("works") is not None else works.unionByName(self.baseline, allowMissingColumns=True)
        who = materialize(self.source.authorships(every))
        wanted = authorship.priority_authors(who, int(self.engine.params.max_authors)).select("author_id")
        known = self.engine.store.read("authors")
        if known is not None and "fetched" in known.columns:
            wanted = resolve.new_only(wanted, fresh(known, "fetched", now, AUTHOR_DAYS), "author_id")
        people = self.source.authors(wanted).withColumn("fetched", F.lit(now).cast("timestamp"))
        self.engine.ingest(every, materialize(people), who, now.date())
        available = sum(lane.count() for lane in lanes)
        return {"available": available, "fetched": works.count()}

    def _score(self) -> int:
        """New works and those whose scores are of another version or other settings; how many were stale."""
        store, signature = self.engine.store, self.engine.params.scope_signature()
        old = store.read("scores")
        stale = 0
        if old is not None and "score_version" in old.columns:
            new = resolve.new_only(store.read("works").where("NOT is_baseline").select("id"), old, "id")
            todo = state.to_rescore(new, old.select("id", "score_version", "signature"), VERSION, signature)
            stale = todo.where("NOT is_new").count()
            if not stale and not todo.count():
                return 0
        self.engine.score()
        scores = store.read("scores").withColumn("score_version", F.lit(VERSION)).withColumn("signature", F.lit(signature))
        store.write("scores", materialize(scores))
        return stale

    def _history(self, now: datetime) -> DataFrame:
        old = self.engine.store.read("history")
        entry = self.engine.spark.createDataFrame([(self.engine.params.filter_signature(), now)], "signature string, at timestamp")
        return state.search_history(entry.limit(0) if old is None else old, entry)

    def fill_gap(self, now: datetime) -> int:
        """Works that a feed shows a hole for: the newest missing ones of the lanes' whole depth, GAP_ROWS at most,
        under a budget of their own, once in GAP_HOURS; they are scored before they are stored."""
        filled = self.engine.store.read("gap_fills")
        last = None if filled is None else filled.agg(F.max("at")).first()[0]
        if last is not None and now - last < timedelta(hours=GAP_HOURS):
            return 0
        p, known = self.engine.params, self.engine.store.read("works")
        cap = p.gap_fill_budget / max(1, len(self.source.lanes))
        since = now.date() - timedelta(days=int(p.max_timeframe_days))
        lanes = [self.source.works(lane, since, now.date(), cap) for lane in self.source.lanes]
        missing = resolve.new_only(resolve.union_lanes(lanes, "id").drop("lane"), known, "id")
        rows = materialize(missing.orderBy(F.desc("date"), "id").limit(GAP_ROWS))
        n = rows.count()
        if n:
            who = materialize(self.source.authorships(rows))
            people = self.source.authors(who.select("author_id").distinct()).withColumn("fetched", F.lit(now).cast("timestamp"))
            self.engine.ingest(rows, materialize(people), who, now.date())
            self._score()
        self.engine.store.put("gap_fills", self.engine.spark.createDataFrame([(now, n)], "at timestamp, n long"), "at")
        return n

    def coverage(self) -> DataFrame:
        """(available, records, percent) of the last pass."""
        last = self.last() or {"available": 0}
        totals = self.engine.spark.createDataFrame([(last["available"],)], "total long")
        return state.coverage(totals, self.engine.store.read("works").where("NOT is_baseline").select("id"))
