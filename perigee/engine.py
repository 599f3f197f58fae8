"""The engine's API: ingest, score, feed, bundle, inbox, status over a store and a set of parameters."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee.functions.text import search_text
from perigee.operators import authorship, feed, filters, state
from perigee.params import QueryParams, horizon_days, scan_due
from perigee.plans import novelty as plan
from perigee.session import materialize
from perigee.sources.store import Store


class Engine:
    """Tables in the store: works, authors, authorships, scores, inbox."""

    def __init__(self, spark: SparkSession, path: str, params: QueryParams | None = None):
        self.spark, self.store = spark, Store(spark, path)
        self.params = params or QueryParams()
        self._views: dict[str, DataFrame] = {}

    def configure(self, **settings) -> QueryParams:
        """New settings; feeds cached under other signatures are dropped."""
        self.params = QueryParams.from_dict({**{k: v for k, v in vars(self.params).items() if k != "extra"}, **settings})
        self.clear_feed_cache()
        return self.params

    def ingest(self, works: DataFrame, authors: DataFrame | None = None, authorships: DataFrame | None = None, as_of: date | None = None) -> None:
        """Upserts a pass's rows, then drops candidates past the retention."""
        self.store.put("works", works, "id")
        if authors is not None:
            self.store.put("authors", authors, "author_id")
        if authorships is not None:
            self.store.put("authorships", authorships.withColumn("key", F.concat_ws("/", "id", "ord")), "key")
        if as_of is not None:
            self.store.write("works", state.retain(self.store.read("works"), as_of))
        self.clear_feed_cache()

    def score(self) -> None:
        scores = plan.discovery(self.store.read("works"), self.store.read("authorships"), self.store.read("authors"))
        self.store.write("scores", scores.select(F.col("cand_id").alias("id"), "novelty", "authorship", "discovery", "confidence", "nearest_id", "nearest_sim"))
        self.clear_feed_cache()

    def corpus(self) -> DataFrame:
        """Scored candidates within the scope, persisted under the filter's signature."""
        key = self.params.filter_signature()
        if key not in self._views:
            w = self.store.read("works").join(self.store.read("scores"), "id").where("NOT is_baseline")
            p = self.params
            # written out once, so that the Python function's output is a plain column for the matches
            w = filters.with_tokens(materialize(w.withColumns({"title_s": search_text("title"), "abstract_s": search_text("abstract")})), "title_s", "abstract_s")
            hit = filters.interest_location(list(p.queries), "title_s", "abstract_s").isNotNull() if p.queries else F.lit(False)
            field = F.col("field_id") if "field_id" in w.columns else F.lit(None).cast("string")
            keep = filters.passes(p, F.col("language"), field, F.col("subfield"), "title_s", "abstract_s")
            roster = authorship.on_roster(self.store.read("authorships"), authorship.roster(self.store.read("authors"))).withColumn("override", F.lit(True))
            w = w.where(keep).withColumn("matched", hit).drop("title_s", "abstract_s", "title_s_tokens", "abstract_s_tokens")
            self._views[key] = w.join(roster, "id", "left").withColumn("override", F.coalesce("override", F.lit(False))).persist()
        return self._views[key]

    def feed(self, as_of: date, window: str | None = None, sort: str | None = None, offset: int = 0, limit: int = 120) -> DataFrame:
        p = self.params
        return feed.feed(self.corpus(), as_of, window or p.window, sort or p.sort, p.novelty_selectivity, p.authorship_selectivity, horizon_days(p.max_timeframe_days), offset, limit, F.col("matched"))

    def bundle(self, as_of: date) -> DataFrame:
        p = self.params
        return feed.bundle(self.corpus(), as_of, int(p.max_timeframe_days), p.novelty_selectivity, p.authorship_selectivity)

    def notify(self, as_of: date, top: int = 10) -> DataFrame:
        """Adds qualified works of the last month to the inbox: the strongest ones on the first run."""
        old = self.store.read("inbox")
        month = self.feed(as_of, "month", "balanced", limit=250)
        new = month.select(F.col("id").alias("work_id"), F.lit(True).alias("unread"), (-F.col("discovery")).alias("place"))
        new = new.orderBy("place", "work_id").limit(top) if old is None else new
        box = state.inbox(new, new.limit(0) if old is None else old.select("work_id", "unread", "place"))
        self.store.write("inbox", box)
        return self.store.read("inbox")

    def mark_read(self, ids: list | None = None) -> None:
        self.store.write("inbox", state.mark_read(self.store.read("inbox"), ids))

    def clear_notifications(self) -> None:
        self.store.truncate("inbox")

    def status(self) -> dict[str, int]:
        works = self.store.read("works")
        n = 0 if works is None else works.count()
        base = 0 if works is None else works.where("is_baseline").count()
        return {"works": n, "baseline": base, "candidates": n - base, "authors": self.store.count("authors")}

    def due(self, last, now) -> bool:
        return scan_due(self.params.auto_scan_hours, last, now)

    def clear_feed_cache(self) -> None:
        for df in self._views.values():
            df.unpersist()
        self._views.clear()

    def clear_data(self) -> None:
        for t in ("works", "authors", "authorships", "scores", "inbox"):
            if self.store.read(t) is not None:
                self.store.truncate(t)
        self.clear_feed_cache()
