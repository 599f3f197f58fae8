"""A pass from its lanes to the inbox, on small tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from perigee.engine import Engine
from perigee.operators import feed, progress, state
from perigee.passes import Passes
from perigee.plans import views
from perigee.session import materialize

NOW = datetime(2024, 3, 31, 12)


class Tables:
    """The derived views as a source of two lanes that overlap."""

    lanes = ("odd", "third")

    def __init__(self, spark, d):
        self.all = materialize(views.works(spark, d))
        self.who = materialize(views.authorships(spark, d))
        self.people = materialize(views.authors(spark, d))
        self.asked: list[int] = []

    def works(self, lane, since, until, cap):
        mine = "id % 2 = 1" if lane == "odd" else "id % 3 = 0"
        return self.all.where("NOT is_baseline").where(mine).where(F.col("date").between(since, until))

    def authorships(self, works):
        return self.who.join(works.select("id"), "id", "left_semi")

    def authors(self, ids):
        self.asked.append(ids.count())
        return self.people.join(ids, "author_id", "left_semi")


@pytest.fixture(scope="module")
def passes(spark, sf_dir, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("passes") / "store"))
    e.configure(max_timeframe_days=90, novelty_selectivity=1, authorship_selectivity=1, english_only=False, auto_scan_hours=6, subfields=["1702"], notifications=False)
    source = Tables(spark, sf_dir)
    return Passes(e, source, baseline=source.all.where("is_baseline"))


def test_a_full_pass_then_an_incremental_one(passes):
    assert passes.run("manual", NOW)["mode"] == "full"
    store = passes.engine.store
    want = {r["id"] for r in passes.source.all.where("NOT is_baseline AND (id % 2 = 1 OR id % 3 = 0) AND date >= '2024-01-01'").collect()}
    assert {r["id"] for r in store.read("scores").collect()} == want
    assert passes.last()["fetched"] == len(want) and passes.last()["status"] == "ready"
    assert passes.coverage().first()["percent"] <= 100
    first = passes.source.asked[-1]
    assert not passes.run_if_due(NOW + timedelta(hours=5))
    assert passes.run_if_due(NOW + timedelta(hours=6))
    assert passes.last()["mode"] == "incremental" and passes.last()["rescored"] == 0
    assert first and passes.source.asked[-1] == 0  # profiles are fresh
    assert {r["id"] for r in store.read("scores").collect()} == want
    assert store.read("history").count() == 1


def test_stale_scores_are_scored_again(passes):
    store = passes.engine.store
    store.write("scores", materialize(store.read("scores").withColumn("score_version", F.when(F.col("id") % 5 == 0, F.lit(2)).otherwise(F.col("score_version")))))
    n = store.read("scores").where("score_version = 2").count()
    assert n and passes.run("schedule", NOW + timedelta(hours=13))["rescored"] == n
    assert store.read("scores").where("score_version <> 3").count() == 0


def test_an_interrupted_pass_and_a_gap(passes):
    passes._note(NOW + timedelta(days=1), "running", "full")
    passes.recover()
    assert passes.last()["status"] == "ready"
    store = passes.engine.store
    gone = [r["id"] for r in store.read("works").where("NOT is_baseline").orderBy("id").limit(7).collect()]
    store.write("works", materialize(store.read("works").where(~F.col("id").isin(gone))))
    assert passes.fill_gap(NOW) == 7 and store.read("works").where(F.col("id").isin(gone)).count() == 7
    assert passes.fill_gap(NOW + timedelta(hours=5)) == 0


def test_equal_keys_keep_the_last_row(spark, tmp_path):
    from perigee.sources.store import Store

    s = Store(spark, str(tmp_path / "s"))
    s.put("t", spark.createDataFrame([(1, "a"), (2, "b"), (1, "c")], "id int, v string").coalesce(1), "id")
    assert sorted(map(tuple, s.read("t").collect())) == [(1, "c"), (2, "b")]


def test_history_is_replaced_by_signature_and_bounded(spark):
    old = spark.createDataFrame([(f"s{i}", NOW - timedelta(hours=i + 1)) for i in range(14)], "signature string, at timestamp")
    got = state.search_history(old, spark.createDataFrame([("s3", NOW)], "signature string, at timestamp")).collect()
    assert len(got) == 12 and got[0]["signature"] == "s3" and [r["signature"] for r in got].count("s3") == 1


def test_progress(spark):
    rows = [("running", "discovery", "selected subfields", 100, 900), ("running", "scoring", None, 500, None), ("running", None, None, None, None), ("running", "x", "", 0, 20), ("ready", "done", None, 812, 900)]
    df = spark.createDataFrame(rows, "status string, phase string, lane string, fetched long, total long")
    got = [r["x"] for r in df.select(progress.describe(*[F.col(c) for c in df.columns]).alias("x")).collect()]
    assert got == ["discovery · selected subfields · 100 of 900", "scoring · 500 so far", "starting", "x · 0 of 20", ""]
    t = datetime(2024, 1, 1)
    states = [(1, 1, t, "running"), (1, 2, t + timedelta(milliseconds=700), "running"), (1, 3, t + timedelta(milliseconds=800), "running"), (2, 4, t, "running"), (2, 5, t + timedelta(milliseconds=1), "ready")]
    s = progress.summary(spark.createDataFrame(states, "user_id int, event_id int, ts timestamp, status string"), F.lit(t + timedelta(seconds=130)))
    assert sorted(map(tuple, s.collect())) == [(1, 2, "running", True, "ready"), (2, 2, "ready", False, "ready")]


def test_page_report(spark):
    r = feed.page_report(spark.range(130), 0, 120).first()
    assert (r["total"], r["has_more"]) == (130, True)
    r = feed.page_report(spark.range(130), 120, 120).first()
    assert (r["total"], r["has_more"]) == (130, False)
