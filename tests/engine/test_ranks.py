"""Peers, cutoffs and ranks against plain versions."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from perigee.operators import gates, peers, ranks

DAY = date(2024, 1, 20)


@pytest.mark.parametrize(("seed", "most"), [(1, 3), (2, 8), (3, 320)])
def test_first_older_members(spark, seed, most):
    """Also with a candidate older than all members, one without a date and one that is a member itself."""
    r = random.Random(seed)
    day = lambda: DAY + timedelta(days=r.randrange(0, 80))
    members = [(g, i, day() if r.random() < 0.95 else None) for g, n in (("a", 260), ("b", 12)) for i in r.sample(range(1000), n)]
    cands = [(2000 + i, r.choice("ab"), day()) for i in range(40)] + [(3000, "a", date(2000, 1, 1)), (3001, "a", None), (3002, "c", DAY), (members[5][1], "a", date(2025, 1, 1))]
    got = {}
    for x in peers.pairs(spark.createDataFrame(cands, "id long, group_key string, date date"), spark.createDataFrame(members, "group_key string, id long, date date"), most).collect():
        got.setdefault(x["cand_id"], {})[x["ord"]] = x["ref_id"]
    want = {}
    for c, g, d in cands:
        older = sorted(i for h, i, e in members if h == g and d and e and e < d and i != c)[:most]
        if older:
            want[c] = dict(enumerate(older, 1))
    assert got == want


VALUES = [-1e308, -3.5, 0.0, 0.25, 0.25, 7.0, 7.0, 7.0, 99.9, 1e300, math.inf]


@pytest.mark.parametrize("seed", range(3))
def test_cutoffs_by_sorting(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice("ggh"), r.choice([*VALUES, None, r.random(), r.random()])) for _ in range(300)] + [("one", 4.0), ("same", 2.0), ("same", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    fractions = [0.001, 0.05, 0.3, 0.5, 0.9, 1.0]

    def at(values, f):
        if f >= 0.999:
            return -math.inf
        return sorted((v or 0.0 for v in values), reverse=True)[max(1, math.ceil(len(values) * f)) - 1]

    got = {(x["g"], x["fraction"]): x["cutoff"] for x in gates.cutoffs(df, "v", fractions, ["g"]).collect()}
    assert got == {(g, f): at([v for h, v in rows if h == g], f) for g in {g for g, _ in rows} for f in fractions}
    whole = {x["fraction"]: x["cutoff"] for x in gates.cutoffs(df, "v", fractions).collect()}
    assert whole == {f: at([v for _, v in rows], f) for f in fractions}
    assert gates.cutoff(df.limit(0), "v", 0.3).first()["cutoff"] is None and gates.cutoffs(df.limit(0), "v", [0.3], ["g"]).count() == 0


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(spark, descending):
    r = random.Random(4)
    rows = [(g, v, r.randrange(1, 9)) for g in "ab" for v in {*VALUES, *(r.random() for _ in range(200))}]
    got = {(x["g"], x["v"]): (x["before"], x["total"]) for x in ranks.running(spark.createDataFrame(rows, "g string, v double, n long"), "v", "n", ["g"], descending).collect()}
    ahead = lambda v, x: x > v if descending else x < v
    assert got == {(g, v): (sum(n for h, x, n in rows if h == g and ahead(v, x)), sum(n for h, _, n in rows if h == g)) for g, v, _ in rows}


def test_ranking_holds_no_group_in_one_task(spark):
    """The only windows are over sums of ranges and within one range."""
    df = spark.range(1000).select(F.lit("g").alias("g"), (F.col("id") % 997).cast("double").alias("v"), F.lit(1).alias("n"))
    plan = ranks.running(df, "v", "n", ["g"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window" in x]
    assert windows and all("cell" in x or "own" in x for x in windows)


def test_peers_are_lists_not_pairs(spark, sf_dir):
    """Counts come from one row for each group and date: no step of the plan makes rows of pairs."""
    from perigee.plans import novelty, views

    p = novelty.parts(views.works(spark, sf_dir))
    plan = p.counts._jdf.queryExecution().optimizedPlan().toString()
    assert "ref_id" not in plan
    assert p.lists.select("group_key", "cand_date").distinct().count() == p.lists.count()
    want = {r["cand_id"]: (r["n"], r["lo"], r["hi"]) for r in p.chosen.groupBy("cand_id").agg(F.count("*").alias("n"), F.min("ref_id").alias("lo"), F.max("ref_id").alias("hi")).collect()}
    assert {r["cand_id"]: tuple(r)[1:] for r in p.counts.where("n_peers > 0").collect()} == want


def test_items_that_no_peer_has(spark):
    """Also with a candidate that is on its own list, within the first ones, at the end or behind them."""
    r = random.Random(6)
    members = [("a", i, DAY) for i in range(9)]
    items = {i: {r.randrange(12) for _ in range(3)} for i in [*range(9), 100, 101]}
    new = DAY + timedelta(days=9)
    cands = [(i, "a", new) for i in (0, 3, 4, 8, 100)] + [(101, "a", date(2000, 1, 1)), (102, "a", None)]
    c = spark.createDataFrame(cands, "id long, group_key string, date date")
    rows = spark.createDataFrame([(i, x) for i, xs in items.items() for x in xs], "id long, item long")
    for most in (3, 4, 8, 320):
        older = peers.lists(c, spark.createDataFrame(members, "group_key string, id long, date date"), most)
        got = {x["cand_id"]: x["u"] for x in peers.unseen_share(c, rows.withColumn("times", F.lit(1)), rows, older, most).collect()}
        want = {}
        for i, _, d in cands:
            theirs = set().union(*(items[m] for m in [m for m in range(9) if m != i][:most])) if d == new else set()
            if i in items:
                want[i] = pytest.approx(len(items[i] - theirs) / len(items[i]))
        assert got == want
