"""Vectors row by row against joins, and the nearest peers of lists against brute force."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from perigee.operators import peers, similarity, vectors
from perigee.plans import novelty, views

NEW = date(2024, 3, 1)


@pytest.fixture(scope="module")
def works(spark):
    r = random.Random(3)
    words = [f"w{chr(97 + i % 26)}{i}" for i in range(900)]
    rows = [(i, " ".join(r.choices(words, k=4)), " ".join(r.choices(words, k=r.choice((3, 50, 500, 900))))) for i in range(120)]
    return spark.createDataFrame([*rows, (200, "", ""), (201, None, None), (202, "of the", None), (203, "wa0 wa0 lone", "lone")], "id long, title string, abstract string")


def test_profiles_as_joins(works):
    idf = vectors.idf(vectors.term_frequencies(vectors.tokens(works)), vectors.corpus_size(works))
    got = {r["id"]: r for r in vectors.profiles(works, vectors.lexicon(works)).collect()}
    want = {r["id"]: r for r in vectors.joined_profiles(works, idf).collect()}
    assert set(got) == set(want) and len(got) == 124
    for i, r in want.items():
        assert got[i]["terms"] == r["terms"] and got[i]["weights"] == pytest.approx(r["weights"], rel=1e-12)
        assert got[i]["norm"] == (r["norm"] and pytest.approx(r["norm"], rel=1e-12))
        assert got[i]["distinctiveness"] == pytest.approx(r["distinctiveness"], rel=1e-12)


def test_no_shuffle_of_terms(works):
    """Neither lengths nor distinctiveness join terms with their idf."""
    for df in (vectors.lengths(works), vectors.own_distinctiveness(works)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan


def test_without_lexicon_the_same(spark, sf_dir, works, monkeypatch):
    """More terms than a lexicon holds, and repeated ids: by joins, with the same results."""
    rows = lambda df, n=9: {tuple(round(x, n) if isinstance(x, float) else x for x in r) for r in df.collect()}
    own = views.works(spark, sf_dir)
    both = lambda: [rows(vectors.lengths(works)), rows(vectors.own_distinctiveness(works)), rows(novelty.parts(own, keep=True).crowd)]
    want = both()
    monkeypatch.setattr(vectors, "MOST_TERMS", 5)
    assert vectors.lexicon(works) is None and both() == want
    monkeypatch.undo()
    twice = works.unionByName(works.where("id < 3"))
    assert vectors.lexicon(twice) is None
    assert {r["id"] for r in vectors.lengths(twice).collect()} == {r[0] for r in want[0]}


@pytest.mark.parametrize("block", [7, 512])
def test_nearest_of_lists(spark, monkeypatch, block):
    """Lists of many dates, candidates that are on their list, without a date or older than all, ties, empty vectors."""
    monkeypatch.setattr(similarity, "BLOCK", block)
    r = random.Random(block)
    most = 12
    day = lambda n: NEW + timedelta(days=n)
    members = [("g", i, day(r.randrange(40))) for i in r.sample(range(100), 60)]
    cands = [(100 + i, "g", day(r.randrange(20, 45))) for i in range(30)] + [(200 + i, "g", day(41)) for i in range(25)]
    cands += [(members[3][1], "g", day(60)), (300, "g", None), (301, "g", date(2000, 1, 1)), (302, "h", NEW), (303, "g", day(41))]
    vec = {i: {r.randrange(60): r.random() + 0.1 for _ in range(10)} for i in [*(m[1] for m in members), *(c[0] for c in cands)]}
    same = sorted(m[1] for m in members)
    vec[same[1]] = dict(vec[same[0]])
    vec[303] = {}
    c = spark.createDataFrame(cands, "id long, group_key string, date date")
    packed = spark.createDataFrame([(i, sorted(v), [v[t] for t in sorted(v)], 0.5) for i, v in vec.items()], "id long, terms array<long>, weights array<double>, distinctiveness double")
    older = peers.lists(c, spark.createDataFrame(members, "group_key string, id long, date date"), most).localCheckpoint()
    got = {x["cand_id"]: x for x in similarity.nearest(c, older, packed, packed, most).collect()}
    assert len(got) == len(cands)
    norm = {i: sum(w * w for w in v.values()) ** 0.5 for i, v in vec.items()}
    for i, g, d in cands:
        own = sorted(m for h, m, e in members if h == g and d and e < d and m != i)[:most]
        sims = [(sum(w * vec[m].get(t, 0) for t, w in vec[i].items()) / (norm[i] * norm[m] or 1), m) for m in own]
        sims = sorted((s for s in sims if s[0] > 0), key=lambda s: (-round(s[0], 12), s[1]))[:5]
        assert got[i]["nearest_id"] == (sims[0][1] if sims else None)
        assert got[i]["nearest_sim"] == pytest.approx(sims[0][0] if sims else 0) and got[i]["top_sum"] == pytest.approx(sum(s for s, _ in sims))
    placed = similarity.placed_lists(older)
    assert placed.groupBy("group_key", "block").agg(F.sum(F.least(F.lit(block), "n_cands")).alias("n")).where(f"n > {2 * block}").count() == 0
