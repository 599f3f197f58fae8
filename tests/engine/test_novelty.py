"""Scores of made-up fields: copies of earlier works, ordinary works and new vocabulary, and a survey."""

import random
from datetime import date
from statistics import mean

import pytest

from perigee.functions import text
from perigee.operators import similarity
from perigee.plans import novelty

WORK = "id long, title string, abstract string, language string, subfield string, domain string, is_baseline boolean, date date, fields array<string>"
OLD, NEW = date(2024, 1, 1), date(2026, 1, 1)


def work(i, words, baseline, title=None):
    return (i, title or " ".join(words[:8]), " ".join(words), "en", "1702", "1", baseline, OLD if baseline else NEW, ["17", "18"])


@pytest.fixture(scope="module")
def field(spark):
    """References and candidates from one vocabulary, near copies of references, and works of words of their own."""
    r = random.Random(7)
    vocabulary = [f"term{chr(97 + i % 26)}{i}" for i in range(1500)]
    refs = [work(i, r.choices(vocabulary, k=180), True) for i in range(240)]
    typical = [work(1000 + i, r.choices(vocabulary, k=180), False) for i in range(40)]
    copies = [work(2000 + i, refs[i * 3][2].split(), False, refs[i * 3][1]) for i in range(6)]
    fresh = [work(3000 + i, r.choices([f"new{chr(97 + j % 26)}{j}" for j in range(400)], k=180), False) for i in range(3)]
    rows = novelty.novelty(spark.createDataFrame(refs + typical + copies + fresh, WORK)).collect()
    return {r["cand_id"]: r for r in rows}


def test_copies_ordinary_works_and_new_ones_stand_in_order(field):
    kind = lambda lo, hi: [r["novelty"] for i, r in field.items() if lo <= i < hi]
    copies, typical, fresh = kind(2000, 3000), kind(1000, 2000), kind(3000, 4000)
    assert (len(copies), len(typical), len(fresh)) == (6, 40, 3)
    assert max(copies) < mean(typical) < min(fresh)
    assert max(copies) < min(fresh) - 25
    assert max(typical) - min(typical) > 30  # a field is told apart
    assert all(0 <= r["novelty"] <= 100 and 0 <= r["confidence"] <= 1 for r in field.values())


def test_copies_find_what_they_copy(field):
    for i in range(6):
        r = field[2000 + i]
        assert r["nearest_id"] == i * 3 and r["nearest_sim"] == pytest.approx(1.0, abs=1e-9)


def test_similarities_as_pairwise(spark):
    """Blocks of vectors and a naive sum over all pairs agree, whatever the block."""
    r = random.Random(99)
    words = [f"w{i}" for i in range(600)]
    vec = [(i, t, r.random() + 0.1) for i in range(180) for t in r.sample(words, 40)]
    chosen = [(a, b, "g" if a % 2 else "h", o) for a in range(60) for o, b in enumerate(r.sample(range(60, 180), 30), 1)]
    got = similarity.similarities(spark.createDataFrame(chosen, "cand_id long, ref_id long, group_key string, ord int"), spark.createDataFrame(vec, "id long, term string, w double"))
    own: dict = {}
    for i, t, w in vec:
        own.setdefault(i, {})[t] = w
    norm = {i: sum(w * w for w in v.values()) ** 0.5 for i, v in own.items()}
    want = {(a, b): sum(w * own[b].get(t, 0) for t, w in own[a].items()) / norm[a] / norm[b] for a, b, _, _ in chosen}
    found = {(x["cand_id"], x["ref_id"]): x["sim"] for x in got.collect()}
    assert set(found) == {k for k, v in want.items() if v > 0}
    assert all(v == pytest.approx(want[k], abs=1e-12) for k, v in found.items())


def test_a_survey_stands_below_its_twin(spark):
    """The same work, once with a title that says survey."""
    r = random.Random(5)
    vocabulary = [*(f"topic{chr(97 + i % 26)}{i}" for i in range(300)), "survey", "comprehensive"]  # so the words alone are nothing new
    refs = [work(i, r.choices(vocabulary, k=160), True) for i in range(160)]
    ordinary = [work(1000 + i, r.choices(vocabulary, k=160), False) for i in range(24)]
    surveys = [work(2000 + i, w[2].split(), False, f"A comprehensive survey of {w[1]}") for i, w in enumerate(ordinary)]
    new = work(3000, [f"fresh{chr(97 + i % 26)}{i}" for i in range(160)], False)
    rows = {x["cand_id"]: x["novelty"] for x in novelty.novelty(spark.createDataFrame([*refs, *ordinary, *surveys, new], WORK)).collect()}
    assert mean(rows[2000 + i] for i in range(24)) < mean(rows[1000 + i] for i in range(24)) - 5
    assert rows[3000] > max(rows[1000 + i] for i in range(24))


def test_shown_texts(spark):
    from pyspark.sql import functions as F

    one = spark.range(1)
    x = one.select(text.compact(F.lit(950)).alias("a"), text.compact(F.lit(1250)).alias("b"), text.compact(F.lit(2_000_000)).alias("c"), text.author_line(F.array(*map(F.lit, "abcdef"))).alias("d"), text.author_line(F.array().cast("array<string>")).alias("e")).first()
    assert tuple(x) == ("950", "1.3K", "2M", "a, b, c, d, +2", "Unknown authors")
    df = spark.createDataFrame([("A &amp; <i>b</i>", None, "x &lt; y")], "title string, abstract string, source_name string")
    assert tuple(text.display_clean(df).first()) == ("A & b", "", "x < y")
