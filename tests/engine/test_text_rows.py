"""Texts that are worked on row by row."""

import re

from pyspark.sql import functions as F

from perigee.functions import text
from perigee.plans.queries import QUERIES


def test_wide_characters_are_looked_for_in_few_ranges():
    """The first pattern holds every character that becomes several ones, in three parts at most; the exact one no
    other."""
    near, exact = text._wide()
    wide = {c for c, _ in text._folds()[2]}
    assert near.count("-") <= 3 and exact.count("-") < len(wide) / 2
    ranges = lambda p: [(int(a, 16), int(b, 16)) for a, b in re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", p)]
    assert {chr(n) for a, b in ranges(exact) for n in range(a, b + 1)} == wide
    assert all(any(a <= ord(c) <= b for a, b in ranges(near)) for c in wide)


def test_search_text_of_every_wide_character(spark):
    """As Python's NFKD, one character to a row and all in one text."""
    from perigee.params import search_text

    wide = [c for c, _ in text._folds()[2]]
    values = [f"Ab{c}\u00e9 \u2019x" for c in wide] + [" ".join(wide), "\u2014\u4e2d z", "\U0001f600 q", "\u00df\u0130"]
    got = spark.createDataFrame([(v,) for v in values], "t string").select("t", text.search_text(F.col("t")).alias("s")).collect()
    assert all(r["s"] == search_text(r["t"]) for r in got)


def test_inverted_index(spark):
    rows = [["a", "b", "a", "", "c", "a"], ["", "x"], ["z"], [f"w{i % 97}" for i in range(1000)]]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, words array<string>").select("i", text.inverted_index(F.col("words")).alias("m")).collect()
    for i, m in got:
        assert m == {w: [p for p, x in enumerate(rows[i]) if x == w] for w in rows[i] if w}


def test_nothing_is_shuffled(spark, sf_dir):
    for name in ("abstract_from_index", "snippets", "category_evidence", "interest_match"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan, name
