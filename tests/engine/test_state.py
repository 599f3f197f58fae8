import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from perigee.engine import Engine
from perigee.operators import similarity
from perigee.plans import novelty, views
from perigee.sources import pages
from perigee.sources.store import Store


def test_paged_source(spark, tmp_path):
    rows = [{"id": f"W{i}"} for i in range(250)]
    for k in range(3):
        name = "first" if not k else f"c{k}"
        (tmp_path / f"{name}.json").write_text(json.dumps({"results": rows[k * 100 : k * 100 + 100] + rows[:1], "meta": {"next_cursor": f"c{k + 1}" if k < 2 else None}}))
    pages.register(spark)
    got = spark.read.format("paged_json").option("path", str(tmp_path)).load()
    assert got.count() == 250 and got.select("id").distinct().count() == 250
    assert spark.read.format("paged_json").options(path=str(tmp_path), limit=120).load().count() == 120


def test_retry_and_budget():
    waits, answers = [], [pages.Transient(503), pages.Transient(429, 7.0), {"ok": 1}]

    def call():
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert pages.with_retry(call, sleep=waits.append) == {"ok": 1} and waits == [0.75, 7.0]
    with pytest.raises(pages.Transient):
        pages.with_retry(lambda: (_ for _ in ()).throw(pages.Transient(404)), sleep=waits.append)
    b = pages.Budget(0.002)
    b.take(True), b.take(True)
    with pytest.raises(pages.BudgetError):
        b.take(False)
    assert pages.request_params({"a": 1, "b": "", "c": None}, "x@y") == {"a": 1, "mailto": "x@y"}


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    assert s.read("t") is None and s.count("t") == 0
    s.put("t", spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), "id")
    s.put("t", spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), "id")
    assert sorted(map(tuple, s.read("t").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    s.delete_where("t", F.col("id") < 2)
    assert s.count("t") == 2 and s.get("t", "id", 3).first()["v"] == "d" and s.get_many("t", "id", [2, 2, 9]).count() == 1
    s.truncate("t")
    assert s.count("t") == 0


def test_similarity_as_pairwise(spark, sf_dir):
    """The term join and a naive computation over all chosen pairs agree to nine places."""
    p = novelty.parts(views.works(spark, sf_dir))
    vec, norm = {}, {}
    for r in p.vec.collect():
        vec.setdefault(r["id"], {})[r["term"]] = r["w"]
    norm = {i: sum(w * w for w in v.values()) ** 0.5 for i, v in vec.items()}
    sims = {(r["cand_id"], r["ref_id"]): r["sim"] for r in p.sims.collect()}
    chosen = p.chosen.collect()
    assert chosen
    for r in chosen:
        a, b = vec.get(r["cand_id"], {}), vec.get(r["ref_id"], {})
        want = sum(w * b[t] for t, w in a.items() if t in b)
        want = want / (norm[r["cand_id"]] * norm[r["ref_id"]]) if want else 0.0
        assert sims.get((r["cand_id"], r["ref_id"]), 0.0) == pytest.approx(want, abs=1e-9)
    assert similarity.crowdedness(p.counts, p.sims).where("crowding < 0 OR crowding > 1").count() == 0


def test_engine(spark, sf_dir, tmp_path):
    e = Engine(spark, str(tmp_path / "engine"))
    e.configure(max_timeframe_days=90, novelty_selectivity=10, authorship_selectivity=1, english_only=False)
    e.ingest(views.works(spark, sf_dir), views.authors(spark, sf_dir), views.authorships(spark, sf_dir), as_of=views.AS_OF)
    e.score()
    scores = e.store.read("scores")
    assert scores.count() and scores.where("novelty NOT BETWEEN 0 AND 100 OR isnan(novelty) OR discovery NOT BETWEEN 0 AND 100").count() == 0
    f = e.feed(views.AS_OF, "3m", "novelty", limit=5).collect()
    assert [r["novelty"] for r in f] == sorted((r["novelty"] for r in f), reverse=True) and len(f) == 5
    assert e.bundle(date(2024, 3, 31)).count() >= 1
    assert e.notify(views.AS_OF).count() <= 10
    e.mark_read()
    assert e.store.read("inbox").where("unread").count() == 0
    s = e.status()
    assert s["works"] == s["baseline"] + s["candidates"] and s["authors"] == 150 or s["authors"] > 0
