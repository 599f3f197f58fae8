import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest

from perigee.llm import queries, substrings

DOCS = "doc_id long, text string, doc long, lo int, copied string, core string"


def brute(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, raw, strict=True):
        hit = np.zeros(len(t) + 1, np.int8)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                hit[i : i + length] = 1
        kept = bytes(c for c, h in zip(t, hit, strict=False) if not h)
        out.append((d, len(t), int(hit.sum()), int((np.diff(np.concatenate(([0], hit))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, length, **options):
    df = spark.createDataFrame([(d, t, 1, 2, "x", "y") for d, t in rows], DOCS)
    got = substrings.remove_repeats(df, length, **options).collect()
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"] and len(r["removed"]) == r["n_spans"]
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str)


def test_documents_as_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows, 400) == brute(rows, 400)
    assert run(spark, rows, 60) == brute(rows, 60)


def _registered(spark, path):
    got = queries.op7_repeated_substrings(spark, path).collect()
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_registered_query_as_brute_force(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows, 400)
    for threshold in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            assert _registered(spark, path) == want
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert any(r[2] for r in want)


def test_files_split_anew_between_jobs(spark, tmp_path, monkeypatch):
    """The scan may be split otherwise in each job (executors come and go)."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(12).write.parquet(str(tmp_path / "documents.parquet"))
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], 400)
    sizes = itertools.cycle(["4k", "1m", "64k"])
    real = substrings.written

    def resplit(df):
        out = real(df)
        spark.conf.set("spark.sql.files.maxPartitionBytes", next(sizes))
        return out

    monkeypatch.setattr(substrings, "written", resplit)
    try:
        assert _registered(spark, str(tmp_path)) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("seed", range(4))
def test_random_texts_of_few_letters(spark, seed):
    r = random.Random(seed)
    pool = ["".join(r.choices("ab", k=r.randint(5, 60))) for _ in range(12)]
    rows = [(i, "".join(r.choices(pool, k=r.randint(0, 6)))) for i in range(80)]
    length = r.choice([8, 20, 33])
    assert run(spark, rows, length) == brute(rows, length)


def test_odd_rows(spark, monkeypatch):
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefghij", k=7))
    passage = " ".join(word() for _ in range(70))
    own = lambda n: " ".join(word() for _ in range(n))
    rows = [(1, None), (1, None), (2, ""), (3, own(60)), (4, own(20) + passage + own(20)), (5, passage), (5, own(3) + passage), (None, passage + own(40)), (6, "é" * 300), (7, "z" * 401), (8, "q" * 400)]
    rows += [(9, own(30) + passage[:399]), (10, own(400) + passage[50:500] + own(300) + passage[:450])]
    rows += [(20, rows[10][1]), (21, "same " * 300), (22, "same " * 300)]
    assert run(spark, rows, 400) == brute(rows, 400)
    assert run(spark, [], 400) == []


def test_long_texts_in_chunks(spark, monkeypatch):
    text = "".join(random.Random(4).choices("abcd", k=5000))
    found = {}
    for chunk in (1 << 20, 700):
        starts = set()
        for i in range(0, len(text) - 99, chunk):
            _, at, lo, hi = substrings.anchors(text[i : i + chunk + 99].encode(), 100, 50)
            for a, x, y in zip(at, lo, hi, strict=True):
                starts |= {(s + i, a + i) for s in range(x, y + 1)}
        found[chunk] = starts
    assert found[700] == found[1 << 20] and len(found[700]) == 4901


def test_sliding_least():
    rng = np.random.default_rng(0)
    for width in (1, 2, 7, 50):
        x = rng.integers(0, 9, 200).astype(np.uint64)
        assert substrings.sliding_argmin(x, width).tolist() == [i + int(np.argmin(x[i : i + width])) for i in range(200 - width + 1)]
