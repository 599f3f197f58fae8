import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from perigee.llm import ngrams
from perigee.llm.shared import held_out

DOCS = "doc_id long, text string, key long, token string, score string, c int"


def run(spark, rows, **options):
    df = spark.createDataFrame([(d, t, 1, "x", "y", 2) for d, t in rows], DOCS)
    return ngrams.score_documents(df, held_out(F.col("doc_id"), 7, 2), **options).collect()


def is_held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


def brute(rows):
    """What is exact: held_out, n_tokens, n_known, train_tokens, base_score of each row."""
    c = Counter()
    for d, t in rows:
        if not is_held(d):
            c.update(ngrams.tokens((t or "").encode()))
    n, v = sum(c.values()), len(c)
    for d, t in rows:
        x = ngrams.tokens((t or "").encode())
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x)
        yield d, is_held(d), len(x), sum(c[w] > 0 for w in x), n, base


def plain_scores(rows):
    """The model from dictionaries, without a filter and so without its errors."""
    one, two, n_texts = Counter(), defaultdict(Counter), 0
    for d, t in rows:
        if not is_held(d):
            x = ngrams.tokens((t or "").encode())
            n_texts += 1
            one.update(x)
            for v, w in zip([None, *x], x, strict=False):
                two[v][w] += 1
    n, types = sum(one.values()), len(one)
    often = {w for w, c in one.items() if c >= n * ngrams.FREQUENT_SHARE}
    rare = min(1.0, len(often) / (types - len(often))) if types > len(often) else 1.0
    m = lambda v, w: float(ngrams.mass(ngrams.quantise(np.array([two[v][w]])))[0]) * (1 if w in often else rare) if w in two[v] else 0.0
    total = {v: sum(m(v, w) for w in list(ws)) for v, ws in two.items()}

    def p(v, w):
        p1 = (one[w] + 1) / (n + types + 1)
        if v not in total:
            return p1
        count = n_texts if v is None else one[v] if v in often else 0
        keep = total[v] / max(count, total[v] + ngrams.DISCOUNT)
        return keep * m(v, w) / total[v] + (1 - keep) * p1

    for d, t in rows:
        x = ngrams.tokens((t or "").encode())
        yield d, len(x), sum(math.log10(p(v, w)) for v, w in zip([None, *x], x, strict=False))


def check(got, rows):
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=order)
    want = sorted(((*x[:5], round(x[5], 6)) for x in brute(rows)), key=order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], abs=1e-5)


def documents(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]


def test_whole_table(spark):
    rows = documents(spark, "sf0.01")
    got = run(spark, rows)
    check(got, rows)
    assert all(r["score"] < 0 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_as_a_plain_model(spark):
    rows = documents(spark, "sf0.001")
    want = sorted(plain_scores(rows))
    for options in ({"bits_per_entry": 120}, {"bits_per_entry": 120, "segment_bytes": 1 << 14, "max_shard_bytes": 1 << 17}):
        got = sorted((r["doc_id"], r["n_tokens"], r["score"]) for r in run(spark, rows, **options))
        assert [g[:2] for g in got] == [w[:2] for w in want]
        for (_, n, x), (_, _, y) in zip(got, want, strict=True):
            assert abs(x - y) <= 0.02 * n  # contexts' sums are held to 4 %


def test_scores_do_not_depend_on_shards(spark):
    rows = documents(spark, "sf0.001") + [(77, "a b"), (77, "a b"), (None, None)]
    score = lambda **o: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], round(r["base_score"], 6), round(r["score"], 5)) for r in run(spark, rows, segment_bytes=1 << 15, **o))
    assert score() == score(max_shard_bytes=1 << 16)


@pytest.mark.parametrize("bits", [12, 16])
def test_probabilities_sum_to_one(spark, bits, monkeypatch):
    """Over the whole vocabulary and one unknown token, by class of count(v), within 1 %."""
    monkeypatch.setattr(ngrams, "FREQUENT_SHARE", 2e-5)  # so that there are rare tokens
    rows = documents(spark, "sf0.01")
    texts = [(t or "").encode() for d, t in rows if not is_held(d)]
    df = spark.createDataFrame([(bytearray(t),) for t in texts], "text binary")
    model, counts, filled, segments = ngrams.learn(df, bits_per_entry=bits, segment_bytes=1 << 16)
    (shard,) = ngrams.shards(filled, segments, 1 << 30)
    c = {bytes(r["token"]): r["c"] for r in counts.collect()}
    words = sorted(c)
    w = ngrams.token_hashes(words)
    table = model.table
    place = table.find(w)
    frequent = place < table.start
    p1 = np.array([c[x] + 1 for x in words]) / (model.total + model.distinct + 1)
    by_class = defaultdict(list)
    order = sorted(words, key=lambda x: zlib.crc32(x))
    for x in order:
        k = int(math.log(c[x], 4))
        if len(by_class[k]) < 40:
            i = words.index(x)
            _, own, b = ngrams.terms(np.full(len(w), w[i]), np.full(len(w), place[i]), w, frequent, model, shard)
            by_class[k].append(float((own + b * p1).sum() + b[0] / (model.total + model.distinct + 1)))
    assert len(by_class) >= 6
    for k, sums in by_class.items():
        assert abs(np.mean(sums) - 1) < 0.01, (k, sums)
    _, own, b = ngrams.terms(np.full(len(w), ngrams.START), np.full(len(w), table.start), w, frequent, model, shard)
    assert abs((own + b * p1).sum() - 1) < 0.03
    _, own, b = ngrams.terms(np.full(len(w), np.uint64(12345)), np.full(len(w), table.start + 1), w, frequent, model, shard)
    assert abs((own + b * p1).sum() - 1) < 0.02  # a context that was never seen


def test_odd_rows(spark):
    words = random.Random(1).choices([f"w{i}" for i in range(300)], k=30_000)
    rows = [(1, None), (1, None), (2, ""), (3, " \n\t"), (4, "A a\x0bB"), (None, "a b"), (None, "a b"), (5, " ".join(words)), (6, "é É ñ"), *((100 + i, "same words again") for i in range(40))]
    check(run(spark, rows), rows)
    assert run(spark, []) == []
    only_held = [(d, "a b") for d in range(60) if is_held(d)]
    got = run(spark, only_held)
    assert len(got) == len(only_held) and {r["n_known"] for r in got} == {0} and {r["train_tokens"] for r in got} == {0}


def test_filter_holds_every_quantised_count():
    rng = np.random.default_rng(5)
    h = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2))
    q = ngrams.quantise(np.maximum(1, rng.pareto(1.0, len(h)).astype(np.int64)))
    groups = np.unique(h >> np.uint64(ngrams.LOW))[::50] << np.uint64(ngrams.LOW)
    total = rng.pareto(1.0, len(groups)) + 1
    bits = int(q.sum() + 3 * len(groups)) * ngrams.BITS_PER_ENTRY // 8 * 8
    scale = ngrams.Scale.to(0.25, total.max())
    data = ngrams.fill(h, q, groups, scale.number(total), bits).tobytes()
    f = ngrams.Shard(1, 0, np.zeros(1, np.int64), np.array([bits], np.uint64), np.zeros(1), data)
    seg = lambda x: np.zeros(len(x), np.int64)
    got = f.levels(h, seg(h))
    assert (got >= q).all() and (got == q).mean() > 0.99
    assert np.abs(f.totals(groups, seg(groups), scale) / total - 1).max() < 0.04
    strange = np.unique(rng.integers(0, 1 << 63, 50_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    rate = (1 - math.exp(-ngrams.PROBES / ngrams.BITS_PER_ENTRY)) ** ngrams.PROBES  # what the filter is designed for
    assert (f.levels(strange, seg(strange)) > 0).mean() < 1.3 * rate < 0.005
    assert (f.totals(strange, seg(strange), scale) > 0).mean() < 0.01


def test_tokens_counted_and_named(spark):
    texts = [b"a b a b c", b"", b"b a"]
    df = spark.createDataFrame([(bytearray(t),) for t in texts], "text binary")
    assert {bytes(r["token"]): r["c"] for r in ngrams.token_counts(df).collect()} == Counter(w for t in texts for w in ngrams.tokens(t))
    s = ngrams.Stream(texts)
    assert (ngrams.token_hashes([b"a", ngrams.END, b"c"]) == s.hash[[0, 5, 4]]).all()
    before = s.before(s.hash, ngrams.START)
    assert (before[[0, 6, 7]] == ngrams.START).all() and (before[1:5] == s.hash[:4]).all()


def test_places():
    rng = np.random.default_rng(3)
    h = rng.integers(1, 1 << 63, 5000, dtype=np.uint64) & ~np.uint64(0xFF00)  # many meet
    h = np.unique(h)
    t = ngrams.Table(h[::2])
    assert (t.keys[t.find(h[::2])] == h[::2]).all() and (t.find(h[1::2]) == t.start + 1).all()
    assert (ngrams.Table(h[:0]).find(h) > 0).all()


def test_workers_hold_no_copy_of_a_shard(spark):
    data = np.random.default_rng(0).integers(0, 256, 64 << 20, np.uint8).tobytes()
    sent = ngrams.Sent(spark.sparkContext, ngrams.Shard(1, 0, np.zeros(1, np.int64), np.array([8 * len(data)], np.uint64), np.zeros(1), data))

    def look(_):
        own = lambda: next(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith("Anonymous:"))
        before, f = own(), sent.value
        return [((own() - before) >> 10, zlib.crc32(f.data[: 64 << 20]), f.segments)]

    grown, crc, segments = spark.sparkContext.parallelize([0], 1).mapPartitions(look).first()
    assert (crc, segments) == (zlib.crc32(data), 1)
    assert grown < 16  # MB; 64 or more if the worker unpickles the shard


def test_an_older_frame_is_right_after_a_newer_call(spark):
    df = spark.createDataFrame([(i, f"a b c{i % 9} a d{i} b") for i in range(60)], "doc_id long, text string")
    older = ngrams.score_documents(df, held_out(F.col("doc_id"), 7, 2))
    want = sorted(older.collect())
    assert len(ngrams._sent) == 3  # the model, a shard and its data; what other calls sent is taken back
    assert sorted(ngrams.score_documents(df, held_out(F.col("doc_id"), 7, 2)).collect()) == want
    assert sorted(older.collect()) == want
