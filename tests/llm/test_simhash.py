import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from perigee.llm import similar_sets, simhash
from perigee.llm.components import connected_components

DOCS = "doc_id long, text string, a string, fp string, id string, component_id string"


def brute_fingerprint(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(simhash.LOWER))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, k, radius):
    fps = [brute_fingerprint(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return sorted(((d, f"{f:016x}", least.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps, strict=True))), key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "x", "y", "z", "w") for d, t in rows], DOCS)
    return sorted(map(tuple, simhash.near_duplicates(df, **options).collect()), key=str)


def test_whole_table_as_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows, shingle=3) == brute_components(rows, 3, 2)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(40_000))
    rows = [(1, "a b c d"), (2, "A  b\tc\nd"), (2, "a b c d"), (7, None), (5, ""), (None, " \n"), (None, "only null id"), (9, "one two"), (3, long), (4, long + " end"), (8, "a b c e")]
    assert run(spark, rows, shingle=3) == brute_components(rows, 3, 2)
    assert run(spark, [], shingle=3) == []


def test_chains_of_links(spark):
    base = 0x123456789ABCDEF0
    fps = [base, base ^ 3, base ^ 15, base ^ 63, ~base & (1 << 64) - 1]
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    links = simhash.ball_links(df, 2)
    assert links.count() == 3
    roots = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert len(roots) == 4 and len(set(roots.values())) == 1


def test_two_bit_balls(spark):
    base = 0x0F0F0F0F
    df = spark.createDataFrame([(base,), (base ^ 0b1111,), (base ^ 0b11111,)], "fp long")
    got = {(r["a"], r["b"]) for r in simhash.ball_links(df, 4, bits=32).collect()}
    want = {tuple(sorted((x, y))) for x, y in ((base, base ^ 15), (base ^ 15, base ^ 31))}
    assert got == want
    with pytest.raises(ValueError, match="even"):
        simhash.ball_links(df, 3)


def test_near_copies_go_and_others_stay(spark):
    words = [f"word{i}" for i in range(400)]
    edit = lambda *at: " ".join("new" if i in at else w for i, w in enumerate(words))
    other = " ".join(f"other{i}" for i in range(400))
    rows = [(1, edit()), (2, edit(200)), (3, edit(399)), (4, other), (5, other + " end"), (6, None), (7, ""), (8, "short text"), (None, edit())]
    df = spark.createDataFrame([(d, t, "x", "y", "z", "w") for d, t in rows], DOCS)
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.where(F.col("doc_id").isNotNull()).collect()) == [1, 4, 6, 7, 8]
    assert simhash.drop_near_copies(df.limit(0)).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(1000, 2000 + i) for i in range(300)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {1000: 1000} | {2000 + i: 1000 for i in range(300)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_half_balls_as_brute_force(spark):
    rng = random.Random(11)
    flipped = lambda x, n: x ^ sum(1 << i for i in rng.sample(range(64), n))
    fps = {flipped(base, n) for base in (rng.getrandbits(64) for _ in range(200)) for n in (0, 3, 5, 6)}
    want = {frozenset((x, y)) for x in fps for y in fps if x < y and bin(x ^ y).count("1") <= 5}
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    assert len(want) >= 400
    assert {frozenset(x & (1 << 64) - 1 for x in r) for r in simhash.half_ball_links(df).collect()} == want
    with pytest.raises(ValueError, match="radius"):
        simhash.half_ball_links(df, 6)


def test_near_copies_are_found_by_their_fingerprints(spark, monkeypatch):
    """With a prefix filter that finds nothing; and fingerprints alone drop nothing that the sets don't confirm."""

    def silent(shared, bound):
        def run(batches):
            for _ in batches:
                pass
            return iter(())

        return run

    monkeypatch.setattr(similar_sets, "_prefixes", silent)
    words = [f"word{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[:399] + ["new"]), " ".join(f"other{i}" for i in range(400)), "one text", " ".join(words[:200])]
    df = spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in enumerate(texts, 1)], DOCS)
    assert sorted(r["doc_id"] for r in simhash.drop_near_copies(df).collect()) == [1, 3, 4, 5]
    made = spark.createDataFrame([(1, 7), (2, 7), (2, 6), (3, 7 ^ (31 << 30)), (4, 7 ^ (63 << 30))], "node long, fp long")
    assert {tuple(r) for r in simhash.likely_pairs(made).collect()} == {(1, 2), (1, 3), (3, 4)}
