import random

import numpy as np

from perigee.llm import similar_sets, simhash

COLS = "doc_id long, text string"


def brute_kept(rows, k, bound):
    """Ids that stay, from all pairs of shingle sets."""
    sets = [frozenset(simhash.shingle_hashes(t.encode(), k).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 10 * n >= round(10 * bound) * (len(sets[i]) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(d for i, (d, _) in enumerate(rows) if least[find(i)] == d)


def kept(spark, rows, **options):
    df = spark.createDataFrame(rows, COLS).repartition(3)
    return sorted(r["doc_id"] for r in simhash.drop_near_copies(df, **options).collect())


def edited(rng, words, n):
    """words with n of them changed, far from each other, so each costs five shingles."""
    out = list(words)
    for i in rng.sample(range(0, len(words) // 6), n):
        out[6 * i + 3] = f"x{rng.random()}"
    return " ".join(out)


def test_pairs_about_the_bound_as_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for f in range(150):  # 96 shingles; 2 changes are similarity 0.81, 3 are 0.73; one word more or less is between
        words = [f"f{f}w{i}" for i in range(100)]
        rows += [(10 * f + 1, " ".join(words)), (10 * f + 2, edited(rng, words, 2)), (10 * f + 3, edited(rng, words, 3)), (10 * f + 4, edited(rng, words[: rng.randint(70, 100)], 1))]
    exact = [f"e{i}" for i in range(13)]  # nine shingles; eight of them, then one other: 8/10
    rows += [(9001, " ".join(exact)), (9002, " ".join([*exact[:12], "other"])), (9003, "a b c"), (9004, "a b c"), (9005, "a b d"), (9006, "")]
    rng.shuffle(rows)
    want = brute_kept(rows, 5, 0.8)
    assert 9002 not in want and 9004 not in want
    assert kept(spark, rows) == want


def test_differing_bits_bound_the_sets_difference():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    sets = [np.unique(np.concatenate((base[: rng.integers(1, 900)], rng.integers(0, 1 << 63, rng.integers(1, 500), dtype=np.uint64)))) for _ in range(40)]
    bits = np.array([np.frombuffer(similar_sets.parity(x), "<u8") for x in sets])
    off = similar_sets.differing(bits[:33], bits)
    for i in range(33):
        for j in range(40):
            assert off[i, j] <= len(np.setxor1d(sets[i], sets[j]))
    assert (off.diagonal() == 0).all()


def test_large_groups_of_texts_under_the_bound_as_brute_force(spark):
    """A template's texts, pairwise under the bound, among which some have a near copy that no neighbour is."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, edited(rng, words, 3)) for i in range(1, 71)]
    rows += [(1000 + i, f"{rows[i][1]} end{i}") for i in range(0, 70, 7)]
    want = brute_kept(rows, 5, 0.8)
    assert len(want) == 70
    assert kept(spark, rows) == want
    texts = spark.createDataFrame([(i, i, t.encode()) for i, t in rows], "id long, text_hash long, text binary")
    make = simhash._set_maker(5)
    keys = texts.mapInArrow(similar_sets.then(make, lambda b: b.select([2, 1])), "node long, text_hash long").checkpoint()
    roots = similar_sets.similar_components(keys, texts, make, 0.8, window=1, block=8)
    assert roots.count() == 20 and roots.select("root").distinct().count() == 10


def test_rows_go_by_id_and_text(spark):
    one, other, third = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(None, one), (None, other), (1, one + " end"), (2, other + " end"), (3, third), (4, third + " end"), (4, "a clean text of the same id")]
    df = spark.createDataFrame(rows, COLS)
    assert sorted(tuple(r) for r in simhash.drop_near_copies(df).collect() if r["doc_id"]) == sorted([rows[2], rows[3], rows[4], rows[6]])
