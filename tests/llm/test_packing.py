import random
import zlib
from array import array
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from perigee.llm import packing
from perigee.llm.queries import tokenizer_path

ODD = [
    "don't stop  it's á b\x1cc  x y <|endoftext|> a<|startoftext|>b", "", "\n\t", "ÀÉ’s … ...", "日本語 テスト é ́x", "<|ENDOFTEXT|> <|endof text|>",
    "a\x85b 12 345", "x" * 5000, "' s 't 'S", "ẞ ß İ İ. Σ. ΣΑΣ, ſ K Å ﬁ. ½. x½.", "ʼn ªº ⅷ. １２.", "Á C..., x;y z!? é. É!",
]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: t.encode(text, add_special_tokens=False).ids


def ids(texts):
    return [array("I", x).tolist() for x in packing.encode_texts(tokenizer_path(), [t.encode() for t in texts])]


def test_ids_as_of_whole_texts(spark, sf_dir, whole):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert ids(texts) == [whole(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aB.,;:!?'’ \n\t<|>éÉ́ſK0½")), max_size=40))
def test_ids_of_any_text(whole, text):
    assert ids([text]) == [whole(text)]


def best_fit_decreasing(counts, capacity):
    gaps, n = Counter(), 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            gap = min((g for g, k in gaps.items() if k and g >= length), default=None)
            if gap is None:
                n, gap = n + 1, capacity
            else:
                gaps[gap] -= 1
            gaps[gap - length] += 1
    return n


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 64, 500])
    counts = {r.randint(1, capacity): r.randint(1, 40) for _ in range(60)}
    used, ranks = defaultdict(list), defaultdict(int)
    for length, rank, items, first, per, offset in packing.plan(counts, capacity):
        assert rank == ranks[length]
        ranks[length] += items
        for i in range(items):
            used[first + i // per].append((offset + i % per * length, length))
    assert ranks == counts
    for spans in used.values():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at <= capacity
    assert len(used) == best_fit_decreasing(counts, capacity)


def check(rows, docs, whole, capacity):
    want = []
    for d, t in docs:
        x = [*whole(t or ""), 0]
        for k, at in enumerate(range(0, len(x), capacity)):
            piece = x[at : at + capacity]
            want.append((d, k, at, len(piece), zlib.crc32(array("I", piece).tobytes())))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want) if all(d is not None for d, _ in docs) else True
    assert len(rows) == len(want)
    used = defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in used.values():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at <= capacity
    return len(used)


def test_documents(spark, sf_dir, whole):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = packing.pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path()).collect()
    n = check(rows, docs, whole, 2048)
    assert n <= 1.01 * sum(r["length"] for r in rows) / 2048 + 1
    assert n == best_fit_decreasing(Counter(r["length"] for r in rows), 2048)


def test_odd_rows(spark, whole):
    docs = [(1, None), (1, None), (2, ""), (3, "a " * 9000), (4, "b"), (4, "b")]
    df = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in docs], "doc_id long, text string, length int, part int, sequence_id int")
    check(packing.pack_documents(df, tokenizer_path()).collect(), docs, whole, 2048)
    assert packing.pack_documents(df.limit(0), tokenizer_path()).count() == 0
    nulls = spark.createDataFrame([(None, "x"), (None, None)], "doc_id long, text string")
    assert [r["doc_id"] for r in packing.pack_documents(nulls, tokenizer_path()).collect()] == [None, None]
