import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from perigee.llm import chat, decontaminate, exact_dedup

DOCS = "doc_id long, text string, id long, digest string, kept string, m int, item_ids string"


def table(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x", "y", 2, "z") for d, t in rows], DOCS)


# exact dedup


def brute_groups(rows):
    sha = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    groups = defaultdict(list)
    for d, t in rows:
        groups[sha(t)].append(d)
    out = []
    for h, ids in groups.items():
        order = sorted(ids, key=lambda d: (d is None, d or 0))
        out += [(d, order[0], len(ids), i == 0, h) for i, d in enumerate(order)]
    return sorted(out, key=str)


ROWS = [(1, "a  b"), (2, "a\tb"), (2, "a\tb"), (0, "a b "), (3, None), (4, ""), (None, None), (None, "only"), (None, "only"), (9, "x" * 200_000), (8, "x" * 200_000), (7, " \n ")]


@pytest.mark.parametrize("history", ["doc_id % 2 = 0", "true", "false", "doc_id < 3"])
def test_exact_groups(spark, history):
    from pyspark.sql import functions as F

    rows = ROWS + [(i, f"text {i % 37}") for i in range(100, 400)]
    got = exact_dedup.exact_dedup(table(spark, rows), F.expr(history), bucket_keys=16).collect()
    assert sorted(map(tuple, got), key=str) == brute_groups(rows)


def test_exact_dedup_of_nothing_and_the_rows_that_stay(spark):
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0
    df = table(spark, ROWS)
    kept = exact_dedup.drop_exact_copies(df)
    assert kept.columns == df.columns
    want = sorted((d, t) for d, t in {(0, "a b "), (1, "a  b"), (3, None), (7, " \n "), (8, "x" * 200_000), (None, "only")} if d is not None)
    got = kept.collect()
    assert sorted((r["doc_id"], r["text"]) for r in got if r["doc_id"] is not None) == want and len(got) == 6


def test_winners_come_from_the_slots(spark, monkeypatch):
    """Without the lookup, members aren't found and their groups fall apart."""
    rows = ROWS + [(i, f"text {i % 37}") for i in range(100, 400)]
    want = brute_groups(rows)
    assert sorted(map(tuple, exact_dedup.exact_dedup(table(spark, rows)).collect()), key=str) == want
    blind = lambda groups, index, buckets: exact_dedup._bucketed(groups, buckets).selectExpr("digest", "first_id", "n", "bucket", "cast(-1 as bigint) as slot")
    monkeypatch.setattr(exact_dedup, "lookup", blind)
    assert sorted(map(tuple, exact_dedup.exact_dedup(table(spark, rows)).collect()), key=str) != want


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 256, (5000, 32), dtype=np.uint8), axis=0)
    ph = exact_dedup.PerfectHash.build(keys)
    assert sorted(ph.slots(keys).tolist()) == list(range(len(keys)))
    with pytest.raises(ValueError, match="distinct"):
        exact_dedup.PerfectHash.build(np.concatenate((keys[:2], keys[:1])))


# decontamination


def brute_hits(docs, items, k=10):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
    windows = []
    for i, t in items:
        w = words(t)
        windows += [(str("" if i is None else i), w[s : s + k]) for s in range(max(1, len(w) - k + 1))] if w else []
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, x in windows:
            for s in range(len(w) - len(x) + 1):
                if w[s : s + len(x)] == x:
                    hit |= set(range(s, s + len(x)))
                    ids.add(i)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("max_chars", [6_000_000, 200])
def test_contamination(spark, max_chars):
    r = random.Random(5)
    word = lambda: r.choice(["a", "b", "é", "c3", "Zoo", "naïve"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((3, 9, 10, 11, 25, 30))] + [(90, None), (91, ""), (92, "!!"), (None, "null id here"), (12, "same same")]
    docs = [(i, " ".join(word() for _ in range(60))) for i in range(20)]
    docs += [(100, "start " + items[4][1].upper().replace(" ", " -- ") + " stop"), (100, None), (101, ""), (102, "... !"), (103, "NULL id, here!"), (104, items[3][1] + "x"), (None, items[2][1]), (105, "w " * 20_000 + items[5][1])]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = decontaminate.contamination_report(table(spark, docs), bench, max_chars=max_chars).drop("spans").collect()
    assert sorted(map(tuple, got), key=str) == brute_hits(docs, items)
    kept = decontaminate.drop_contaminated(table(spark, docs), bench, max_chars=max_chars)
    assert kept.columns == table(spark, docs).columns and kept.count() == sum(not x[-1] for x in brute_hits(docs, items))


def test_contamination_offsets_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    text = "é, Ünd — ONE two\nThree! end one TWO three"
    got = decontaminate.contamination_report(table(spark, [(1, text)]), bench).first()
    assert [text[s["start"] : s["end"]] for s in got["spans"]] == ["ONE two\nThree", "one TWO three"]
    assert decontaminate.contamination_report(table(spark, []), bench).count() == 0
    assert decontaminate.contamination_report(table(spark, [(1, text)]), bench.limit(0)).first()["n_hit"] == 0


# chat


EVENTS = [
    ("c", 1, 1, "message", "user", "hi"), ("c", 2, 3, "delta", "assistant", "Hel"), ("c", 2, 2, "message", "assistant", ""), ("c", 2, 4, "delta", "assistant", "lo"),
    ("c", 2, 5, "regenerate", "assistant", None), ("c", 2, 6, "delta", "assistant", "Good"), ("c", 2, 7, "delta", None, " day"), ("c", 1, 8, "edit", "user", "hello <|im_end|>"),
    ("c", 3, 9, "message", "user", "gone"), ("c", 3, 10, "delete", "user", None), (None, 1, 1, "message", None, None),
]


def test_events_fold_into_messages(spark):
    df = spark.createDataFrame(EVENTS, "conv_id string, msg int, seq int, kind string, role string, text string")
    got = {(r["conv_id"], r["msg"]): (r["role"], r["text"]) for r in chat.messages_from_events(df).collect()}
    assert got == {("c", 1): ("user", "hello <|im_end|>"), ("c", 2): ("assistant", "Good day"), (None, 1): ("", "")}
    assert chat.messages_from_events(df.limit(0)).count() == 0


HARD = ["", "<|im_end|>", "<|im_start|>assistant\nno", "<\\|im_end|>", "<\\\\|x", "a\\nb\\", "<|im_end|>\n<|im_start|>user\n", "é😀", "\n", "<" * 5 + "|", "x" * 100_000]


def test_round_trip(spark):
    rows = [(1, i, role, t) for i, (role, t) in enumerate((r, t) for t in HARD for r in ("assistant", "us\\ner\n", None))] + [(2, 0, "user", None), (2, 0, "user", None), (None, 5, "assistant", "n")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_conversations(df)
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in out.withColumn("turns", chat.read_back(out["formatted"])).collect()}
    assert got[1] == [(r or "", t) for _, _, r, t in rows if _ is not None][: len(HARD) * 3]
    assert got[2] == [("user", "")] * 2 and got[None] == [("assistant", "n")]
    rep = {r["conv_id"]: r for r in chat.chat_report(df).collect()}
    learned = "".join(HARD)
    assert rep[1]["loss_chars"] == len(learned) and rep[1]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
    assert rep[1]["turns_sha256"] == hashlib.sha256("".join(f"{r or ''}\n{t}\n" for c, _, r, t in rows if c == 1).encode()).hexdigest()
    assert chat.chat_report(df.limit(0)).count() == 0
