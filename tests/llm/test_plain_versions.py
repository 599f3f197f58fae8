"""The whole queries of op1, op2 and op6 against plain versions, word by word and pair by pair."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from perigee.llm import language, quality, queries, toxicity
from perigee.llm.shared import WordBatch, held_out

SF = "/root/testdata/sf0.001"
SPACE = re.compile(rb"[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def remainder(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def words_of(text):
    return [w for w in SPACE.split((text or "").encode()) if w]


# language


def trigrams(word):
    padded = b" " + word + b" "
    for a, b, c in zip(padded, padded[1:], padded[2:], strict=False):
        yield ((a | b << 8 | c << 16) * 0x9E3779B1 & 0xFFFFFFFF) >> 16


def plain_language(texts, langs, grams, scripts, penalty):
    """grams: language -> bucket -> count; scripts: language -> script -> letters."""
    size = {x: sum(n for k, n in grams[x].items() if k) for x in langs}
    weight = lambda x, k: math.log(grams[x][k] + 0.5) - math.log(size[x] + 0.5 * 65536) if k else 0.0
    writes = lambda x, s: scripts[x][s] >= 0.01 * max(1, sum(scripts[x].values()))
    for text in texts:
        words = words_of(text.lower() if text else text)
        table = []
        for w in words:
            lettered = sum(97 <= b <= 122 or b >= 128 for b in w)
            used = {s for s in map(language.script_of, w.decode()) if s}
            able = [x for x in langs if any(writes(x, s) for s in used - {"latin"} or used)] or langs
            table.append([(sum(weight(x, k) for k in trigrams(w)) if lettered else 0.0) + (0 if x in able else -1e4) for x in langs])
        best, came = None, []
        for s in table:
            if best is None:
                best = list(s)
                continue
            top = max(range(len(langs)), key=lambda i: (best[i], -i))
            step = [(best[top] - penalty, top) if best[top] - penalty > best[i] else (best[i], i) for i in range(len(langs))]
            came.append([k for _, k in step])
            best = [v + x for (v, _), x in zip(step, s, strict=True)]
        if not any(c.isalpha() for c in text or ""):
            yield "und", 0.0
            continue
        path = [max(range(len(langs)), key=lambda i: (best[i], -i))]
        for c in reversed(came):
            path.append(c[path[-1]])
        path.reverse()
        share = [sum(sum(97 <= b <= 122 or b >= 128 for b in w) for w, p in zip(words, path, strict=True) if p == i) for i in range(len(langs))]
        main = max(range(len(langs)), key=lambda i: (share[i], -i))
        inside = [sum(s[i] for s, p in zip(table, path, strict=True) if p == main) for i in range(len(langs))]
        sure = 1 / sum(math.exp(min(700, x - inside[main])) for x in inside)
        yield langs[main], share[main] / sum(share) * sure


def test_op1_as_plain(spark, rows):
    learned = [r for r in rows if r["lang"] and remainder(r["doc_id"], 5)]
    langs = sorted({r["lang"] for r in learned})
    grams, scripts = {x: Counter() for x in langs}, {x: Counter() for x in langs}
    for r in learned:
        for w in words_of((r["text"] or "").lower()):
            grams[r["lang"]].update(trigrams(w))
        scripts[r["lang"]]["latin"] += sum(map((r["text"] or "").count, "eai")) * 4
        scripts[r["lang"]].update(s for s in map(language.script_of, r["text"] or "") if s and s != "latin")
    want = dict(zip([r["doc_id"] for r in rows], plain_language([r["text"] for r in rows], langs, grams, scripts, 16.0), strict=True))
    got = queries.op1_language_id(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (remainder(r["doc_id"], 5) == 0)
        assert r["lang_pred"] == want[r["doc_id"]][0] and r["score"] == pytest.approx(want[r["doc_id"]][1], abs=1e-3)


def test_words_without_letters_favour_no_language(spark):
    rows = [(i, "привет мир как дела друг", "ru") for i in range(4)] + [(10 + i, "hello world how are you", "en") for i in range(4)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    lang, score, spans = language.predict(["привет 12 34 !! друг 5".encode(), b"hello 12 !!"], model, True)
    assert lang == ["ru", "en"] and [len(s) for s in spans] == [1, 1] and spans[0][0]["end"] == 6 and min(score) > 0.99


# quality


def word_hash(word):
    x, full = 0, (1 << 64) - 1
    for c in reversed(word):
        x = (x * int(WordBatch.BASE) + c + 1) & full
    x ^= len(word)
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & full
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & full
    return x ^ x >> 31


def plain_features(text, n_chars):
    """{feature: weight} of one text."""
    raw = (text or "").encode()
    words = words_of(text)
    low = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    bits = quality.WORD_BITS
    counts = Counter(word_hash(w) >> (64 - bits) for w in low)
    norm = math.sqrt(sum(math.log1p(n) ** 2 for n in counts.values()))
    out = {k: math.log1p(n) / norm for k, n in counts.items()}
    upper = lambda b: 65 <= b <= 90
    symbol = lambda b: 32 < b < 127 and not chr(b).isalnum() and b not in b".,;:'-"
    symbols, uppers = [sum(map(symbol, w)) for w in words], [sum(map(upper, w)) for w in words]
    n, size = max(1, len(words)), max(1, len(raw))
    repeats = sum(a == b for a, b in zip(low, low[1:], strict=False))
    symbol_words = sum(s >= 2 or 2 * s >= len(w) for s, w in zip(symbols, words, strict=True))
    upper_words = sum(u >= 2 and 2 * u >= len(w) for u, w in zip(uppers, words, strict=True))
    lone = sum(s == len(w) for s, w in zip(symbols, words, strict=True))
    lines = raw.count(b"\n")
    log = lambda x: min(quality.BINS - 1, math.ceil(math.log2(1 + max(x, 0))))
    share = lambda x: 0 if x <= 0 else 1 + min(quality.BINS - 2, math.floor(math.sqrt(min(1, x)) * (quality.BINS - 1)))
    bins = [
        log(len(words)), log(sum(map(len, words)) / n * 4), share(len(counts) / n), share(repeats / n), share(sum(map(symbol, raw)) / size), share(symbol_words / n),
        share(sum(map(upper, raw)) / size), share(upper_words / n), share(lone / n), share(sum(48 <= b <= 57 for b in raw) / size), log(lines), log(len(words) / (lines + 1)),
        log(repeats), log(symbol_words), log(upper_words), log(lone), 0 if n_chars is None else min(quality.BINS - 1, 1 + log(n_chars)),
    ]
    return out | {(1 << bits) + i * quality.BINS + b: 1 / math.sqrt(len(bins)) for i, b in enumerate(bins)}


def test_op2_as_plain(spark, rows):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    m = quality.fit(docs, labels.where(~held_out(F.col("doc_id"), 3, 1)), "quality")
    got = {r["doc_id"]: r for r in queries.op2_quality_classifier(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        x = plain_features(r["text"], r["n_chars"])
        at, vals = list(x), np.array(list(x.values()))
        v = m.v[at].astype(float) * vals[:, None]
        pairs = np.triu(v @ v.T, 1).sum()  # every pair of features
        p = 1 / (1 + math.exp(-(m.bias + float(m.w[at].astype(float) @ vals) + pairs)))
        g = got[r["doc_id"]]
        assert g["score"] == pytest.approx(p, abs=1e-4) and g["predicted"] == int(g["score"] >= 0.5)
        assert g["held_out"] == (remainder(r["doc_id"], 3) == 1)


# toxicity


def plain_letters(text):
    """Words as letter codes, the mark of their start first."""
    code = lambda b: b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 27 + (b & 3) if b >= 128 else 0
    words = [w for w in ([code(b) for b in w if code(b)] for w in words_of(text)) if w]
    for alone, run in itertools.groupby(words, lambda w: len(w) == 1):
        run = list(run)
        for w in [sum(run, [])] if alone and len(run) >= 3 else run:
            yield (toxicity.START, *(c for i, c in enumerate(w) if i < 2 or not c == w[i - 1] == w[i - 2]))


def test_op6_as_plain(spark, rows):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    m = toxicity.fit(docs, labels.where(~held_out(F.col("doc_id"), 4, 2)), "toxic")
    got = {r["doc_id"]: r for r in queries.op6_toxicity(spark, SF).collect()}
    assert len(got) == len(rows)
    held = {}

    def score(word):
        own = sum(toxicity.DECAY ** (2 * (k - i + 1)) for i, _, k in itertools.combinations(range(len(word)), 3) if k - i < toxicity.SPAN)
        total = sum(float(m.table[(word[i] * 32 + word[j]) * 32 + word[k]]) * toxicity.DECAY ** (k - i + 1) for i, j, k in itertools.combinations(range(len(word)), 3) if k - i < toxicity.SPAN)
        return max(-2.0, min(2.0, total / math.sqrt(own) + m.bias)) if own else -2.0

    a, b, c = m.calibration
    for r in rows:
        each = [held[w] if w in held else held.setdefault(w, score(w)) for w in plain_letters(r["text"])]
        e = a * max(each, default=-2.0) + b * min(3.0, sum(max(0.0, s) for s in each)) + c
        g = got[r["doc_id"]]
        assert g["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, e)))), abs=1e-3)
        assert g["predicted"] == int(g["score"] >= 0.3) and g["held_out"] == (remainder(r["doc_id"], 4) == 2)
