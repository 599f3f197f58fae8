"""Toxicity: a support vector machine with a subsequence string kernel and Nystroem landmarks.

The kernel of two words counts common subsequences of three letters, each occurrence weighted by
DECAY ** (letters spanned), spans of SPAN letters at most; it is divided by the square roots of both words'
own weights. So an insult with letters inserted, doubled or left apart stays close to the plain one. A mark
for its start is a word's first letter. Characters other than letters are dropped inside words, a letter
more than twice in a row counts twice, and letters that stand apart are read as one word.

Labelled sentences: each sentence of a labelled text carries the text's label. Words that toxic sentences
hold far more often than clean ones, alone or by a run of letters they share with others, are the positive
candidates, and each sentence of a toxic text votes for its best one: those with votes are the positive
examples. Words of clean sentences are the negative ones, and after each round those that the machine
scores highest join them. Landmarks are taken from both, the kernel between landmarks gives the Nystroem
map, and a linear machine (squared hinge) is trained on it. A linear machine on that map is one weight per
landmark, and landmarks are sums over subsequences: so the machine folds into one weight per three-letter
subsequence, and a word is scored in time linear in its length.

A text's score is a logistic function of its highest word score and the sum of those above zero, fitted on
the training texts.

Fitting uses documented bounded samples: about `max_rows` labelled texts, `positives` and `negatives`
distinct words. Every text is scored whole.

Defined results: null text counts as empty; a text without a word of three letters gets the score of the
lowest evidence; labels other than 0 and 1 are left out; with no toxic or no clean row every score is 0;
repeated rows get equal scores; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.llm.shared import LOWER, bounded_sample, bytes_of, materialize, mix

LETTERS = 32
SPAN = 6
DECAY = 0.7
#: Offsets of the second and third letter of a subsequence from the first.
OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
#: Bytes to letter codes: a-z from 1, non-ASCII bytes to four further codes, all others 0.
_CODES = bytes(b - 96 if 97 <= b <= 122 else 27 + (b & 3) if b >= 128 else 0 for b in range(256))
_CODE_OF = np.frombuffer(_CODES, np.uint8)
BLANK = 255
#: The code of a word's start.
START = 31
#: Letters in the runs that words are compared by when positives are picked.
RUN = 5
_SENTENCE = re.compile(rb"[.!?\n]+")


class Letters:
    """Words of texts as runs of letter codes; `word` bounds and `doc` as flat arrays."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        a = np.frombuffer(b" ".join(texts).translate(LOWER) + b" ", np.uint8)
        text_end = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, self.n))
        blank = (a == 32) | ((a >= 9) & (a <= 13))
        code = np.where(blank, np.uint8(BLANK), _CODE_OF[a])
        keep = np.flatnonzero(code)  # letters and blanks
        code = code[keep]
        owner = np.searchsorted(text_end, keep, side="right") if self.n else keep
        inside = code != BLANK
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
        start, end = edge[0::2], edge[1::2]
        doc = owner[start] if len(start) else start
        # three or more letters that stand apart, one after another, are one word
        single = (end - start) == 1
        joined = np.zeros(len(start), bool)  # the word goes on from the one before
        if single.any():
            next_to = np.concatenate(([False], single[1:] & single[:-1] & (doc[1:] == doc[:-1])))
            run = np.cumsum(~next_to)
            long_run = np.bincount(run, minlength=run[-1] + 1)[run] >= 3
            joined = next_to & long_run & single
        letters = code[inside]
        size = end - start
        first = ~joined
        word = np.cumsum(first) - 1
        self.doc = doc[first] if len(doc) else doc
        of = np.repeat(word, size)  # the word of each letter
        drawn_out = np.zeros(len(letters), bool)
        drawn_out[2:] = (letters[2:] == letters[1:-1]) & (letters[2:] == letters[:-2]) & (of[2:] == of[:-2])
        letters = letters[~drawn_out]
        self.size = np.bincount(of[~drawn_out], minlength=int(first.sum())).astype(np.int64)
        begin = np.cumsum(self.size) - self.size
        self.size = self.size + 1
        self.start = np.cumsum(self.size) - self.size
        self.code = np.insert(letters.astype(np.int32), begin, START)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.size):
            return np.zeros(0, np.uint64)
        at = np.arange(len(self.code)) - np.repeat(self.start, self.size)
        with np.errstate(over="ignore"):
            return mix(np.add.reduceat(mix((self.code.astype(np.uint64) << np.uint64(32)) + at.astype(np.uint64) + np.uint64(1)), self.start))

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and sizes of some words."""
        size = self.size[which]
        at = np.repeat(self.start[which] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        return self.code[at], size


def own_weight(size: np.ndarray) -> np.ndarray:
    """A word's kernel with itself, were no subsequence to come twice."""
    return sum(np.maximum(0, size - b) * DECAY ** (2 * (b + 1)) for _, b in OFFSETS)


def word_sums(code: np.ndarray, size: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each word: the sum over its subsequences of DECAY ** span times the table's weight."""
    n = len(code)
    if not n:
        return np.zeros(len(size))
    start = np.cumsum(size) - size
    left = np.repeat(start + size, size) - np.arange(n)  # letters from here to the word's end
    total = np.zeros(n, np.float32)
    padded = np.concatenate((code, np.zeros(SPAN, code.dtype)))
    for a, b in OFFSETS:
        idx = (code * LETTERS + padded[a : a + n]) * LETTERS + padded[b : b + n]
        total += np.where(left > b, table[idx], np.float32(0)) * np.float32(DECAY ** (b + 1))
    return np.add.reduceat(total, start) * (size > 0)


def expand(code: np.ndarray, size: np.ndarray) -> np.ndarray:
    """[word, subsequence] weights of a few words, scaled by their own weight."""
    out = np.zeros((len(size), LETTERS**3), np.float32)
    start = np.cumsum(size) - size
    for w in range(len(size)):
        c = code[start[w] : start[w] + size[w]]
        for a, b in OFFSETS:
            if size[w] > b:
                np.add.at(out[w], (c[:-b] * LETTERS + c[a : a - b or None][: size[w] - b]) * LETTERS + c[b:], DECAY ** (b + 1))
    return out / np.sqrt(np.maximum(own_weight(size), 1e-9))[:, None]


@dataclass
class Machine:
    table: np.ndarray  # a weight per subsequence
    bias: float
    calibration: tuple[float, float, float]

    def words(self, code: np.ndarray, size: np.ndarray) -> np.ndarray:
        own = own_weight(size)
        return np.where(own > 0, word_sums(code, size, self.table) / np.sqrt(np.maximum(own, 1e-9)) + self.bias, -2.0)

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        """[text, 2]: the highest word score, and the sum of those over zero (up to 3)."""
        out = np.tile([-2.0, 0.0], (len(texts), 1))
        x = Letters(texts)
        if len(x.size):
            _, which, back = np.unique(x.hashes(), return_index=True, return_inverse=True)
            score = np.clip(self.words(*x.take(which)), -2, 2)[back]
            np.maximum.at(out[:, 0], x.doc, score)
            out[:, 1] = np.minimum(3, np.bincount(x.doc, weights=np.maximum(score, 0), minlength=len(texts)))
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        a, b, c = self.calibration
        e = self.evidence(texts)
        return 1 / (1 + np.exp(-np.clip(a * e[:, 0] + b * e[:, 1] + c, -30, 30)))


def _slices(texts: list[bytes], most: int = 6 << 20) -> Iterator[tuple[int, list[bytes]]]:
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield lo, texts[lo:i]
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, texts[lo:]


def _sentence_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: each distinct word (letter codes) with its numbers of toxic and clean sentences."""
    held: dict[bytes, list[int]] = {}
    for b in batches:
        labels = b.column(0).to_pylist()
        for label, text in zip(labels, bytes_of(b.column(1)), strict=True):
            sentences = [s for s in _SENTENCE.split(text) if s]
            if not sentences:
                continue
            x = Letters(sentences)
            codes = x.code.astype(np.uint8).tobytes()
            seen = {(d, codes[s : s + n]) for d, s, n in zip(x.doc.tolist(), x.start.tolist(), x.size.tolist(), strict=True) if n >= 4}
            for _, w in seen:
                held.setdefault(w, [0, 0])[label == 0] += 1
    words, counts = list(held), list(held.values())
    yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int64())], names=["word", "toxic", "clean"])


def _squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 30) -> np.ndarray:
    """Newton steps for a linear machine with squared hinge loss; the last column of x is the bias."""
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], ridge)
    reg[-1] = 1e-6
    for _ in range(rounds):
        margin = y * (x @ w)
        active = margin < 1
        xa, wa = x[active], weight[active]
        h = (xa * wa[:, None]).T @ xa + np.diag(reg)
        new = np.linalg.solve(h, (xa * wa[:, None]).T @ y[active])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


def _words(pairs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(pairs), np.uint8).astype(np.int32), np.array([len(p) for p in pairs], np.int64)


def train_words(positive: list[bytes], negative: list[bytes], weight: np.ndarray, landmarks: int, ridge: float) -> tuple[np.ndarray, float]:
    """The folded machine of labelled words: a weight per subsequence, and a bias."""
    spread = lambda words, n: words[:: max(1, -(-len(words) // max(1, n)))][:n]
    marks = positive[: landmarks // 4]
    marks += spread(positive[landmarks // 4 :], landmarks // 4)
    marks += spread(negative, landmarks - len(marks))
    z = expand(*_words(marks))
    used = np.flatnonzero(z.any(axis=0))
    z = z[:, used]
    values, vectors = np.linalg.eigh((z @ z.T).astype(float))
    good = values > 1e-4 * values.max()
    to_map = vectors[:, good] / np.sqrt(values[good])
    words = positive + negative
    k = np.concatenate([expand(*_words(words[i : i + 500]))[:, used] @ z.T for i in range(0, len(words), 500)]).astype(float)
    x = np.concatenate((k @ to_map, np.ones((len(words), 1))), axis=1)
    y = np.concatenate((np.ones(len(positive)), -np.ones(len(negative))))
    w = _squared_hinge(x, y, weight, ridge)
    table = np.zeros(LETTERS**3, np.float32)
    table[used] = z.T.astype(float) @ (to_map @ w[:-1])
    return table, float(w[-1])


def _logistic(e: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float, float]:
    x = np.concatenate((e, np.ones((len(e), 1))), axis=1)
    w = np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-2, 1e-4])
        w = w - np.linalg.solve(h, x.T @ (p - y) + np.array([1e-2, 1e-2, 1e-4]) * w)
    return tuple(float(v) for v in w)


def _evidence(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine(*shared.value)
        for b in batches:
            for lo, texts in _slices(bytes_of(b.column(1))):
                e = m.evidence(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(texts)), pa.array(e[:, 0]), pa.array(e[:, 1])], names=["label", "high", "total"])

    return run


def _scorer(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value and Machine(*shared.value)
        for b in batches:
            for lo, texts in _slices(bytes_of(b.column(1))):
                s = m.score(texts) if m else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(texts)), pa.array(s.astype(float))], names=["doc_id", "score"])

    return run


def _runs(word: bytes) -> set[bytes]:
    return {word[i : i + RUN] for i in range(max(1, len(word) - RUN + 1))}


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, list[int]] = {}
    for b in batches:
        for w, t, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
            for r in _runs(w):
                x = held.setdefault(r, [0, 0])
                x[0] += t
                x[1] += c
    counts = list(held.values())
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int64())], names=["run", "toxic", "clean"])


def _pick_words(shared) -> Callable:
    """Adds to each word the best odds of its runs of letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = shared.value
        for b in batches:
            best = [max((odds.get(r, 0.0) for r in _runs(w)), default=0.0) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best, pa.float64())], names=["word", "toxic", "clean", "run_odds"])

    return run


def _vote(shared) -> Callable:
    """Each sentence of a toxic text votes for its word of most evidence, if it has a candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence, votes = shared.value, {}
        for b in batches:
            for text in bytes_of(b.column(0)):
                sentences = [s for s in _SENTENCE.split(text) if s]
                x = Letters(sentences)
                codes = x.code.astype(np.uint8).tobytes()
                best: dict[int, tuple[float, bytes]] = {}
                for d, s, n in zip(x.doc.tolist(), x.start.tolist(), x.size.tolist(), strict=True):
                    w = codes[s : s + n]
                    if w in evidence and (evidence[w], w) > best.get(d, (0.0, b"")):
                        best[d] = evidence[w], w
                for _, w in best.values():
                    votes[w] = votes.get(w, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(votes), pa.binary()), pa.array(list(votes.values()), pa.int64())], names=["word", "votes"])

    return run


def _score_words(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine(*shared.value)
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(m.words(*_words(b.column(0).to_pylist())).astype(float))], names=[*b.schema.names, "machine"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int = 20_000, positives: int = 1500, negatives: int = 3000, landmarks: int = 256, ridge: float = 0.3, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text") -> Machine | None:
    """Learn from (id, label) rows; the sampled labels (at most about max_rows) are broadcast to the texts.

    The driver gets top lists of fixed length and two numbers per training text.
    """
    spark = docs.sparkSession
    marked = labels.select(labels[id_col].alias("label_id"), labels[label_col].cast("int").alias("label")).where("label IN (0, 1) AND label_id IS NOT NULL")
    picked = bounded_sample(marked, F.col("label_id"), marked.count(), max_rows)
    names = docs.select(docs[id_col].alias("own_id"), docs[text_col].cast("binary").alias("own_text"))
    both = names.join(F.broadcast(picked), names["own_id"] == picked["label_id"]).select("label", "own_text")
    sums = both.mapInArrow(_sentence_words, "word binary, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    sums = materialize(sums)
    total = sums.agg(F.sum("toxic"), F.sum("clean")).first()
    if not total[0] or not total[1]:
        return None
    ratio = F.log((F.col("toxic") + 0.2) / (F.col("clean") + 0.2) * F.lit(total[1] / total[0]))
    runs = sums.mapInArrow(_count_runs, "run binary, toxic long, clean long").groupBy("run").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    runs = runs.select("run", "toxic", ratio.alias("odds")).where("toxic >= 8 AND odds > 3").orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "run").limit(20_000)
    odds = spark.sparkContext.broadcast({bytes(r["run"]): r["odds"] for r in runs.collect()})
    sums = sums.mapInArrow(_pick_words(odds), "word binary, toxic long, clean long, run_odds double")
    odd = sums.select("word", "toxic", ((ratio + F.col("run_odds")) * F.sqrt("toxic")).alias("odds"), ratio.alias("ratio"), "run_odds", "clean")
    candidates = odd.where("clean * 20 <= toxic AND (run_odds > 3 AND ratio > 1 OR toxic >= 5 AND ratio > 3)").orderBy(F.desc("odds"), "word").limit(positives * 4).collect()
    evidence = spark.sparkContext.broadcast({bytes(r["word"]): r["odds"] for r in candidates})
    votes = both.where("label = 1").select("own_text").mapInArrow(_vote(evidence), "word binary, votes long").groupBy("word").agg(F.sum("votes").alias("votes"))
    high = votes.where("votes >= 2").orderBy(F.desc("votes"), "word").limit(positives).collect()
    clean = sums.where("clean > 0 AND clean * 4 > toxic").select("word", "clean")
    low = clean.orderBy(F.xxhash64("word"), "word").limit(negatives // 2).collect() + clean.orderBy(F.desc("clean"), "word").limit(negatives // 2).collect()
    if not high or not low:
        return None
    positive = [bytes(r["word"]) for r in high]
    negative = list(dict.fromkeys(bytes(r["word"]) for r in low))
    strength = np.minimum(300.0, [r["votes"] for r in high])
    for _ in range(rounds):
        weight = np.concatenate((strength * len(negative) / strength.sum() / 2, np.ones(len(negative))))
        table, bias = train_words(positive, negative, weight, landmarks, ridge)
        shared = spark.sparkContext.broadcast((table, bias, (0.0, 0.0, 0.0)))
        hard = clean.mapInArrow(_score_words(shared), "word binary, clean long, machine double").where("machine > -0.5")
        negative = list(dict.fromkeys([*(bytes(r["word"]) for r in hard.orderBy(F.desc("machine"), "word").limit(negatives // 3).collect()), *negative]))
    t = both.mapInArrow(_evidence(shared), "label int, high double, total double").toArrow()
    e = np.stack((t["high"].to_numpy(), t["total"].to_numpy()), axis=1)
    return Machine(table, bias, _logistic(e, t["label"].to_numpy().astype(float)))


def score(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine and (machine.table, machine.bias, machine.calibration))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("binary").alias("text"))
    return rows.mapInArrow(_scorer(shared), "doc_id long, score double")
