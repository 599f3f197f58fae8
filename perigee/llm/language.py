"""Language identification: script ranges narrow the candidates, Viterbi labels the spans.

A word's score for a language is the log-likelihood of its byte trigrams (blank-padded, lower case) under
counts learned from labelled texts. Languages that don't write a word's script are no candidates for it. The
best labelling of a text's words under a penalty per switch gives its spans; the language with most bytes in
spans is predicted, and the score is its share of the bytes times its posterior within its spans.

Fitting uses a documented bounded sample: about `max_rows_per_lang` rows of each language, picked by a hash
of the id. Every text is labelled whole.

Defined results: a text that is null or has no letter is `und` with score 0, and so is every text when
nothing was learned; words without letters favour no language; ties go to the language first in
alphabetical order; repeated rows get equal results; an empty table gives an empty result; other columns
are never read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigee.llm.shared import bytes_of, filter_rows, only_one

BUCKETS = 1 << 16
SMOOTHING = 0.5
#: Ranges of code points of scripts.
SCRIPTS = [
    ("latin", 0x0041, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x1F00, 0x1FFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
]
NAMES = sorted({s for s, _, _ in SCRIPTS})
#: A language writes a script if at least this share of its letters is of it.
SCRIPT_SHARE = 0.01
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_WIDE = re.compile(rb"[\xcd-\xf4]")
NEVER = -1e4


def script_of(ch: str) -> str | None:
    """The script of a letter; None for other characters and scripts without a range."""
    c = ord(ch)
    return next((s for s, lo, hi in SCRIPTS if lo <= c <= hi), None) if ch.isalpha() else None


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace")))


@dataclass(frozen=True)
class Model:
    langs: list[str]
    weights: np.ndarray  # [language, bucket], the first bucket zero
    scripts: dict[str, frozenset[int]]  # script -> languages that write it
    penalty: float


class Words:
    """The words of some texts, with the trigram bucket of each byte."""

    def __init__(self, texts: list[bytes]):
        low = [t.lower() if t.isascii() else t.decode("utf-8", "replace").lower().encode() for t in texts]
        self.raw = b" " + b" ".join(low) + b" "
        lens = np.fromiter((len(t) + 1 for t in low), np.int64, len(low))
        self.text_end = np.cumsum(lens)  # of the blank before a text to its last byte
        a = np.frombuffer(self.raw, np.uint8)
        blank = (a == 32) | ((a >= 9) & (a <= 13))
        edge = np.flatnonzero(np.diff(blank)) + 1
        self.start, self.end = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(self.text_end, self.start - 1, side="right")
        x = np.where(blank, np.uint8(32), a).astype(np.uint32)
        code = x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)
        bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(16)
        bucket[blank[1:-1]] = 0  # centred on a blank: of no word
        self.bucket = np.concatenate((bucket, np.zeros(2, np.uint32)))  # at i: bytes i to i + 2
        letters = ((a >= 97) & (a <= 122)) | (a >= 128)
        self.letters = np.add.reduceat(letters, self.start, dtype=np.int64) if len(self.start) else np.zeros(0, np.int64)
        if len(self.start):
            gap = np.add.reduceat(letters[: self.end[-1]], self.start, dtype=np.int64)
            self.letters = gap

    def scores(self, m: Model) -> np.ndarray:
        """[word, language] log-likelihoods; never for languages that don't write the word's script."""
        n = len(self.start)
        out = np.zeros((n, len(m.langs)))
        if not n:
            return out
        for i, w in enumerate(m.weights):
            out[:, i] = np.add.reduceat(w[self.bucket], self.start - 1)
        out[self.letters == 0] = 0
        latin = m.scripts.get("latin", frozenset())
        if 0 < len(latin) < len(m.langs):
            out[np.ix_(self.letters > 0, [i for i in range(len(m.langs)) if i not in latin])] += NEVER
        if _WIDE.search(self.raw):
            wide = np.flatnonzero(np.add.reduceat(np.frombuffer(self.raw, np.uint8) >= 0xCD, self.start, dtype=np.int64))
            for k in wide:
                word = self.raw[self.start[k] : self.end[k]].decode("utf-8", "replace")
                used = {s for s in map(script_of, word) if s}
                able = set().union(*(m.scripts.get(s, ()) for s in used - {"latin"} or used))
                if 0 < len(latin) < len(m.langs):
                    out[k, [i for i in range(len(m.langs)) if i not in latin]] -= NEVER
                if able and len(able) < len(m.langs):
                    out[k, [i for i in range(len(m.langs)) if i not in able]] += NEVER
        return out


def _path(s: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """Viterbi over several texts at once; s is [word, language], sizes the words of each text (over 0)."""
    first = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    longest, n_lang = int(sizes.max()), s.shape[1]
    alive = np.searchsorted(-sizes[order], -np.arange(longest), side="left")  # texts with more than t words
    came = np.zeros(s.shape, np.int8 if n_lang < 128 else np.int32)
    v = s[first[order]].copy()
    keep = np.arange(n_lang)
    for t in range(1, longest):
        k = alive[t]
        x, at = v[:k], first[order[:k]] + t
        best = x.argmax(axis=1)
        jump = x[np.arange(k), best] - penalty
        go = jump[:, None] > x
        came[at] = np.where(go, best[:, None], keep)
        v[:k] = np.where(go, jump[:, None], x) + s[at]
    out = np.zeros(len(s), np.int64)
    now = v.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        k = alive[t]
        at = first[order[:k]] + t
        out[at] = now[:k]
        if t:
            now[:k] = came[at, now[:k]]
    return out


def label_words(s: np.ndarray, doc: np.ndarray, n: int, penalty: float) -> np.ndarray:
    """The best language of each word under a penalty per switch.

    A text whose best single language is beaten on no stretch of words by more than half the penalty keeps
    it throughout (a switch can't pay); only the other texts need the dynamic programme.
    """
    if not len(s):
        return np.zeros(0, np.int64)
    sizes = np.bincount(doc, minlength=n)
    has = np.flatnonzero(sizes)
    first = (np.cumsum(sizes) - sizes)[has]
    total = np.add.reduceat(s, first, axis=0)
    best = total.argmax(axis=1)
    row = np.repeat(np.arange(len(has)), sizes[has])
    out = best[row]
    gain = s - s[np.arange(len(s)), out][:, None]
    big = 1 + np.abs(gain).sum(axis=0).max()
    hard = np.zeros(len(has), bool)
    for i in range(s.shape[1]):
        run = np.cumsum(gain[:, i])
        before = run - gain[:, i] - row * big  # falls by more than it can rise from text to text
        hard |= np.maximum.reduceat(run - row * big - np.minimum.accumulate(before), first) > penalty / 2
    if hard.any():
        words = hard[row]
        out[words] = _path(s[words], sizes[has][hard], penalty)
    return out


def _labeller(shared, with_spans: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_one("nothing")
        m = shared.value
        for b in batches:
            for lo, texts in _slices(bytes_of(b.column(1))):
                lang, score, spans = predict(texts, m, with_spans)
                kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(texts)), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, kinds)], names=["doc_id", "lang_pred", "score", "spans"])

    return run


def _slices(texts: list[bytes], most: int = 3 << 20) -> Iterator[tuple[int, list[bytes]]]:
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield lo, texts[lo:i]
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, texts[lo:]


def predict(texts: list[bytes], m: Model, with_spans: bool = False) -> tuple[list[str], list[float], list]:
    """Language, score and spans (in words) of each text."""
    return predict_sure(texts, m, with_spans)[:3]


def predict_sure(texts: list[bytes], m: Model, with_spans: bool = False) -> tuple[list[str], list[float], list, list[float]]:
    """predict, and how sure the language of each text's main part is, whatever its share of the text."""
    n = len(texts)
    lang, score, spans = ["und"] * n, [0.0] * n, [[] for _ in range(n)]
    if not m.langs or not n:
        return lang, score, spans, [0.0] * n
    w = Words(texts)
    s = w.scores(m)
    at = label_words(s, w.doc, n, m.penalty)
    n_lang = len(m.langs)
    key = w.doc * n_lang + at
    weight = np.bincount(key, weights=w.letters, minlength=n * n_lang).reshape(n, n_lang)
    best = weight.argmax(axis=1)
    own = at == best[w.doc]
    inside = np.zeros((n, n_lang))
    np.add.at(inside, w.doc[own], s[own])
    inside -= inside.max(axis=1, keepdims=True)
    share = np.exp(inside)
    sure = share[np.arange(n), best] / share.sum(axis=1)
    with np.errstate(invalid="ignore"):
        part = weight[np.arange(n), best] / weight.sum(axis=1)
    for i, t in enumerate(texts):
        if has_letter(t):
            lang[i], score[i] = m.langs[best[i]], float(min(1.0, max(0.0, np.nan_to_num(part[i]) * sure[i])))
    if with_spans and len(at):
        turn = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (w.doc[1:] != w.doc[:-1]))))
        stop = np.append(turn[1:], len(at))
        first = np.searchsorted(w.doc, np.arange(n))
        for x, y in zip(turn.tolist(), stop.tolist(), strict=True):
            d = int(w.doc[x])
            if lang[d] != "und":
                spans[d].append({"start": x - int(first[d]), "end": y - int(first[d]), "lang": m.langs[at[x]]})
    return lang, score, spans, np.nan_to_num(sure).tolist()


def _counter(langs: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_one("nothing")
        grams, scripts = np.zeros((len(langs), BUCKETS), np.int64), np.zeros((len(langs), len(NAMES)), np.int64)
        for b in batches:
            which = np.array([langs.index(x) for x in b.column(0).to_pylist()], np.int64)
            for lo, texts in _slices(bytes_of(b.column(1))):
                w = Words(texts)
                of = np.repeat(which[lo : lo + len(texts)], np.diff(np.concatenate(([0], w.text_end))))
                at = of * BUCKETS + w.bucket[: len(of)]
                grams += np.bincount(at, minlength=grams.size).reshape(grams.shape)
                for i, t in zip(which[lo : lo + len(texts)], texts, strict=True):
                    scripts[i, NAMES.index("latin")] += sum(map(t.count, (b"e", b"a", b"i"))) * 4
                    if _WIDE.search(t):
                        for s in map(script_of, t.decode("utf-8", "replace")):
                            if s and s != "latin":
                                scripts[i, NAMES.index(s)] += 1
        grams[:, 0] = 0
        both = np.concatenate((grams, scripts), axis=1)
        at = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(both[at])], names=["lang", "feature", "n"])

    return run


def fit(labelled: DataFrame, max_rows_per_lang: int = 4000, penalty: float = 16.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the rows whose language isn't null.

    The driver gets the number of rows of each language and then, at most, one count per language and
    bucket.
    """
    rows = labelled.select(labelled[id_col].alias("id"), labelled[lang_col].alias("lang"), labelled[text_col].cast("binary").alias("text")).where("lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, BUCKETS), np.float32), {}, penalty)
    cut = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, max_rows_per_lang / sizes[lang]))])
    share = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = rows.where(share < F.element_at(cut, F.col("lang"))).select("lang", "text")
    sums = picked.mapInArrow(_counter(langs), "lang int, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(langs), BUCKETS + len(NAMES)))
    t = sums.toArrow()
    counts[t["lang"].to_numpy(), t["feature"].to_numpy()] = t["n"].to_numpy()
    grams, scripts = counts[:, :BUCKETS], counts[:, BUCKETS:]
    weights = np.log(grams + SMOOTHING) - np.log(grams.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    weights[:, 0] = 0
    share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
    able = {s: frozenset(np.flatnonzero(share[:, i] >= SCRIPT_SHARE).tolist()) for i, s in enumerate(NAMES)}
    return Model(langs, weights.astype(np.float32), able, penalty)


def identify(docs: DataFrame, model: Model, with_spans: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, spans) of each row; spans are word ranges, left empty unless asked for."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("binary").alias("text"))
    return rows.mapInArrow(_labeller(shared, with_spans), "doc_id long, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>")


def keep_identified(docs: DataFrame, model: Model, least_score: float = 0.5, langs: Column | None = None, text_col: str = "text") -> DataFrame:
    """The rows with letters whose main language is as sure as the given score at least, with all their columns.

    Its share of the letters doesn't count, so a mixture of languages alone is no reason to drop a text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(texts: list[bytes]) -> list[bool]:
        out = []
        for _, part in _slices(texts):
            lang, _, _, sure = predict_sure(part, shared.value)
            out += [x != "und" and s >= least_score for x, s in zip(lang, sure, strict=True)]
        return out

    return filter_rows(docs, text_col, keep)
