"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's active features are its hashed words (weights log(1 + count), scaled to unit length together), one
bin of each structure statistic and one bin of its metadata. The machine's score is a bias, a weight per
feature and the inner products of low-rank factors over all pairs of features, summed in linear time:
the pairs' sum is half of (the square of the summed factors less the sum of squared factors).

Fitting uses a documented bounded sample: about `max_rows` labelled rows, picked by a hash of the id.
Every text is scored whole.

Defined results: null text counts as empty and still gets a score; null metadata has a bin of its own;
labels other than 0 and 1 are left out; with no labelled row every score is one half; repeated rows get
equal scores; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.llm.shared import WordBatch, bounded_sample, bytes_of

WORD_BITS = 14
RANK = 8
BINS = 16
#: Structure statistics, in the order of _statistics(); each has BINS bins.
STATISTICS = ("words", "word_length", "distinct", "repeats", "symbols", "symbol_words", "upper", "upper_words", "lone_symbols", "digits", "lines", "line_words", "repeats_n", "symbol_words_n", "upper_words_n", "lone_symbols_n")


def _log_bin(x: np.ndarray) -> np.ndarray:
    return np.minimum(BINS - 1, np.ceil(np.log2(1 + np.maximum(x, 0)))).astype(np.int64)


def _share_bin(x: np.ndarray) -> np.ndarray:
    """Finer near zero: bin 0 is exactly none, then steps of the square root."""
    return np.where(x <= 0, 0, 1 + np.minimum(BINS - 2, np.floor(np.sqrt(np.clip(x, 0, 1)) * (BINS - 1)))).astype(np.int64)


def _statistics(w: WordBatch, h: np.ndarray, original: bytes, distinct: np.ndarray) -> np.ndarray:
    """[text, statistic] bins."""
    n = w.n
    a = np.frombuffer(original, np.uint8)
    size = np.maximum(1, w.text_end - w.text_start - 1)
    per_text = lambda mask: np.add.reduceat(mask, w.text_start, dtype=np.int64) if n else np.zeros(0, np.int64)
    upper, digit = (a >= 65) & (a <= 90), (a >= 48) & (a <= 57)
    symbol = (a > 32) & (a < 127) & ~upper & ~digit & ~((a >= 97) & (a <= 122)) & ~np.isin(a, np.frombuffer(b".,;:'-", np.uint8))
    words = np.maximum(1, w.n_words)
    if len(w.start):
        edges = np.stack((w.start, w.end), 1).reshape(-1)
        in_word = lambda mask: np.add.reduceat(np.append(mask, False), edges, dtype=np.int64)[::2]
        length = w.end - w.start
        symbols, uppers = in_word(symbol), in_word(upper)
        again = np.concatenate(([False], (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])))
        of = lambda mask: np.bincount(w.doc[mask], minlength=n)
        repeats, symbol_words = of(again), of((symbols >= 2) | (symbols * 2 >= length))
        upper_words, lone = of((uppers >= 2) & (uppers * 2 >= length)), of(symbols == length)
        letters = np.bincount(w.doc, weights=length, minlength=n)
    else:
        repeats = symbol_words = upper_words = lone = np.zeros(n, np.int64)
        letters = np.zeros(n)
    lines = per_text(a == 10)
    return np.stack(
        (
            _log_bin(w.n_words), _log_bin(letters / words * 4), _share_bin(distinct / words), _share_bin(repeats / words), _share_bin(per_text(symbol) / size), _share_bin(symbol_words / words),
            _share_bin(per_text(upper) / size), _share_bin(upper_words / words), _share_bin(lone / words), _share_bin(per_text(digit) / size), _log_bin(lines), _log_bin(w.n_words / (lines + 1)),
            _log_bin(repeats), _log_bin(symbol_words), _log_bin(upper_words), _log_bin(lone),
        ),
        axis=1,
    )


def n_features(n_meta: int) -> int:
    return (1 << WORD_BITS) + (len(STATISTICS) + n_meta) * BINS


def features(texts: list[bytes], meta: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, weight) of every active feature, sorted by text; meta are columns with nan for null."""
    w = WordBatch(texts)
    h = w.hashes() if len(w.start) else np.zeros(0, np.uint64)
    key, count = np.unique((w.doc << WORD_BITS) | (h >> np.uint64(64 - WORD_BITS)).astype(np.int64), return_counts=True)
    doc = key >> WORD_BITS
    x = np.log1p(count)
    norm = np.sqrt(np.bincount(doc, weights=x * x, minlength=w.n))
    bins = _statistics(w, h, b" ".join(texts) + b" " if texts else b"", np.bincount(doc, minlength=w.n))
    for m in meta:
        bins = np.concatenate((bins, np.where(np.isnan(m), 0, np.minimum(BINS - 1, 1 + _log_bin(np.nan_to_num(m)))).astype(np.int64)[:, None]), axis=1)
    dense = (1 << WORD_BITS) + np.arange(bins.shape[1]) * BINS + bins
    rows = np.concatenate((doc, np.repeat(np.arange(w.n), bins.shape[1])))
    cols = np.concatenate((key & (1 << WORD_BITS) - 1, dense.reshape(-1)))
    vals = np.concatenate((x / norm[doc], np.full(dense.size, 1 / np.sqrt(bins.shape[1]))))
    order = np.argsort(rows, kind="stable")
    return rows[order], cols[order], vals[order].astype(np.float32)


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, n: int) -> np.ndarray:
        """Scores before the logistic function; every text has features, so no segment is empty."""
        if not n:
            return np.zeros(0)
        first = np.searchsorted(rows, np.arange(n))
        vx = self.v[cols] * vals[:, None]
        s = np.add.reduceat(vx, first, axis=0)
        return self.bias + np.add.reduceat(self.w[cols] * vals, first) + 0.5 * ((s * s).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), first))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_feat: int, epochs: int = 12, rate: float = 0.1, decay: float = 1e-4, batch: int = 128, seed: int = 7) -> Machine:
    """Adagrad on the logistic loss; rows are (features, weights) of each labelled text."""
    rng = np.random.default_rng(seed)
    p = (labels.sum() + 1) / (len(labels) + 2)
    m = Machine(float(np.log(p / (1 - p))), np.zeros(n_feat, np.float32), rng.normal(0, 0.05, (n_feat, RANK)).astype(np.float32))
    gw, gv, gb = np.full(n_feat, 1e-6, np.float32), np.full((n_feat, RANK), 1e-6, np.float32), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            size = np.array([len(rows[i][0]) for i in pick])
            cols = np.concatenate([rows[i][0] for i in pick])
            vals = np.concatenate([rows[i][1] for i in pick])
            of = np.repeat(np.arange(len(pick)), size)
            first = np.cumsum(size) - size
            vx = m.v[cols] * vals[:, None]
            s = np.add.reduceat(vx, first, axis=0)
            raw = m.bias + np.add.reduceat(m.w[cols] * vals, first) + 0.5 * ((s * s).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), first))
            err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[pick]).astype(np.float32) / len(pick)
            hit, at = np.unique(cols, return_inverse=True)
            ev = err[of] * vals
            dw = np.bincount(at, weights=ev) + decay * m.w[hit]
            dv = np.stack([np.bincount(at, weights=ev * (s[of, k] - vx[:, k])) for k in range(RANK)], axis=1) + decay * m.v[hit]
            gw[hit] += dw * dw
            gv[hit] += dv * dv
            m.w[hit] -= rate * dw / np.sqrt(gw[hit])
            m.v[hit] -= rate * 0.5 * dv / np.sqrt(gv[hit])
            gb += float(err.sum()) ** 2
            m.bias -= rate * float(err.sum()) / gb**0.5
    return m


def _slices(b: pa.RecordBatch, first_meta: int, most: int = 4 << 20) -> Iterator[tuple[int, list[bytes], list[np.ndarray]]]:
    texts = bytes_of(b.column(1))
    meta = [b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(first_meta, b.num_columns)]
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield lo, texts[lo:i], [m[lo:i] for m in meta]
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, texts[lo:], [m[lo:] for m in meta]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, texts, meta in _slices(b, 2):
            rows, cols, vals = features(texts, meta)
            cut = np.searchsorted(rows, np.arange(1, len(texts)))
            parts = zip(np.split(cols.astype("<i4"), cut), np.split(vals, cut), strict=True)
            c, v = zip(*((x.tobytes(), y.tobytes()) for x, y in parts), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(texts)), pa.array(c, pa.binary()), pa.array(v, pa.binary())], names=["label", "cols", "vals"])


def _scorer(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for lo, texts, meta in _slices(b, 2):
                raw = np.zeros(len(texts)) if m is None else m.raw(*features(texts, meta), len(texts))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(texts)), pa.array(1 / (1 + np.exp(-np.clip(raw, -30, 30).astype(float))))], names=["doc_id", "score"])

    return run


def _columns(docs: DataFrame, first, text_col: str, metadata: tuple[str, ...]):
    return docs.select(first, docs[text_col].cast("binary").alias("text"), *[docs[c].cast("double").alias(f"meta{i}") for i, c in enumerate(metadata)])


def fit(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int = 12_000, metadata: tuple[str, ...] = ("n_chars",), id_col: str = "doc_id", text_col: str = "text") -> Machine | None:
    """Learn from (id, label) rows. The sampled labels (at most about max_rows) are broadcast to the texts,
    and the driver gets those texts' features."""
    marked = labels.select(labels[id_col].alias("label_id"), labels[label_col].alias("label")).where("label IN (0, 1) AND label_id IS NOT NULL")
    picked = bounded_sample(marked, F.col("label_id"), marked.count(), max_rows)
    names = docs.select(docs[id_col].alias("own_id"), docs[text_col].cast("binary").alias("own_text"), *[docs[c].cast("double").alias(f"meta{i}") for i, c in enumerate(metadata)])
    both = names.join(F.broadcast(picked), names["own_id"] == picked["label_id"]).select("label", "own_text", *[f"meta{i}" for i in range(len(metadata))])
    t = both.mapInArrow(_extract, "label int, cols binary, vals binary").toArrow()
    if not t.num_rows:
        return None
    rows = [(np.frombuffer(c, "<i4"), np.frombuffer(v, "<f4")) for c, v in zip(t["cols"].to_pylist(), t["vals"].to_pylist(), strict=True)]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0].tobytes(), rows[i][1].tobytes()))  # not as the tasks came
    return train([rows[i] for i in order], t["label"].to_numpy()[order].astype(float), n_features(len(metadata)))


def score(docs: DataFrame, machine: Machine | None, metadata: tuple[str, ...] = ("n_chars",), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    return _columns(docs, docs[id_col].cast("long").alias("doc_id"), text_col, metadata).mapInArrow(_scorer(shared), "doc_id long, score double")
