"""Language-model scoring with a log-frequency Bloom filter.

A quantised count q of a bigram (1 for a count of one, one more for each factor of BASE) is held by the membership of
(bigram, 1) to (bigram, q). To read it, memberships are probed one level after another until one is missing; so a
count is never under the quantised one, and over it with the filter's error rate per level. Bigrams are learned whole
from all training texts: each task counts its own, blocks of them meet by their keys' leading bits, and each range of
keys fills a segment of the filter that is as large as its own entries ask for, so the error rate is the same at every
size of the input.

p(w | v) = (1 - b) * m(v w) / (M(v) + F) + b * p(w), where p(w) adds one to exact unigram counts (and keeps one share
for any unknown token); m is the dequantised count of the bigram less DISCOUNT, 0 where it isn't a member; M(v) is the
sum of m over the bigrams that were learned after v; F is what non-members that the filter takes for members add in
expectation; 1 - b = M(v) / (count(v) + F). So the probabilities after each v sum to one in expectation over the
filter's errors, and nothing has to be tuned. Bigrams whose second token is rare (see FREQUENT_SHARE) weigh less, so
that the many rare tokens don't make most of F. M(v) is a number of three memberships in the filter (two digits and
their check) to some 4 %; exact for contexts whose bigrams are spread over several segments because they are many.

Unigram counts of the tokens that make up a fixed share of all tokens (so their number is bounded) are broadcast as a
table; other tokens are joined with their exact counts.

The filter is broadcast in shards of at most `max_shard_bytes`: one shard up to that size, and beyond it one after
another, each in a pass of its own over the texts that scores the bigrams whose context it holds. A score doesn't
depend on the number of shards. Workers map a shard from the file that Spark puts on their machine (see Sent), so those
of an executor share its pages; the next call takes what earlier ones have sent from the executors.

Defined results: null text is empty, and an empty text is the end token alone; tokens are the words between ASCII white
space, A-Z lowered, then one end; without training texts every count is zero; repeated rows get equal scores; an empty
table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import math
import mmap
import os
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigee.llm.shared import LOWER, WordBatch, bytes_of, mix, written

#: The end of a text; no word holds a blank.
END = b" "
BASE = 1.5
PROBES = 6
BITS_PER_ENTRY = 12
DISCOUNT = 0.75
#: Tokens of at least this share of all tokens are in the broadcast table: 2,000,000 at most.
FREQUENT_SHARE = 5e-7
#: Contexts of more than this share of all tokens at most are spread over segments.
HOT_SHARE = 1 / 65536
#: M(v) is held on a logarithmic scale, in two digits of DIGIT values.
DIGIT = 16
_HASH_SEED = np.uint64(0x2545F4914F6CDD1D)
#: Stands for the context of a text's first token.
START = np.uint64(0x1F83D9ABFB41BD6B)


def tokens(text: bytes) -> list[bytes]:
    return [*text.translate(LOWER).split(), END]


class Stream:
    """Tokens of many texts, one after another, with a 64-bit hash of each."""

    def __init__(self, texts: list[bytes]):
        w = self.words = WordBatch(texts)
        self.n_tokens = w.n_words + 1
        self.last = np.cumsum(self.n_tokens) - 1  # where the ends are
        total = int(self.n_tokens.sum())
        self.end = np.zeros(total, bool)
        self.end[self.last] = True
        self.hash = np.full(total, _HASH_SEED, np.uint64)
        if len(w.start):
            self.hash[~self.end] = w.hashes()
        self.doc = np.repeat(np.arange(len(texts)), self.n_tokens)

    def before(self, of: np.ndarray, start) -> np.ndarray:
        """What the token before each one has, given what each one has; `start` at a text's beginning."""
        if not len(of):
            return of
        out = np.concatenate((of[:1], of[:-1]))
        out[np.concatenate(([True], self.end[:-1]))] = start
        return out


def token_hashes(words: list[bytes]) -> np.ndarray:
    """The hash of each token, as Stream has it."""
    out = [np.zeros(0, np.uint64)]
    for i in range(0, len(words), 100_000):
        s = Stream([b"" if w == END else w for w in words[i : i + 100_000]])
        out.append(s.hash[np.where(s.n_tokens == 1, s.last, s.last - 1)])
    return np.concatenate(out)


class Table:
    """Places of hashes, found by probing one place after another. Place `start` stands for START and place `start`
    + 1 for any hash that isn't there, so arrays of start + 2 entries say something about each."""

    def __init__(self, hashes: np.ndarray):
        size = 1 << max(4, (2 * len(hashes)).bit_length())
        self.start, self.keys = size, np.zeros(size, np.uint64)  # zero is an empty place
        self.n = len(hashes)
        left, at = hashes, (hashes & np.uint64(size - 1)).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.keys[at] == 0)
            place, one = np.unique(at[free], return_index=True)
            self.keys[place] = left[free[one]]
            rest = self.keys[at] != left
            left, at = left[rest], (at[rest] + 1) & (size - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.start + 1, np.int64)
        left, at = np.arange(len(h)), (h & np.uint64(self.start - 1)).astype(np.int64)
        while len(left):
            held, mine = self.keys[at], h[left]
            hit = held == mine
            out[left[hit]] = at[hit]
            go = np.flatnonzero(~hit & (held != 0))
            left, at = left[go], (at[go] + 1) & (self.start - 1)
        return out

    def about(self, hashes: np.ndarray, values: np.ndarray, other: float, start: float) -> np.ndarray:
        """An array by place: a value for each of some hashes, for START, and for the others."""
        out = np.full(self.start + 2, other, values.dtype)
        out[self.find(hashes)] = values
        out[self.start], out[self.start + 1] = start, other
        return out


#: Bits of a key under its group; the last marks a frequent second token.
LOW = 28


def keys_of(v: np.ndarray, w: np.ndarray, frequent: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """A key per bigram: the context's group, then a hash of the second token and whether it is frequent. Bigrams of
    a context share a group, or one of as many groups as `parts` says."""
    with np.errstate(over="ignore"):
        own = mix(w * np.uint64(0x9E3779B97F4A7C15) + v)
        part = np.where(parts > 0, own % np.maximum(parts, 1).astype(np.uint64) + np.uint64(1), np.uint64(0))
    low = (own >> np.uint64(64 - LOW)) & np.uint64((1 << LOW) - 2)
    return (group_of(v, part) << np.uint64(LOW)) | low | frequent


def group_of(v: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Of LOW bits less than 64; part 0 is a context that isn't spread, which the last bit tells too."""
    with np.errstate(over="ignore"):
        g = mix(v + part.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(LOW)
    return (g & np.uint64((1 << 36) - 2)) | (part > 0)


def quantise(count: np.ndarray) -> np.ndarray:
    """1 for a count of 1, then one more per factor of BASE."""
    return 1 + np.floor(np.log(count) / math.log(BASE) + 1e-9).astype(np.int64)


def dequantise(q: np.ndarray) -> np.ndarray:
    """The middle (in logarithms) of the counts that a level stands for; 0 stays 0, 1 is 1."""
    return np.where(q <= 1, q, BASE ** (q - 0.5)).astype(float)


def mass(q: np.ndarray) -> np.ndarray:
    """What a level counts for in the model."""
    return np.where(q > 0, dequantise(np.maximum(q, 1)) - DISCOUNT, 0.0)


#: mass(0), mass(1), ...
MASS = mass(np.arange(80))


def false_mass(error: np.ndarray | float) -> np.ndarray:
    """What a bigram that was never learned counts for in expectation."""
    e = np.asarray(error, float)[..., None] ** np.arange(1, 40)
    return (e * np.diff(MASS)[:39]).sum(axis=-1)


def read_mass(error: float) -> np.ndarray:
    """What levels 0, 1, ... of learned bigrams count for as they are read, errors included."""
    step = np.diff(MASS)
    return np.array([MASS[q] + sum(error**j * step[q + j - 1] for j in range(1, 12)) for q in range(60)])


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    """By the leading bits, so a group is in one segment."""
    return ((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def _places(h: np.ndarray, kind: np.ndarray | int, bits: np.ndarray | int) -> Iterator[np.ndarray]:
    """The bits of a segment that an entry sets, one after another."""
    with np.errstate(over="ignore"):
        x, step = _start(h, kind)
        for _ in range(PROBES):
            yield (x % np.asarray(bits, np.uint64)).astype(np.int64)
            x = x + step


def _start(h: np.ndarray, kind: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Where an entry's probes begin and how far they go; both depend on all bits of the key."""
    with np.errstate(over="ignore"):
        x = mix(h)
        return x + np.asarray(kind, np.uint64) * np.uint64(0xA24BAED4963EE407), (x >> np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)


#: Kinds of entries: a bigram's levels from 1 on, then a context's digits and their check.
FIRST_DIGIT = 1 << 20


@dataclass
class Scale:
    """Numbers from `unit` on as whole numbers below DIGIT ** 2."""

    unit: float
    step: float  # in logarithms

    @classmethod
    def to(cls, unit: float, most: float) -> Scale:
        return cls(unit, math.log(max(2.0, most / unit)) / (DIGIT * DIGIT - 1))

    def number(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.round(np.log(np.maximum(x, self.unit) / self.unit) / self.step), 0, DIGIT * DIGIT - 1).astype(np.int64)

    def value(self, number: np.ndarray) -> np.ndarray:
        return self.unit * np.exp(number * self.step)


def fill(h: np.ndarray, q: np.ndarray, contexts: np.ndarray, digits: np.ndarray, bits: int) -> np.ndarray:
    """The bytes of a segment that holds these bigrams and contexts (groups)."""
    bit = np.zeros(bits, bool)
    for level in range(1, int(q.max(initial=0)) + 1):
        for at in _places(h[q >= level], level, bits):
            bit[at] = True
    for kind in (digits // DIGIT, DIGIT + digits % DIGIT, 2 * DIGIT + digits):
        for at in _places(contexts, FIRST_DIGIT + kind, bits):
            bit[at] = True
    return np.packbits(bit, bitorder="little")


@dataclass
class Shard:
    """Segments first, first + 1, ... of a filter of `segments`; each begins at a byte and has its own bits."""

    segments: int
    first: int
    begin: np.ndarray
    bits: np.ndarray
    missed: np.ndarray  # what a bigram that was never learned counts for in expectation
    data: bytes | memoryview
    read: np.ndarray | None = None  # M(v) by place in the table, as far as a worker has read it

    def has(self, seg: np.ndarray) -> np.ndarray:
        return (seg >= self.first) & (seg < self.first + len(self.begin))

    def _members(self, x: np.ndarray, step: np.ndarray, seg: np.ndarray) -> np.ndarray:
        """The indexes of the entries that are there, given where their probes begin and how far they go."""
        left, data = np.arange(len(x)), np.frombuffer(self.data, np.uint8)
        with np.errstate(over="ignore"):
            for _ in range(PROBES):
                at = (x % self.bits[seg]).astype(np.int64)
                hit = np.flatnonzero((data[self.begin[seg] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1)
                left, seg, step = left[hit], seg[hit], step[hit]
                if not len(left):
                    break
                x = x[hit] + step
        return left

    def levels(self, h: np.ndarray, seg: np.ndarray) -> np.ndarray:
        """The highest level up to which a bigram is a member of all levels."""
        q = np.zeros(len(h), np.int64)
        left, level = np.arange(len(h)), 0
        while len(left) and level < 59:
            level += 1
            left = left[self._members(*_start(h[left], level), seg[left])]
            q[left] = level
        return q

    def totals(self, contexts: np.ndarray, seg: np.ndarray, scale: Scale) -> np.ndarray:
        """M(v) of groups; 0 where none is held."""
        found = []
        x, step = _start(contexts, 0)
        of = lambda kind: np.asarray(FIRST_DIGIT + kind, np.uint64) * np.uint64(0xA24BAED4963EE407)
        with np.errstate(over="ignore"):
            for first in (0, DIGIT):
                at = [self._members(x + of(first + d), step, seg) for d in range(DIGIT)]
                found.append((np.concatenate(at), np.repeat(np.arange(DIGIT), [len(i) for i in at])))
            out = np.zeros(len(contexts))
            (a, da), (b, db) = found
            order = np.argsort(b, kind="stable")
            b, db = b[order], db[order]
            lo, hi = np.searchsorted(b, a), np.searchsorted(b, a, side="right")
            n = hi - lo  # each first digit with each second one of its context
            left = np.repeat(np.arange(len(a)), n)
            right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            at, number = a[left], da[left] * DIGIT + db[right]
            good = self._members(x[at] + of(2 * DIGIT + number), step[at], seg[at])
        out[at[good]] = scale.value(number[good])
        return out


#: Stands before a shard's data in its broadcast.
MARK = b"\0perigee shard data\0"


def mapped(sent: Broadcast) -> memoryview:
    """What follows MARK in a broadcast of bytes, in a worker: a map of the broadcast's file, in which pickle leaves
    bytes as they are; a copy where there is no such file (Spark encrypts what it writes)."""
    path = getattr(sent, "_path", None)
    if path and os.path.isfile(path):
        with open(path, "rb") as file:
            m = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        at = m.find(MARK, 0, 4096)
        if at >= 0:
            return memoryview(m)[at + len(MARK) :]
    return memoryview(sent.value)[len(MARK) :]


class Sent:
    """A shard as workers get it, its data as a broadcast of its own that they map."""

    def __init__(self, sc: SparkContext, shard: Shard):
        self.data = sc.broadcast(MARK + shard.data)
        self.about = sc.broadcast(replace(shard, data=b""))

    @property
    def value(self) -> Shard:
        f = self.about.value
        if not f.data:
            f.data = mapped(self.data)
        return f


#: What earlier calls have broadcast, as far as frames still need it (the JVM's weak references).
_sent: list[tuple[SparkContext, object]] = []


def _note(sc: SparkContext, *sent: Broadcast) -> None:
    _sent.extend((sc, sc._jvm.java.lang.ref.WeakReference(b._jbroadcast)) for b in sent)


def _take_back(sc: SparkContext) -> None:
    """Drops the executors' copies of earlier broadcasts; a frame that is read again gets them anew."""
    while _sent:
        of, ref = _sent.pop()
        if of is sc and (old := ref.get()) is not None:
            old.unpersist(False)


def _slices(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield lo, texts[lo:i]
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, texts[lo:]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes with summed counts."""
    h = np.concatenate([p[0] for p in parts])
    c = np.concatenate([p[1] for p in parts])
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(c, first) if len(first) else c


def _count_bigrams(shared, segments: int) -> Callable:
    def blocks(h: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Sorted keys with counts, cut by segment."""
        seg = segment_of(h, segments)  # in order, as the keys are
        cut = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1]))) if len(h) else np.zeros(0, np.int64)
        bound = [*cut.tolist(), len(h)]
        for i in range(0, len(cut), 512):
            spans = list(zip(bound[i : i + 512], bound[i + 1 : i + 513], strict=False))
            hs = pa.array([h[x:y].astype("<u8").tobytes() for x, y in spans], pa.binary())
            cs = pa.array([np.minimum(c[x:y], (1 << 32) - 1).astype("<u4").tobytes() for x, y in spans], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(seg[cut[i : i + 512]], pa.int64()), hs, cs], names=["segment", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, parts = shared.value
        held, size = [], 0
        for b in batches:
            for _, texts in _slices(bytes_of(b.column(0))):
                s = Stream(texts)
                place = table.find(s.hash)
                key = keys_of(s.before(s.hash, START), s.hash, place < table.start, parts[s.before(place, table.start)])
                h, c = np.unique(key, return_counts=True)
                held.append((h, c))
                size += len(h)
                if size > 1_500_000:  # what one task holds doesn't grow with its input
                    yield from blocks(*_merged(held))
                    held, size = [], 0
        if size:
            yield from blocks(*_merged(held))

    return run


def _fill_segments(rare: float, scale: Scale, bits_per_entry: int) -> Callable:
    error = (1 - math.exp(-PROBES / bits_per_entry)) ** PROBES
    value = read_mass(error)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        h = np.frombuffer(b"".join(t["keys"].to_pylist()), "<u8")
        c = np.frombuffer(b"".join(t["counts"].to_pylist()), "<u4").astype(np.int64)
        h, c = _merged([(h, c)])
        q = quantise(c)
        group = h >> np.uint64(LOW)
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        total = np.add.reduceat(value[q] * np.where(h & np.uint64(1), 1.0, rare), first)
        group = group[first]
        spread = (group & np.uint64(1)) == 1
        bits = max(64, int(q.sum() + 3 * (~spread).sum()) * bits_per_entry // 8 * 8)
        data = fill(h, q, group[~spread] << np.uint64(LOW), scale.number(total[~spread]), bits)
        share = float(np.unpackbits(data).mean())
        cols = [[key[0].as_py()], [bits], [share**PROBES], [data.tobytes()], [group[spread].tobytes()], [total[spread].tobytes()]]
        return pa.table({n: pa.array(x, k) for n, x, k in zip(_SEGMENT, cols, (pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()), strict=True)})

    return run


_SEGMENT = ["segment", "bits", "error", "data", "groups", "totals"]


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's tokens; given out whenever many are held."""

    def out(held: Counter) -> Iterator[pa.RecordBatch]:
        words = list(held)
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([held[w] for w in part], pa.int64())], names=["token", "c"])

    held: Counter = Counter()
    for b in batches:
        for t in bytes_of(b.column(0)):
            held.update(tokens(t))
            if len(held) > 300_000:
                yield from out(held)
                held = Counter()
    yield from out(held)


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, c) of a frame of one binary column, ends included."""
    return texts.mapInArrow(_count_tokens, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """What is broadcast besides a shard of the filter."""

    total: int  # N, all training tokens
    distinct: int  # V
    table: Table  # of frequent tokens
    counts: np.ndarray  # by place; of START, the number of texts
    parts: np.ndarray  # by place: a spread context's number of groups
    totals: np.ndarray  # by place: M(v) of spread contexts
    spread_missed: float  # as a shard's
    rare: float  # weight of bigrams whose second token isn't in the table
    scale: Scale  # of M(v) in the filter

    def unseen(self) -> float:
        """The weight of all tokens that a context's members may be taken from."""
        return self.table.n + self.rare * (self.distinct - self.table.n)


def terms(v: np.ndarray, place: np.ndarray, w: np.ndarray, known: np.ndarray, m: Model, f: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mine, x, b): which bigrams the shard decides, and p = x + b * p(w) of those.

    place: of v in the table; known: w is in the table. M(v) of the table's contexts is read once by a worker.
    """
    parts = m.parts[place]
    key = keys_of(v, w, known, parts)
    seg = segment_of(key, f.segments)
    mine = f.has(seg)
    if not mine.all():
        v, place, parts, key, seg = (x[mine] for x in (v, place, parts, key, seg))
    seg = seg - f.first
    # keys in order, so that a segment is read as a whole before the next one
    one, at, back = np.unique(key, return_index=True, return_inverse=True)
    value = (MASS[f.levels(one, seg[at])] * np.where(one & np.uint64(1), 1.0, m.rare))[back]
    if f.read is None:
        f.read = np.where(m.parts > 0, m.totals, np.nan)
    total = f.read[place]
    group = key >> np.uint64(LOW) << np.uint64(LOW)
    new = np.flatnonzero(np.isnan(total))
    often, first = np.unique(place[new], return_index=True)
    often, first = often[often <= m.table.start], new[first[often <= m.table.start]]
    f.read[often] = f.totals(group[first], seg[first], m.scale)
    total = f.read[place]
    other = np.flatnonzero(place > m.table.start)
    other = other[np.argsort(group[other])]
    total[other] = f.totals(group[other], seg[other], m.scale)
    missed = np.where(parts > 0, m.spread_missed, f.missed[seg]) * m.unseen()
    keep = total / (np.maximum(m.counts[place], total + DISCOUNT) + missed)
    with np.errstate(invalid="ignore", divide="ignore"):
        scale = np.where(total > 0, keep / (total + missed), 0.0)
    return mine, value * scale, 1 - keep


ROW = "key long, token binary, doc_id long, held_out boolean, rows int, n_tokens long, n_known long, logs double, score double, x float, b float"
_NAMES = [x.split()[0] for x in ROW.split(", ")]


def _score(shared, shard) -> Callable:
    """A row per text with the sums over its frequent tokens (of the shard's contexts), and one per other token.

    A text's row has a token of its own that no text can hold, so these rows spread evenly in the join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, f = shared.value, shard.value
        for b in batches:
            for lo, texts in _slices(bytes_of(b.column(3)), 1 << 19):
                n = len(texts)
                s = Stream(texts)
                place = m.table.find(s.hash)
                mine, x, back = terms(s.before(s.hash, START), s.before(place, m.table.start), s.hash, place < m.table.start, m, f)
                doc, place = s.doc[mine], place[mine]
                known, c = place < m.table.start, m.counts[place]
                p = x + back * ((c + 1) / (m.total + m.distinct + 1))
                of = lambda y: np.bincount(doc[known], weights=y[known], minlength=n).astype(float)  # noqa: B023, E731
                keys, ids, held = (b.column(i).slice(lo, n) for i in range(3))
                key = keys.to_numpy()
                own = pa.array([b" " + str(k).encode() for k in key.tolist()], pa.binary())
                one = np.ones(len(c))
                with np.errstate(divide="ignore", invalid="ignore"):
                    logs, score = of(np.log10(c + 1)), of(np.log10(p))
                n_known = of(one).astype(np.int64)
                tokens_of = np.bincount(doc, minlength=n)
                first = np.full(n, f.first == 0, np.int32)
                none = pa.nulls(n, pa.float32())
                yield pa.RecordBatch.from_arrays([keys, own, ids, held, pa.array(first), pa.array(tokens_of), pa.array(n_known), pa.array(logs), pa.array(score), none, none], names=_NAMES)
                rare = np.flatnonzero(~known)
                if not len(rare):
                    continue
                word = (np.cumsum(~s.end) - 1)[mine][rare]  # its place among the words; ends are the table's
                start, end, raw = s.words.start, s.words.end, s.words.raw
                for i in range(0, len(rare), 30_000):
                    r, at = rare[i : i + 30_000], word[i : i + 30_000]
                    names = [END if e else raw[j:k] for e, j, k in zip(s.end[mine][r].tolist(), start[at].tolist(), end[at].tolist(), strict=True)] if len(s.words.start) else [END] * len(r)
                    k, none = len(r), pa.nulls
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[doc[r]]), pa.array(names, pa.binary()), none(k, pa.int64()), none(k, pa.bool_()), none(k, pa.int32()), none(k, pa.int64()), none(k, pa.int64()), none(k, pa.float64()), none(k, pa.float64()), pa.array(x[r].astype(np.float32)), pa.array(back[r].astype(np.float32))],
                        names=_NAMES,
                    )

    return run


def shards(filled: DataFrame, segments: int, most: int) -> Iterator[Shard]:
    """The filter's segments in order, as many to a shard as its size allows (one at least). Segments without
    entries have one byte of zeros."""
    sizes = {r["segment"]: r["n"] for r in filled.select("segment", F.length("data").alias("n")).toLocalIterator()}
    lo = 0
    while lo < segments:
        hi, size = lo, 0
        while hi < segments and (hi == lo or size + sizes.get(hi, 1) <= most):
            size += sizes.get(hi, 1)
            hi += 1
        n = np.array([sizes.get(i, 1) for i in range(lo, hi)], np.int64)
        shard = Shard(segments, lo, np.cumsum(n) - n, np.full(hi - lo, 8, np.uint64), np.zeros(hi - lo), b"")
        parts = [b"\0"] * (hi - lo)
        for r in filled.where(F.col("segment").between(lo, hi - 1)).select("segment", "bits", "error", "data").toLocalIterator():
            i = r["segment"] - lo
            shard.bits[i], shard.missed[i] = r["bits"], false_mass(r["error"])
            parts[i] = bytes(r["data"])
        shard.data = b"".join(parts)
        del parts
        yield shard
        lo = hi


def learn(texts: DataFrame, bits_per_entry: int = BITS_PER_ENTRY, segment_bytes: int = 1 << 19) -> tuple[Model, DataFrame, DataFrame, int]:
    """(model, counts, filled, segments) of a frame of one binary column: the broadcast tables, (token, c) of all
    tokens, and the filter's segments, which stay with the executors.

    A segment's bigrams meet in one task; there are as many segments as `segment_bytes` asks for at 0.1 entries a
    byte of text, so a task's share doesn't grow with the input.
    """
    spark = texts.sparkSession
    counts = written(token_counts(texts))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    size, n_texts = texts.agg(F.coalesce(F.sum(F.length(texts.columns[0])), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.where(F.col("c") >= F.lit(max(1.0, total * FREQUENT_SHARE))).toArrow()
    hashes, often = token_hashes(top["token"].to_pylist()), top["c"].to_numpy()
    table = Table(hashes)
    segments = max(1, round(size * 0.1 * bits_per_entry / 8 / segment_bytes))
    # a context of more than half a segment's share of all tokens gets several groups; START always does
    most = max(total * HOT_SHARE, total / (2 * segments), 1.0)
    many = lambda n: np.where(n > most, np.minimum(1024, 2 ** np.ceil(np.log2(np.maximum(2, n / most)))), 0).astype(np.int64)
    parts = table.about(hashes, many(often), 0, max(2, int(many(np.array(n_texts)))))
    rare = min(1.0, table.n / (distinct - table.n)) if distinct > table.n else 1.0
    shared = spark.sparkContext.broadcast((table, parts))
    blocks = texts.mapInArrow(_count_bigrams(shared, segments), "segment long, keys binary, counts binary")
    scale = Scale.to(rare * float(MASS[1]), 2 * most)
    kind = "segment long, bits long, error double, data binary, groups binary, totals binary"
    filled = written(blocks.groupBy("segment").applyInArrow(_fill_segments(rare, scale, bits_per_entry), kind))
    shared.unpersist()
    held: dict[int, float] = {}
    for r in filled.where(F.length("groups") > 0).select("groups", "totals").toLocalIterator():
        held.update(zip(np.frombuffer(r["groups"], "<u8").tolist(), np.frombuffer(r["totals"], "<f8").tolist(), strict=True))
    totals = np.zeros(len(parts))
    for at in np.flatnonzero(parts).tolist():
        n, v = int(parts[at]), START if at == table.start else table.keys[at]
        totals[at] = sum(held.get(g, 0.0) for g in group_of(np.full(n, v, np.uint64), np.arange(1, n + 1)).tolist())
    error = filled.agg(F.avg("error")).first()[0] or 0.0
    counts_of = table.about(hashes, often, -1, n_texts)
    return Model(total, distinct, table, counts_of, parts, totals, float(false_mass(error)), rare, scale), counts, filled, segments


def score_documents(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", max_shard_bytes: int = 256 << 20, **filter_options) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows that `held` doesn't mark.
    """
    sc = docs.sparkSession.sparkContext
    _take_back(sc)
    text = F.coalesce(docs[text_col].cast("binary"), F.lit(b""))
    ids = docs[id_col].cast("long")
    # a row's key is made of its own values, so it is the same in every pass; equal rows share one
    rows = docs.select(F.xxhash64(F.coalesce(ids, F.lit(0)), ids.isNull(), text).alias("key"), ids.alias("doc_id"), held.alias("held_out"), text.alias("text"))
    model, counts, filled, segments = learn(rows.where("NOT held_out").select("text"), **filter_options)
    shared = sc.broadcast(model)
    _note(sc, shared)
    passes = []
    for f in shards(filled, segments, max_shard_bytes):
        sent = Sent(sc, f)
        _note(sc, sent.about, sent.data)
        passes.append(rows.mapInArrow(_score(shared, sent), ROW))
    scored = passes[0]
    for more in passes[1:]:
        scored = scored.unionByName(more)
    joined = scored.join(counts, "token", "left")
    of_all = F.lit(model.total + model.distinct + 1)
    c = F.coalesce("c", F.lit(0))
    other = F.col("x").isNotNull()
    sums = joined.groupBy("key").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.sum("rows").cast("int").alias("rows"),
        (F.sum(F.coalesce("n_tokens", F.lit(0)))).alias("n_tokens"),
        F.sum(F.when(other, F.col("c").isNotNull().cast("long")).otherwise(F.col("n_known"))).alias("n_known"),
        F.sum(F.when(other, F.log10(c + 1)).otherwise(F.col("logs"))).alias("logs"),
        F.sum(F.when(other, F.log10(F.col("x") + F.col("b") * ((c + 1) / of_all))).otherwise(F.col("score"))).alias("score"),
    )
    each = sums.select("*", F.explode(F.sequence(F.lit(1), "rows")))
    of = lambda name: F.col(name) / F.col("rows")
    whole = lambda name: F.expr(f"{name} div rows").alias(name)
    return each.select("doc_id", "held_out", whole("n_tokens"), whole("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (of("logs") - whole("n_tokens") * F.log10(of_all)).alias("base_score"), of("score").alias("score"))
