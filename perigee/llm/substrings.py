"""Removal of long repeated byte strings across a corpus.

Every byte that some `length`-byte string covers which also starts anywhere else is removed; strings never
cross documents. Named method and what runs: see bwt.py for the merge of shard Burrows-Wheeler transforms
by interleave refinement. It needs one pass over all suffixes per byte of common prefix (400 here), which the
README's figures show to be out of reach; so the query runs on anchors instead, which is exact as well:

1. Each string of `length` bytes has an anchor: of its first `slack` positions the one whose `gram` bytes hash
   lowest. It depends on the string alone, so equal strings have their anchor at the same place in them. A
   document's strings with one anchor start at consecutive positions.
2. All of them hold the anchor's core, the length - slack + 1 bytes from the anchor on. Cores are shuffled by
   hash; strings whose core occurs once don't repeat.
3. Where a core repeats, anchors whose whole context (all their strings together) is equal repeat in all
   strings. For the others, and one of each class of equal contexts, each string's hash is shuffled.
4. Repeated starts go back to their documents, whose bytes are then cut.

A document's key is a 64-bit hash of its text, so it is the same in every plan, whatever tasks read the text, and
equal texts share one key. Equal documents are found by their full digests. A task gives out the anchors of a text
once, however many copies of it it reads; a text that comes from two tasks is one that occurs twice, so its
strings repeat in truth. Cores and contexts are compared by 64 bits each, and both must agree; strings that are
compared one by one have 128 bits. (Of 10**9 distinct texts, two share a key with a chance of 3 in 100.)

No large group meets in one task: cores are counted by partial sums first, and only anchors that a bitmap of bounded
size lets through are made a second time and joined with the counts; strings are compared within a task first, and
each goes on once for a task's block of strings.

Defined results: null text is empty; texts shorter than `length` lose nothing; equal documents of at least `length`
bytes lose everything; repeated rows count as documents of their own; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perigee.llm.shared import KeySet, bytes_of, mix, written

GRAM = 24
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Rolling:
    """Hashes of any spans of one text by prefix sums of a polynomial modulo 2**64, and a mix.

    The sum over a span is shifted to the span's own origin with the inverse of the base, so equal bytes give
    equal sums wherever they stand. Bytes are first spread to 64 bits, so that the polynomial has no structure
    of small coefficients.
    """

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, text: bytes, base: int):
        a = np.frombuffer(text, np.uint8)
        p, self.inverse = self._table(base, len(a) + 1)
        with np.errstate(over="ignore"):
            spread = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(base))
            self.sums = np.zeros(len(a) + 1, np.uint64)
            np.cumsum(spread[a] * p[: len(a)], out=self.sums[1:])

    @classmethod
    def _table(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if base not in cls._powers or len(cls._powers[base][0]) < n:
            size = max(n, 1 << 16)
            inv = pow(base, -1, 1 << 64)
            out = []
            for b in (base, inv):
                x = np.full(size, b, np.uint64)
                x[0] = 1
                with np.errstate(over="ignore"):
                    out.append(np.cumprod(x))
            cls._powers[base] = out[0], out[1]
        return cls._powers[base]

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[stop] - self.sums[start]) * self.inverse[start] + (stop - start).astype(np.uint64))


def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """For each i the leftmost place of the least x among x[i : i + width]; len(x) - width + 1 places.

    x must be below 2**32; the place inside blocks of `width` rides along in the low bits.
    """
    n = len(x) - width + 1
    pad = -len(x) % width
    key = np.concatenate(((x.astype(np.uint64) << np.uint64(32)) | np.arange(len(x), dtype=np.uint64), np.full(pad, np.uint64((1 << 64) - 1))))
    block = key.reshape(-1, width)
    left = np.minimum.accumulate(block, axis=1).reshape(-1)
    right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(right[:n], left[width - 1 : width - 1 + n]) & np.uint64((1 << 32) - 1)).astype(np.int64)


def anchors(text: bytes, length: int, slack: int) -> tuple[Rolling, np.ndarray, np.ndarray, np.ndarray] | None:
    """(hashes, anchor, first start, last start) of the strings of a text; None if it is too short."""
    if len(text) < length:
        return None
    r = Rolling(text, BASES[0])
    at = np.arange(len(text) - length + slack)
    gram = min(GRAM, length - slack + 1)
    h = r.spans(at, at + gram) >> np.uint64(32)
    place = sliding_argmin(h, slack)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.append(first[1:], len(place)) - 1
    return r, place[first], first, last


#: Starts that are worked on at once, so memory doesn't grow with a text's length.
CHUNK = 1 << 20


def _emit_anchors(length: int, slack: int, among: KeySet | None = None) -> Callable:
    core = length - slack + 1

    def packed(held: list[tuple]) -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        keep = slice(None) if among is None else among.has(cols[0])
        kinds = (np.int64, np.int64, np.int64, np.int32, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(c[keep].astype(k)) for c, k in zip(cols, kinds, strict=True)], names=["core", "doc", "whole", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, seen = 0, set()
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), bytes_of(b.column(1)), strict=True):
                if len(text) < length or (digest := hashlib.sha256(text).digest()) in seen:
                    continue
                seen.add(digest)
                for i in range(0, len(text) - length + 1, CHUNK):
                    r, at, lo, hi = anchors(text[i : i + CHUNK + length - 1], length, slack)
                    whole = r.spans(lo, hi + length)
                    with np.errstate(over="ignore"):
                        whole = mix(whole + ((at - lo) * 65536 + hi - lo).astype(np.uint64))
                    held.append((r.spans(at, at + core).view(np.int64), np.full(len(at), doc, np.int64), whole.view(np.int64), lo + i, hi + i))
                    size += len(at)
                    if size > 50_000:
                        yield packed(held)
                        held, size = [], 0
        if size:
            yield packed(held)

    return run


#: Strings that are compared within a task before they are shuffled.
COMBINED = 1 << 17


def _emit_strings(length: int) -> Callable:
    """For (doc, text, spans): a row (x, y, doc, lo, hi, n) for each distinct string (128 bits) of some texts, n
    being 2 if it occurs there again; and for each run of starts of such strings a row under a key of its own.

    So a string that a large share of all texts holds is shuffled once for each task and COMBINED strings.
    """

    def combined(held: list[tuple]) -> pa.RecordBatch:
        x, y, doc, lo = map(np.concatenate, zip(*held, strict=True))
        order = np.lexsort((y, x))
        new = np.concatenate(([True], (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])))
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(x)))
        again = np.zeros(len(x), bool)
        again[order] = np.repeat(n > 1, n)
        one = order[first]
        # starts stand in order within a text, so runs of repeated ones are neighbours
        follows = np.concatenate(([False], again[1:] & again[:-1] & (doc[1:] == doc[:-1]) & (lo[1:] == lo[:-1] + 1)))
        begin = np.flatnonzero(again & ~follows)
        stop = np.flatnonzero(again & ~np.append(follows[1:], False))
        with np.errstate(over="ignore"):
            own = mix(doc[begin].view(np.uint64) * np.uint64(BASES[0]) + lo[begin].astype(np.uint64))
        cols = [np.concatenate(c) for c in ((x[one], own), (y[one], mix(own)), (doc[one], doc[begin]), (lo[one], lo[begin]), (lo[one], lo[stop]), (np.where(n > 1, 2, 1), np.full(len(begin), 2)))]
        kinds = (np.int64, np.int64, np.int64, np.int32, np.int32, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(c.view(k) if c.dtype == np.uint64 else c.astype(k)) for c, k in zip(cols, kinds, strict=True)], names=["x", "y", "doc", "lo", "hi", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for doc, text, own in zip(b.column(0).to_pylist(), bytes_of(b.column(1)), b.column(2).to_pylist(), strict=True):
                own = sorted((s["lo"], s["hi"]) for s in own)
                base = 0
                while base < len(own):  # spans that lie within one chunk
                    stop = base + 1
                    while stop < len(own) and own[stop][1] - own[base][0] < CHUNK:
                        stop += 1
                    origin, last = own[base][0], own[stop - 1][1]
                    start = np.concatenate([np.arange(lo, hi + 1) for lo, hi in own[base:stop]]) - origin
                    base = stop
                    x, y = (Rolling(text[origin : last + length], k).spans(start, start + length) for k in BASES)
                    held.append((x, y, np.full(len(start), doc, np.int64), start + origin))
                    size += len(start)
                    if size >= COMBINED:
                        yield combined(held)
                        held, size = [], 0
        if size:
            yield combined(held)

    return run


def _cut(length: int) -> Callable:
    """For (doc_id, text, copied, starts): the bytes that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, copied, starts = bytes_of(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()
            removed, n_spans, spans, digest = [], [], [], []
            for text, gone, own in zip(texts, copied, starts, strict=True):
                if gone:
                    at = [(0, len(text))]
                elif own:
                    x = np.array(sorted((s["lo"], s["hi"] + length) for s in own), np.int64)
                    stop = np.maximum.accumulate(x[:, 1])
                    new = np.concatenate(([True], x[1:, 0] > stop[:-1]))
                    at = list(zip(x[new, 0].tolist(), stop[np.append(np.flatnonzero(new)[1:] - 1, len(x) - 1)].tolist(), strict=True))
                else:
                    at = []
                kept, last = [], 0
                for i, j in at:
                    kept.append(text[last:i])
                    last = j
                kept.append(text[last:])
                removed.append(sum(j - i for i, j in at))
                n_spans.append(len(at))
                spans.append([{"start": i, "end": j} for i, j in at])
                digest.append(hashlib.sha256(b"".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string()), pa.array(spans, SPANS)],
                names=RESULT,
            )

    return run


def _untouched(touched: KeySet) -> Callable:
    """For (doc, doc_id, text): the results of texts outside the set, which lose nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            b = b.filter(pa.array(~touched.has(b.column(0).to_numpy())))
            n, texts = b.num_rows, bytes_of(b.column(2))
            none, digest = pa.array(np.zeros(n, np.int64)), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([len(t) for t in texts], pa.int64()), none, none, digest, pa.array([[]] * n, SPANS)], names=RESULT)

    return run


RESULT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
ANCHOR, STRING = "core long, doc long, whole long, lo int, hi int", "x long, y long, doc long, lo int, hi int, n int"


def remove_repeats(docs: DataFrame, length: int = 400, slack: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed) of each row of docs."""
    slack = slack or max(1, min(length // 2, 120))
    raw = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("binary"), F.lit(b"")).alias("text"))
    rows = raw.select(F.xxhash64("text").alias("doc"), "doc_id", "text")
    texts = rows.select("doc", "text")
    digests = rows.where(F.length("text") >= length).select("doc", F.unhex(F.sha2("text", 256)).alias("digest"))
    copies = written(digests.groupBy("doc", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc").distinct())

    found = written(_repeated_cores(lambda among: texts.mapInArrow(_emit_anchors(length, slack, among), ANCHOR)))
    sure = found.where("same > 1").select("doc", "lo", "hi")
    unsure = found.where("same = 1 OR first AND same < cores").select("doc", "lo", "hi")
    holders = KeySet(unsure.select("doc"), unsure.count())
    asked = holders.inside(texts, once=True).join(unsure.groupBy("doc").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "doc")
    again = _repeated_strings(asked.mapInArrow(_emit_strings(length), STRING))

    starts = sure.unionByName(again).groupBy("doc").agg(F.collect_set(F.struct("lo", "hi")).alias("starts"))
    marks = written(copies.withColumn("copied", F.lit(True)).join(starts, "doc", "full").withColumn("starts", F.when(F.col("copied").isNull(), F.col("starts"))))
    touched = KeySet(marks.select("doc"), marks.count())
    cut = touched.inside(rows).join(marks, "doc", "left").select("doc_id", "text", F.coalesce("copied", F.lit(False)).alias("copied"), "starts")
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>"
    return rows.mapInArrow(_untouched(touched), kind).unionByName(cut.mapInArrow(_cut(length), kind))


def _repeated_cores(found: Callable[[KeySet | None], DataFrame]) -> DataFrame:
    """Anchors whose core another anchor has, with the numbers of anchors of the core (`cores`) and of the whole
    context (`same`), and whether it is the first of the latter.

    Counts are partial sums, and they are joined back, so a core that a large share of all documents holds is a row
    per task in the former and split in the latter."""
    often = written(found(None).groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core"))
    mine = written(found(KeySet(often, often.count())))
    contexts = mine.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("same"), F.min("doc").alias("least"))
    cores = contexts.groupBy("core").agg(F.sum("same").alias("cores")).where("cores > 1")
    counted = mine.join(contexts.join(cores, "core"), ["core", "whole"])
    return counted.select("doc", "lo", "hi", "same", "cores", (F.col("doc") == F.col("least")).alias("first"))


def _repeated_strings(strings: DataFrame) -> DataFrame:
    """(doc, lo, hi) of the starts of strings that occur more than once; a key has one row per task and block."""
    total = F.sum("n").over(Window.partitionBy("x", "y"))
    return strings.withColumn("total", total).where("total > 1").select("doc", "lo", "hi")
