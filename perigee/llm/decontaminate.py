"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items.

Texts are lower-cased (A-Z) and reduced to words of digits, letters a-z and non-ASCII bytes. A window is ten
consecutive words of an item (an item of fewer words is one window). Windows, blank-padded, are the
automaton's patterns; each document is scanned once, and hits map back to words and to character offsets of
the original text.

Defined results: null and wordless texts have no words and no hits; null or wordless items have no window;
an item with a null id counts under the empty id; repeated rows each get their result; either table may be
empty; other columns are never read. Items go into one automaton while their windows have at most
`max_chars` characters; a larger benchmark is split by item into as many automata as that bound asks for, so
what one task holds doesn't grow with the benchmark.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.llm.shared import bytes_of, filter_rows, only_one

#: Bytes of words as they are (A-Z lowered), every other byte a blank.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
HITS_SCHEMA = "doc_id long, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>"


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def windows(text: bytes, k: int) -> list[bytes]:
    """The windows of an item, blank-padded."""
    w = words(text)
    return [b" " + b" ".join(w[i : i + k]) + b" " for i in range(max(1, len(w) - k + 1))] if w else []


def _automaton(key: str, patterns: list[tuple[bytes, tuple[int, ...]]]) -> ahocorasick.Automaton:
    """Built once in a worker process; one shard is held at a time."""

    def build() -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for p, items in patterns:
            a.add_word(p.decode("latin-1"), (p.count(b" ") - 1, items))
        a.make_automaton()
        return a

    return only_one(("automaton", key), build)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scanner(shared, last: bool) -> Callable:
    """A pass with one automaton: adds its hits (word ranges) and items; the last pass sums them up."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, patterns = shared.value
        auto = _automaton(key, patterns) if patterns else None
        for b in batches:
            texts, marks, ids = bytes_of(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()
            n_words, n_hit, spans = [], [], []
            for i, text in enumerate(texts):
                w = words(text)
                flat = b" " + b" ".join(w) + b" "
                found = list(auto.iter(flat.decode("latin-1"))) if w and auto else []
                if found:
                    blanks = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
                    stop = np.searchsorted(blanks, [e for e, _ in found])  # the words before this blank
                    size = np.array([k for _, (k, _) in found])
                    marks[i] += np.stack((stop - size, stop), 1).astype("<i8").tobytes()
                    ids[i] = sorted({*ids[i], *(names[j] for _, (_, items) in found for j in items)})
                if last:
                    n_words.append(len(w))
                    hit = _covered(marks[i], len(w)) if marks[i] else None
                    n_hit.append(0 if hit is None else int(hit.sum()))
                    spans.append([] if hit is None else _original(text, hit))
            ids = pa.array(ids, pa.list_(pa.string()))
            if last:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), ids, pa.array(spans, _SPANS)], names=["doc_id", "n_words", "n_hit", "item_ids", "spans"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(marks, pa.binary()), ids], names=["doc_id", "text", "marks", "item_ids"])

    return scan


def _covered(marks: bytes, n: int) -> np.ndarray:
    at = np.frombuffer(marks, "<i8").reshape(-1, 2)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at[:, 0], 1)
    np.add.at(edge, at[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def _original(text: bytes, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words as character offsets of the original text."""
    at = [m.span() for m in _WORD.finditer(text)]
    turn = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    chars = lambda i: len(text[:i].decode("utf-8", "replace"))
    return [{"start": chars(at[a][0]), "end": chars(at[b - 1][1])} for a, b in zip(turn[::2], turn[1::2], strict=True)]


def _shards(benchmark: DataFrame, window: int, max_chars: int, item_col: str, item_text: str) -> Iterator:
    """Broadcast patterns of the benchmark, in shards of bounded size; one shard where it is small."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(benchmark[item_col].cast("string"), F.lit("")).alias("item"), benchmark[item_text].cast("binary").alias("text")).where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, math.ceil(size * window / max_chars))
    for s in range(shards):
        mine = items if shards == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == s)
        names: dict[str, int] = {}
        patterns: dict[bytes, set[int]] = {}
        for r in mine.toLocalIterator():  # a bounded shard of the benchmark
            i = names.setdefault(r["item"], len(names))
            for p in windows(bytes(r["text"]), window):
                patterns.setdefault(p, set()).add(i)
        pairs = sorted((p, tuple(sorted(x))) for p, x in patterns.items())
        key = hashlib.sha256(repr((list(names), pairs)).encode()).hexdigest()
        yield spark.sparkContext.broadcast((key, list(names), pairs))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_chars: int = 6_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids, spans) of each row of docs.

    The benchmark is read in shards whose windows have about `max_chars` characters (its size is checked
    first). Nothing of the documents is shuffled, however many shards there are.
    """
    shards = list(_shards(benchmark, window, max_chars, item_col, item_text))
    out = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("binary").alias("text"), F.lit(b"").alias("marks"), F.array().cast("array<string>").alias("item_ids"))
    for i, shared in enumerate(shards):
        last = i == len(shards) - 1
        out = out.mapInArrow(_scanner(shared, last), HITS_SCHEMA if last else "doc_id long, text binary, marks binary, item_ids array<string>")
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_chars: int = 6_000_000, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs in which no window occurs, with all their columns."""
    for shared in _shards(benchmark, window, max_chars, item_col, item_text):
        docs = filter_rows(docs, text_col, _clean(shared), holds=True)
    return docs


def _clean(shared) -> Callable:
    def keep(texts: list[bytes]) -> list[bool]:
        key, _, patterns = shared.value
        if not patterns:
            return [True] * len(texts)
        auto = _automaton(key, patterns)
        flat = ((b" " + b" ".join(words(t)) + b" ").decode("latin-1") for t in texts)
        return [next(auto.iter(f), None) is None for f in flat]

    return keep


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: counts, the digest of the items found and whether any window occurs."""
    hits = find_contamination(docs, benchmark, **options)
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "spans",
    )
