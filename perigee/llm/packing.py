"""Best-fit packing of token pieces into sequences, in bulk-synchronous sweeps.

Pieces are range-sorted by length and numbered within their length across partitions. The open gaps and the
unplaced pieces are both kept as runs of equal size; a superstep gives each run of pieces its successor gap
(the smallest that fits), ranks decide which pieces of the run get which gap, the gaps shrink, and the rest
goes to the next superstep. Lengths and gaps are at most the capacity, so a sweep works on a table whose size
doesn't depend on the data, while the numbering and the placing of pieces run over all partitions. The
outcome is that of best-fit decreasing over single pieces.

Defined results: null text is empty, and an empty text is the end id alone; repeated rows and ids are pieces
of their own; a null id stays null; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.llm.shared import LOWER, bytes_of, materialize, only_one

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: White-space-free strings whose ids a worker keeps.
CACHED = 200_000
LONGEST_CACHED = 40
ALL_LETTERS = regex.compile(r"\p{L}+")

PUNCTUATION = b".,;:!?"


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes stand for
    themselves, the others for the characters from U+0100 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class WordIds(dict):
    """From a white-space-free string to its ids (little-endian 32-bit numbers), filled as strings come.

    Strings of letters go straight to the vocabulary's merges; others through the whole tokenizer. Of the
    strings that come after the first CACHED ones nothing is kept, so a worker's memory is bounded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.merges = self.whole.model.tokenize
        self.letters = _byte_letters()

    def _letters(self, w: bytes) -> str | None:
        """The byte letters of a string that is one word for the tokenizer; None if it may not be one."""
        if w.isalpha():
            return w.decode()
        if w.isascii():
            return None
        s = w.decode("utf-8", "replace")
        if ALL_LETTERS.fullmatch(s) and s.lower() == s and unicodedata.is_normalized("NFC", s):
            return "".join([self.letters[b] for b in s.encode()])
        return None

    def __missing__(self, w: bytes) -> bytes:
        low = w if b"<|" in w else w.translate(LOWER)  # the strings of special tokens keep their case
        core = low.rstrip(PUNCTUATION)
        if core and core != w and (len(core) == len(low) or core[-1:].isalnum()):
            ids = self[core] + (self[low[len(core) :]] if len(core) < len(low) else b"")
        elif (letters := self._letters(low)) is not None:
            ids = array("I", [t.id for t in self.merges(letters)]).tobytes()
        else:
            ids = array("I", self.whole.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()
        if len(self) < CACHED and len(w) <= LONGEST_CACHED:
            self[w] = ids
        return ids


def encode_texts(path: str, texts: list[bytes]) -> list[bytes]:
    """The ids of each text as little-endian 32-bit numbers.

    White space separates the tokenizer's words and is dropped by it, so a text's ids are those of its
    white-space-free strings, one after another. ASCII punctuation after an ASCII letter or digit begins a
    word of its own, and the tokenizer lowers case first, so those strings are looked up in parts.
    """
    get = only_one(("ids", path), lambda: WordIds(path)).__getitem__
    return [b"".join(map(get, (t if b"<|" in t else t.translate(LOWER)).split())) for t in texts]


def _cutter(path: str, capacity: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = b.column(0).to_pylist(), []
            texts = bytes_of(b.column(1))
            for lo in range(0, len(texts), 256):
                for doc, flat in zip(ids[lo : lo + 256], encode_texts(path, texts[lo : lo + 256]), strict=True):
                    flat += b"\0\0\0\0"  # the end id
                    for k, at in enumerate(range(0, len(flat), 4 * capacity)):
                        piece = flat[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each row of docs: its ids and the end id, cut where longer than the capacity."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("binary").alias("text"))
    return rows.mapInArrow(_cutter(tokenizer_path, capacity), PIECES)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and the number of a row among those of its length in the sorted partition."""
    part, last, count = TaskContext.get().partitionId(), -1, 0
    for b in batches:
        n = b.column(b.schema.get_field_index("length")).to_numpy()
        if not len(n):
            continue
        new = np.concatenate(([True], n[1:] != n[:-1]))
        first = np.maximum.accumulate(np.where(new, np.arange(len(n)), 0))
        nth = np.arange(len(n)) - first
        if n[0] == last:
            nth[first == 0] += count
        last, count = n[-1], int(nth[-1]) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(nth.astype(np.int64))], names=[*b.schema.names, "part", "nth"])


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, items, first sequence, items per sequence, first offset).

    Best-fit decreasing over runs: a run's pieces go to the smallest gap that fits, as many to each as it
    takes, before the next gap or a new sequence. A gap g takes g // length pieces and is left with less
    than half of itself, so a run of gaps is split a number of times logarithmic in the capacity, and the
    plan has less than 50 runs per length.
    """
    runs, sizes, open_gaps, sequences = [], [], defaultdict(deque), 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not open_gaps[gap]:
                insort(sizes, gap)
            open_gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, n = open_gaps[gap].popleft()
                if not open_gaps[gap]:
                    sizes.pop(at)
            else:
                gap, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            per = gap // length
            full = min(n, left // per)
            if full:
                runs.append((length, rank, full * per, first, per, capacity - gap))
                put(gap - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if full < n:
                if left:  # fewer than one gap takes
                    runs.append((length, rank, left, first + full, left, capacity - gap))
                    put(gap - left * length, first + full, 1)
                    full, left = full + 1, 0
                put(gap, first + full, n - full)
    return runs


def _placer(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, key, table = shared.value
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c)).to_numpy()  # noqa: B023, E731
            length, parts = col("length"), col("part")
            rank = col("nth") + np.array([before[p, n] for p, n in zip(parts.tolist(), length.tolist(), strict=True)], np.int64).reshape(-1)
            at = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            run = table[at]
            i = rank - run[:, 1]
            keep = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(run[:, 3] + i // run[:, 4]), pa.array(run[:, 5] + i % run[:, 4] * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    What the driver holds is bounded: a count per length and partition that meet (at most the capacity plus
    the number of partitions), and the plan.
    """
    spark = pieces.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = materialize(pieces)  # the range partitioner samples it, then it is read again
    dealt = pieces.repartitionByRange(n, F.desc("length"), "doc_id", "piece").sortWithinPartitions(F.desc("length"), "doc_id", "piece")
    numbered = materialize(dealt.mapInArrow(_number, PIECES + ", part int, nth long"))
    counts, before = defaultdict(int), {}
    for r in numbered.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).orderBy("length", "part").toLocalIterator():
        before[r["part"], r["length"]] = counts[r["length"]]
        counts[r["length"]] += r["n"]
    runs = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast((before, (runs[:, 0] << 44) + runs[:, 1], runs))
    return numbered.mapInArrow(_placer(shared), PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: where its ids lie in the document and in the packed sequences."""
    return pack(token_pieces(docs, tokenizer_path, capacity, id_col, text_col), capacity)
