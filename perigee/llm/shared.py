"""Small helpers that several operators of this package use."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z on bytes; every other byte as it is.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a folder of our own only where none is set (tests)."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not where:
        where = os.path.join(tempfile.gettempdir(), "perigee-checkpoints")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(where)
    return where


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_written: list[tuple[SparkSession, str]] = []


def written(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder: smaller than a checkpoint, its lineage cut. Tables go when
    the driver's process ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{unique_name('table')}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_remove_written)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _remove_written() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of fewer rows: whole documents are long, and each Python node of a task holds a batch on
    either side."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def bytes_of(col: pa.Array) -> list[bytes]:
    """The values of a string or binary column as bytes; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    if not (pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type)):
        col = col.cast(kind)
    return [x or b"" for x in col.to_pylist()]


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves the remainder; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus) == F.lit(remainder), F.lit(False))


def bounded_sample(df: DataFrame, key: Column, n_rows: int, bound: int) -> DataFrame:
    """About `bound` rows at most, picked by a hash of the key, so the same rows every time."""
    if n_rows <= bound:
        return df
    cut = int(bound / n_rows * (1 << 30))
    return df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < F.lit(cut))


def unique_name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:12]}"


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns under names of our own, so extra columns can't clash."""
    return df.select(*[df[src].alias(dst) for dst, src in cols.items()])


WORDISH = re.compile(rb"[^\x20\x09-\x0D]+")


class WordBatch:
    """White-space words of many texts as flat arrays, hashed without a loop over words.

    `data` holds the lower-cased (A-Z) bytes of all texts, each followed by one blank; word i is
    data[start[i]:end[i]] and belongs to text doc[i].
    """

    _powers: np.ndarray | None = None
    _inverse: np.ndarray | None = None
    BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        raw = b" ".join(texts).translate(LOWER) + b" " if texts else b""
        self.raw = raw
        a = self.data = np.frombuffer(raw, dtype=np.uint8)
        lens = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.text_end = np.cumsum(lens)
        self.text_start = self.text_end - lens
        blank = (a == 32) | ((a >= 9) & (a <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank))))  # odd changes: a word starts or ends
        self.start, self.end = edge[0::2].astype(np.int64), edge[1::2].astype(np.int64)
        self.doc = np.searchsorted(self.text_end, self.start, side="right").astype(np.int64)
        self.n_words = np.bincount(self.doc, minlength=self.n).astype(np.int64)

    @classmethod
    def _tables(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of the base and of its inverse modulo 2**64, for words of up to n bytes."""
        if cls._powers is None or len(cls._powers) < n:
            inv = pow(int(cls.BASE), -1, 1 << 64)
            p, q = np.empty(n, np.uint64), np.empty(n, np.uint64)
            x = y = 1
            for i in range(n):
                p[i], q[i] = x, y
                x, y = x * int(cls.BASE) & (1 << 64) - 1, y * inv & (1 << 64) - 1
            cls._powers, cls._inverse = p, q
        return cls._powers, cls._inverse

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial in its bytes, then mixed."""
        block = 1 << 12
        p, q = self._tables(block)
        n = len(self.data)
        at = np.arange(n) & (block - 1)
        with np.errstate(over="ignore"):
            term = (self.data.astype(np.uint64) + np.uint64(1)) * p[at]
            # within a block of 4096 bytes the sums are plain; each block carries on from zero
            pad = (-n) % block
            sums = np.cumsum(np.concatenate((term, np.zeros(pad, np.uint64))).reshape(-1, block), axis=1).reshape(-1)
            b0, b1 = self.start // block, (self.end - 1) // block
            before = np.where(self.start % block == 0, np.uint64(0), sums[np.maximum(self.start - 1, 0)])
            h = sums[self.end - 1] - before
            out = h * q[self.start % block]
            for i in np.flatnonzero(b0 != b1):  # the few words that cross a block's end
                x = 0
                for c in reversed(self.raw[self.start[i] : self.end[i]]):
                    x = (x * int(self.BASE) + c + 1) & (1 << 64) - 1
                out[i] = x
            return mix(out ^ (self.end - self.start).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A full-avalanche finalizer on 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def text_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches of about `most` bytes of text (a longer single text comes alone)."""
    for b in batches:
        texts = bytes_of(b.column(b.schema.get_field_index(column)))
        lo = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > most:
                yield b.slice(lo, i - lo), texts[lo:i]
                lo, size = i, 0
            size += len(t)
        if lo < len(texts):
            yield b.slice(lo), texts[lo:]


def filter_rows(docs: DataFrame, text_col: str, keep, holds: bool = False) -> DataFrame:
    """The rows of docs for which keep(texts as bytes, null as empty) says True, all columns as they are.

    Rows stay in their partitions; nothing is shuffled. holds: keep has something that the worker holds.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not holds:
            only_one("nothing")
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(np.asarray(keep(bytes_of(b.column(at))), dtype=bool)))

    return docs.mapInArrow(run, docs.schema)


#: Bits of a set of keys: eight for each, up to 2**29 (64 MB).
MOST_BITS = 1 << 29


class KeySet:
    """A broadcast bitmap over hashed 64-bit keys, of bounded size. It may hold more keys than were put in, never
    fewer, so rows that it leaves out need no shuffle. It only saves work."""

    def __init__(self, keys: DataFrame, n: int):
        bits = 1 << 15
        while bits < min(8 * n, MOST_BITS):
            bits *= 2
        place = F.pmod(F.col(keys.columns[0]), F.lit(bits))
        blocks = keys.select(place.alias("p")).groupBy(F.expr("p div 32768").alias("block")).agg(F.bitmap_construct_agg(F.expr("p % 32768")).alias("bitmap"))
        data = np.zeros(bits // 8, np.uint8)
        for r in blocks.toLocalIterator():
            data[r["block"] * 4096 : (r["block"] + 1) * 4096] = np.frombuffer(r["bitmap"], np.uint8)
        self.bits, self.shared = bits, keys.sparkSession.sparkContext.broadcast(data)

    def has(self, key: np.ndarray) -> np.ndarray:
        at = key & (self.bits - 1)
        return (self.shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def inside(self, rows: DataFrame, once: bool = False, but: bool = False, also: KeySet | None = None) -> DataFrame:
        """The rows (key first) inside the set (outside with `but`), without a shuffle; with `once`, one row of each
        key and task; with `also`, whose second column is in that set as well."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for b in batches:
                if not b.num_rows:
                    continue
                key = b.column(0).to_numpy()
                keep = self.has(key) != but
                if also is not None:
                    keep &= also.has(b.column(1).to_numpy())
                if once:
                    for i in np.flatnonzero(keep).tolist():
                        keep[i] = key[i] not in seen
                        seen.add(key[i])
                yield b.filter(pa.array(keep))

        return rows.mapInArrow(run, rows.schema)


_held: list = [None, None]


def only_one(owner: object, build=None):
    """What a worker process holds for an owner, made when it is asked for. Nothing of other owners stays: workers
    are used again by other operators, whose memory it would take."""
    if _held[0] != owner:
        if _held[1] is not None:
            _held[:] = [None, None]
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):  # give it back to the system where the C library can
                ctypes.CDLL(None).malloc_trim(0)
        _held[:] = [owner, build() if build else None]
    return _held[1]
