"""Exact dedup over a minimal perfect hash of the digests seen before.

Historical digests are split into buckets by their leading bits. Each bucket gets a minimal perfect hash (a cascade of
bit arrays; the rank of a key's bit is its slot); a slot holds the full digest, the winner's id and the group's size.
New digests look their slot up and compare all 32 bytes. Those that match are members: they go into the slot, which
then names the winner and the size of the whole group, and leave; the others group among themselves. A row's winner is
read from its digest's slot, or from its group of nonmembers.

Defined results: null text counts as empty; runs of ASCII white space equal one space; a null id sorts after
every other; of rows with the same id and text one stays; an empty table gives an empty result; columns
other than the id and the text are never read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigee.llm.shared import KeySet, held_out, mix, written

BLANKS = r"[\x20\x09-\x0D]+"
GAMMA = 2.0
INDEX_SCHEMA = "bucket long, levels array<binary>, digests binary, winners binary, sizes binary"


def normalised_digest(text: Column) -> Column:
    """SHA-256 (binary) of the text with white-space runs as one space."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ").cast("binary"), 256))


class PerfectHash:
    """A minimal perfect hash over distinct 32-byte digests (rows of a uint8 array)."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.base = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.rank = [np.cumsum(x) - 1 for x in levels]

    @staticmethod
    def _at(key: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(key + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    @staticmethod
    def _key(digests: np.ndarray) -> np.ndarray:
        w = np.ascontiguousarray(digests).view("<u8")
        return mix(w[:, 1]) ^ w[:, 2]

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        key, levels = cls._key(digests), []
        while len(key):
            if len(levels) > 200:
                raise ValueError("digests aren't distinct")
            size = max(1, math.ceil(GAMMA * len(key)))
            at = cls._at(key, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            key = key[~alone[at]]
        return cls(levels)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest; -1 where no level has its bit. A strange digest may get a slot."""
        key = self._key(digests)
        out, left = np.full(len(key), -1, np.int64), np.arange(len(key))
        for i, bits in enumerate(self.levels):
            if not len(left):
                break
            at = self._at(key[left], i, len(bits))
            hit = bits[at]
            out[left[hit]] = self.base[i] + self.rank[i][at[hit]]
            left = left[~hit]
        return out


def _rows(col) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, 32)


def _build(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    digests = _rows(t["digest"])
    ph = PerfectHash.build(digests)
    order = np.argsort(ph.slots(digests))
    winners = t["first_id"].to_numpy(zero_copy_only=False).astype("<i8")[order]
    sizes = t["n"].to_numpy(zero_copy_only=False).astype("<i8")[order]
    return pa.table(
        {
            "bucket": pa.array([key[0].as_py()], pa.int64()),
            "levels": pa.array([[np.packbits(x).tobytes() + len(x).to_bytes(8, "little") for x in ph.levels]], pa.list_(pa.binary())),
            "digests": pa.array([digests[order].tobytes()], pa.binary()),
            "winners": pa.array([winners.tobytes()], pa.binary()),
            "sizes": pa.array([sizes.tobytes()], pa.binary()),
        }
    )


def _slots(index: pa.Table, probe: np.ndarray) -> np.ndarray:
    """The slot of each digest in a bucket's index; -1 for nonmembers, by comparing whole digests."""
    if not len(probe) or not index.num_rows:
        return np.full(len(probe), -1, np.int64)
    levels = [np.unpackbits(np.frombuffer(x[:-8], np.uint8), count=int.from_bytes(x[-8:], "little")).astype(bool) for x in index["levels"][0].as_py()]
    held = np.frombuffer(index["digests"][0].as_py(), np.uint8).reshape(-1, 32)
    slot = PerfectHash(levels).slots(probe)
    return np.where((slot >= 0) & (held[np.maximum(slot, 0)] == probe).all(axis=1), slot, -1)


def _lookup(key: tuple[pa.Scalar, ...], new: pa.Table, index: pa.Table) -> pa.Table:
    """New groups with the slot that the history has for their digest."""
    return new.append_column("slot", pa.array(_slots(index, _rows(new["digest"])), pa.int64()))


def _fold(key: tuple[pa.Scalar, ...], index: pa.Table, members: pa.Table) -> pa.Table:
    """A bucket's slots as (digest, keep, group_size), with the members that were found put in."""
    if not index.num_rows:
        return pa.table({"digest": pa.array([], pa.binary()), "keep": pa.array([], pa.int64()), "group_size": pa.array([], pa.int64())})
    winners, sizes = (np.frombuffer(index[c][0].as_py(), "<i8").copy() for c in ("winners", "sizes"))
    if members.num_rows:
        slot = members["slot"].to_numpy()
        np.minimum.at(winners, slot, members["first_id"].to_numpy())
        np.add.at(sizes, slot, members["n"].to_numpy())
    flat = index["digests"][0].as_py()
    return pa.table({"digest": pa.array([flat[i : i + 32] for i in range(0, len(flat), 32)], pa.binary()), "keep": pa.array(winners), "group_size": pa.array(sizes)})


#: Stands for a null id inside the index: larger than any id that a table will hold.
NO_ID = (1 << 63) - 1


def _groups(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("digest").agg(F.min("id").alias("first_id"), F.sum("m").alias("n"))


def _bucketed(groups: DataFrame, buckets: int) -> DataFrame:
    lead = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long")
    return groups.withColumn("bucket", lead % F.lit(buckets))


def build_index(pairs: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket of the distinct digests in (digest, id, m)."""
    return _bucketed(_groups(pairs), buckets).groupBy("bucket").applyInArrow(_build, INDEX_SCHEMA)


def lookup(groups: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """Groups (digest, first_id, n) with their bucket and slot in the index (-1: not there)."""
    new = _bucketed(groups, buckets).groupBy("bucket")
    return new.cogroup(index.groupBy("bucket")).applyInArrow(_lookup, "digest binary, first_id long, n long, bucket long, slot long")


def fold(index: DataFrame, members: DataFrame) -> DataFrame:
    """(digest, keep, group_size) of each slot, with members (bucket, slot, first_id, n) put in."""
    mine = members.select("bucket", "slot", "first_id", "n").groupBy("bucket")
    return index.groupBy("bucket").cogroup(mine).applyInArrow(_fold, "digest binary, keep long, group_size long")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("id"), normalised_digest(docs[text_col]).alias("digest"))


def exact_groups(docs: DataFrame, history: Column | None = None, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = 2048) -> DataFrame:
    """(digest, id, m, keep_id, group_size) for each distinct digest and id of `docs`; m counts equal rows.

    `history` marks the rows whose digests make the index; by default half of the ids, so that both the
    member and the nonmember path carry rows. Only digests and ids are shuffled, and counts of a digest
    are combined before each shuffle, so a group of any size costs a row per task. A bucket's index holds
    about `bucket_keys` digests whatever the size of the table.
    """
    if history is None:
        history = held_out(F.col(id_col), 2, 0)
    buckets = max(1, math.ceil(docs.count() / 2 / bucket_keys))
    rows = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("id"), normalised_digest(docs[text_col]).alias("digest"), F.coalesce(history, F.lit(False)).alias("old"))
    # written once: the index, the lookup and the result read it, and texts are digested a single time
    pairs = written(rows.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("m"), F.max("old").alias("old")))
    index = written(build_index(pairs.where("old"), buckets))
    found = written(lookup(_groups(pairs.where("NOT old")), index, buckets))
    slots = fold(index, found.where("slot >= 0"))
    strangers = found.where("slot < 0").select("digest", F.col("first_id").alias("keep"), F.col("n").alias("group_size"))
    return pairs.select("digest", "id", "m").join(slots.unionByName(strangers), "digest")


def exact_dedup(docs: DataFrame, history: Column | None = None, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = 2048) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    g = exact_groups(docs, history, id_col, text_col, bucket_keys)
    each = g.select("*", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("nth"))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return each.select(
        real("id").alias("doc_id"),
        real("keep").alias("keep_id"),
        F.col("group_size"),
        ((F.col("id") == F.col("keep")) & (F.col("nth") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: one per distinct normalised text.

    Texts that occur once stay where they are. Of copies, only the rows that stay are shuffled, as bitmaps of bounded
    size tell which rows may be among them; a list of those, by id and whole digest, decides."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    i, t = (names[docs.columns.index(c)] for c in (id_col, text_col))
    lead, pick = (lambda d: F.xxhash64(d).alias("lead")), (lambda i, d: F.xxhash64(i, d).alias("pick"))
    first = written(exact_groups(docs, id_col=id_col, text_col=text_col).where(F.col("id") == F.col("keep")).select(lead("digest"), pick("id", "digest"), "id", "digest", "group_size"))
    copied = first.where("group_size > 1").select("lead")
    copies = KeySet(copied, copied.count())
    # the first rows of groups, and texts that occur once but that the bitmap takes for copies
    listed = written(copies.inside(first).select("pick", "id", "digest"))
    stay = KeySet(listed, listed.count())
    digest, key_id = normalised_digest(F.col(t)), F.coalesce(F.col(i).cast("long"), F.lit(NO_ID))
    rows = docs.toDF(*names).select(lead(digest), pick(key_id, digest), "*")
    chosen = copies.inside(rows, also=stay).select(*names, key_id.alias("key_id"), digest.alias("key_digest"))
    kept = chosen.join(listed.drop("pick"), (F.col("key_id") == F.col("id")) & (F.col("key_digest") == F.col("digest")), "left_semi")
    # rows equal in id and text: one of them; keyed as the join is, so no further exchange
    out = copies.inside(rows, but=True).select(*names).unionByName(kept.dropDuplicates(["key_id", "key_digest"]).select(*names))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
