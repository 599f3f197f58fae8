"""SimHash near-dedup by meet-in-the-middle ball hashing.

A fingerprint's bit is the majority bit of the XXH64 hashes of its shingles. To find every pair within a
radius r, each distinct fingerprint emits all variants within r/2 bits of itself; two fingerprints within r
share a variant. Rows are shuffled on variants, and those of a variant are chained and verified.

Defined results: null, empty and wordless texts have fingerprint zero, which links like any other; equal
texts share a fingerprint; a null id sorts after every other and never names a component that holds
another id; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perigee.llm.components import connected_components
from perigee.llm.shared import LOWER, KeySet, bytes_of, materialize, mix, only_one, written
from perigee.llm.similar_sets import packed, similar_components

NO_ID = (1 << 63) - 1
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15
#: Bits by which fingerprints of likely near copies differ at most: with one half of 32 bits within 2.
HALVES_RADIUS = 5
#: Fingerprints before it that one is compared with, in each variant; and pairs of it that are given out.
COMPARED = 4


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle, repeats included; of the whole sequence if it is shorter."""
    w = text.translate(LOWER).split()
    if not w:
        return np.zeros(0, "<u8")
    s = map(b" ".join, zip(*(w[i:] for i in range(k)), strict=False)) if len(w) > k else [b" ".join(w)]
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, s, repeat(42))), ">u8").astype("<u8")


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have set."""
    if not len(h):
        return 0
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), BLOCK):
        total += np.unpackbits(h[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(total * 2 > len(h)).tobytes(), "little")


def fingerprints(h: np.ndarray, words: int) -> list[int]:
    """`words` fingerprints of 64 bits; the first from the hashes as they are, the others from remixed ones."""
    return [majority(h if j == 0 else mix(h + np.uint64(j * 0x9E3779B97F4A7C15 & (1 << 64) - 1))) for j in range(words)]


def _fingerprinter(k: int, words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [fingerprints(shingle_hashes(t, k), words) for t in bytes_of(b.column(1))]
            flat = np.array(out, "<u8").view("<i8").reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, words, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["id", "fps"])

    return run


def sketch(docs: DataFrame, shingle: int, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fps) per row; fps is an array of `words` 64-bit fingerprints."""
    rows = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("id"), docs[text_col].cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprinter(shingle, words), "id long, fps array<long>")


def ball(value: Column, bits: int, half: int) -> Column:
    """The values within `half` (0 to 2) bits of a value of `bits` bits."""
    out = F.array(value)
    one = F.lit(1).cast("long")
    flip = lambda i: F.expr("shiftleft(1L, 0)") * 0 + F.call_function("shiftleft", one, i)
    if half >= 1:
        out = F.concat(out, F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: value.bitwiseXOR(flip(i))))
    if half >= 2:
        pairs = [(1 << i) | (1 << j) for i in range(bits) for j in range(i)]
        masks = F.array(*[F.lit(p - (1 << 64) if p >> 63 else p) for p in pairs])
        out = F.concat(out, F.transform(masks, lambda m: value.bitwiseXOR(m)))
    return out


def ball_links(fps: DataFrame, radius: int, bits: int = 64) -> DataFrame:
    """Links (a, b) that join all distinct values of column fp within `radius` bits of each other.

    Members of a variant lie within the radius of each other when it is even; there are `bits` + 1 of them
    at most (half a radius of 1), so no group is large however many copies a text has. A chain through each
    group joins it; for an odd radius the links are verified, and the chain runs from the variant's own centre.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    near = fps.select("fp").distinct().select("fp", F.explode(ball(F.col("fp"), bits, radius // 2)).alias("variant"))
    w = Window.partitionBy("variant").orderBy("fp")
    chained = near.select("fp", F.lag("fp").over(w).alias("before")).where("before IS NOT NULL").select(F.col("before").alias("a"), F.col("fp").alias("b")).distinct()
    return chained.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def half_ball_links(fps: DataFrame, radius: int = HALVES_RADIUS, compared: int = COMPARED) -> DataFrame:
    """Links (a, b), a the smaller, of distinct values of column fp that differ in `radius` bits (5 at most).

    One half of 32 bits of such a pair lies within 2 bits, so the two share a variant of that half. Here the members
    of a variant may differ in the other half, so each is compared with the `compared` before it, on all bits. Of each
    value come as many links, those of the fewest bits, so a large group of close values gives a few links for each.
    A value of `compared` neighbours at most, in each variant and in all, gets all its links; those that others
    don't get are left to the caller.
    """
    if radius > HALVES_RADIUS:
        raise ValueError(f"the radius must be {HALVES_RADIUS} at most")
    low, high = F.col("fp").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned("fp", 32)
    of_high = F.transform(ball(high, 32, 1), lambda x: x.bitwiseOR(F.lit(1 << 32)))
    near = fps.select("fp").distinct().select("fp", F.explode(F.concat(ball(low, 32, 1), of_high)).alias("variant"))
    w = Window.partitionBy("variant").orderBy("fp")
    before = near.select("fp", F.array(*[F.lag("fp", i).over(w) for i in range(1, compared + 1)]).alias("before"))
    within = F.filter("before", lambda x: F.bit_count(x.bitwiseXOR(F.col("fp"))) <= radius)
    found = before.select(F.col("fp").alias("b"), F.explode(within).alias("a"))
    closest = F.array_sort(F.collect_set(F.struct(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("off"), "a")))
    return found.groupBy("b").agg(F.slice(closest, 1, compared).alias("links")).select(F.explode("links").alias("x"), "b").select("x.a", "b")


def likely_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of different nodes of the rows (node, fp): the least node of a fingerprint with its others, and
    with the least ones of the fingerprints about it."""
    rows = rows.select("fp", "node").distinct()
    least = written(rows.groupBy("fp").agg(F.min("node").alias("least")))
    x, y = (least.select(F.col("fp").alias(n), F.col("least").alias(f"of_{n}")) for n in "ab")
    linked = half_ball_links(least).join(x, "a").join(y, "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    pairs = rows.join(least, "fp").select(F.col("least").alias("a"), F.col("node").alias("b")).unionByName(linked)
    return pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) per row: components of fingerprints within `radius` bits."""
    rows = materialize(sketch(docs, shingle, 1, id_col, text_col).select("id", F.col("fps")[0].alias("fp")))
    roots = connected_components(ball_links(rows, radius))
    ids = rows.groupBy("fp").agg(F.min("id").alias("first_id"))
    rooted = ids.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component"))
    labels = rooted.select("fp", "root").join(least, "root").select("fp", "component")
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return rows.join(labels, "fp").select(real("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), real("component").alias("component_id"))


def flips_at(similarity: float) -> float:
    """The share of differing bits at a Jaccard similarity of equally large shingle sets."""
    cos = 2 * similarity / (1 + similarity)
    return math.acos(min(1.0, cos)) / math.pi


def _set_maker(k: int, sketched: bool = False) -> Callable:
    """(id, text_hash, text) to (id, text_hash, node, hashes): distinct shingle hashes, sorted, and a name made of
    them; texts without words are left out. With `sketched` the fingerprint, fp, stands in place of the hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_one("sets")
        for b in batches:
            sets, fps = [], []
            for t in bytes_of(b.column(2)):
                h = shingle_hashes(t, k)
                sets.append(packed(h))
                if sketched:
                    fps.append(majority(h))
            names = np.array([xxhash.xxh3_64_intdigest(s) for s in sets], "<u8").view("<i8")
            last = pa.array(np.array(fps, "<u8").view("<i8")) if sketched else pa.array(sets, pa.binary())
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names), last], names=["id", "text_hash", "node", "fp" if sketched else "hashes"])
            yield out.filter(pa.array([len(s) > 0 for s in sets], pa.bool_()))

    return run


def drop_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: the least id of each group of near copies.

    Groups are the components of all pairs whose distinct shingles have the Jaccard similarity at least. Pairs come
    from fingerprints about each other, by ball hashing, and are verified on the whole sets; a pair of the similarity
    may differ in more bits, so pairs that these links don't join yet are then found by a prefix filter. A
    row is dropped by its id and text, so another row of its id stays; of one id's near copies one text stays. Rows
    of a null id are never dropped; texts without words are left alone.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    i, t = (names[docs.columns.index(c)] for c in (id_col, text_col))
    mine = docs.toDF(*names)
    text = docs[text_col].cast("binary")
    texts = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    rows = written(texts.mapInArrow(_set_maker(shingle, sketched=True), "id long, text_hash long, node long, fp long"))
    roots = similar_components(rows, texts, _set_maker(shingle), similarity, likely=likely_pairs(rows))
    whole = rows.join(roots, "node", "left").select("id", "text_hash", F.coalesce("root", "node").alias("root"))
    least = whole.groupBy("root").agg(F.min(F.struct("id", "text_hash")).alias("least"), F.max(F.struct("id", "text_hash")).alias("most")).where("least != most")
    gone = written(whole.join(least, "root").where((F.struct("id", "text_hash") != F.col("least")) & (F.col("id") != NO_ID)).select("id", "text_hash").distinct())
    # only texts that a bitmap of bounded size takes for dropped ones are shuffled
    dropped = KeySet(gone.select("text_hash"), gone.count())
    keyed = mine.select(F.xxhash64(F.col(t).cast("binary")).alias("key_hash"), "*")
    same = (F.col(i).cast("long") == gone["id"]) & (F.col("key_hash") == gone["text_hash"])
    out = dropped.inside(keyed, but=True).select(*names).unionByName(dropped.inside(keyed).join(gone, same, "left_anti").select(*names))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
