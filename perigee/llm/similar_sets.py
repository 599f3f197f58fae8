"""Every pair of sets whose Jaccard similarity reaches a bound, by prefix filtering, as links that join them.

All hashes have one order: rare ones first (by a table of counts, then by value; any order is right, this one
keeps groups small). Of two sets that reach the bound, the first common hash lies among the first
n - ceil(bound * n) + 1 of both, so sets that meet in no such hash need no test. Members of a hash's group are
tested with their `WINDOW` neighbours; of a larger group all pairs that no chain of links has joined yet are then
compared in blocks, by bits that tell how much two sets differ at least. Each link is verified on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.llm.components import connected_components
from perigee.llm.shared import written

#: Counters of the order's table, by a hash's leading bits, and those of one row on the wire.
COUNTER_BITS = 20
COUNTERS_SENT = 1 << 14
#: Neighbours that a member is tested with; a group of one more is whole after that.
WINDOW = 16
#: Members of a large group that meet in one task, on either side.
BLOCK = 4096
#: Bits by which they are compared.
BITS = 2048
#: Rounds at most in which each member offers its likeliest pair before all are tested.
BEST_ROUNDS = 5
#: Nodes up to which their list is broadcast, to fetch their sets without a shuffle of all.
BROADCAST_NODES = 1_000_000


#: Leading bytes of a hash that sets are made of: of two sets of a thousand, unequal members of either meet in them
#: once in a million pairs, and it counts only at the very bound.
SENT = 5


def packed(h: np.ndarray) -> bytes:
    """The distinct hashes by their leading bytes, sorted."""
    return np.unique(h >> np.uint64(64 - 8 * SENT)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SENT].tobytes()


def _hashes(col: pa.Array) -> list[np.ndarray]:
    out = []
    for x in col.to_pylist():
        wide = np.zeros((len(x) // SENT, 8), np.uint8)
        wide[:, 8 - SENT :] = np.frombuffer(x, np.uint8).reshape(-1, SENT)
        out.append(wide.reshape(-1).view("<u8"))
    return out


def then(make: Callable, step: Callable) -> Callable:
    """A function of batches that goes on with another of each batch, in one Python process."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(step, make(batches))

    return run


def _chained(make: Callable, step: Callable) -> Callable:
    return lambda batches: step(b.select(["node", "hashes"]) for b in make(batches))


def reaches(common: np.ndarray | int, total: np.ndarray | int, bound: float) -> np.ndarray | bool:
    """Whether sets of `total` members together, `common` of them in both, have the similarity."""
    return common >= bound * (total - common) - 1e-9


def prefix_length(n: int, bound: float) -> int:
    return n - math.ceil(bound * n - 1e-9) + 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << COUNTER_BITS, np.int64)
    for b in batches:
        sets = _hashes(b.column(1))
        if sets:
            total += np.bincount((np.concatenate(sets) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), minlength=len(total))
    parts = total.reshape(-1, COUNTERS_SENT)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array([_planes(p) for p in parts], pa.binary())], names=["part", "counts"])


def _planes(counts: np.ndarray) -> bytes:
    """Low bytes first, then the next ones: most counts are small, so most of it is zeros."""
    return np.ascontiguousarray(np.minimum(counts, (1 << 32) - 1).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _add(key: tuple, t: pa.Table) -> pa.Table:
    total = np.zeros(COUNTERS_SENT, np.int64)
    for x in t["counts"].to_pylist():
        total += _from_planes(x)
    return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "counts": pa.array([_planes(total)], pa.binary())})


def counters(texts: DataFrame, make: Callable) -> np.ndarray:
    """How often hashes with the same leading bits occur; of a fixed size."""
    kind = "part long, counts binary"
    out = np.zeros(1 << COUNTER_BITS, np.int64)
    for r in texts.mapInArrow(_chained(make, _count), kind).groupBy("part").applyInArrow(_add, kind).toLocalIterator():
        out[r["part"] * COUNTERS_SENT : (r["part"] + 1) * COUNTERS_SENT] = _from_planes(bytes(r["counts"]))
    return out


def _prefixes(shared, bound: float) -> Callable:
    """A row per hash of a set's prefix, with the set's size and the hash's place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for b in batches:
            h, nodes, sizes, places = [], [], [], []
            for node, s in zip(b.column(0).to_pylist(), _hashes(b.column(1)), strict=True):
                p = prefix_length(len(s), bound)
                h.append(s[np.lexsort((s, often[(s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]))[:p]])
                nodes.append(np.full(p, node, np.int64))
                sizes.append(np.full(p, len(s), np.int32))
                places.append(np.arange(p, dtype=np.int32))
            if h:
                cols = [np.concatenate(h).view("<i8"), *map(np.concatenate, (nodes, sizes, places))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["hash", "node", "size", "place"])

    return run


def _neighbours(bound: float, window: int) -> Callable:
    """Of rows sorted by hash and node: pairs (a, b) to test, and the members (a, hash) of groups beyond the window."""

    def some(held: list[np.ndarray], old: int) -> Iterator[pa.RecordBatch]:
        h, node, size, place = held
        pairs = []
        beyond = np.zeros(len(h), bool)
        for d in range(1, window + 2):
            at = np.flatnonzero(h[d:] == h[:-d]) + d
            at = at[at >= old]
            if d > window:
                for back in range(d + 1):
                    beyond[at - back] = True
                break
            left = np.minimum(size[at] - place[at], size[at - d] - place[at - d])
            at = at[reaches(left, size[at] + size[at - d], bound)]
            pairs.append(np.stack([node[at - d], node[at]], axis=1))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        many = np.flatnonzero(beyond)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([pairs[:, 0], node[many]])), pa.array(np.concatenate([pairs[:, 1], node[many]])), pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(h[many])])], names=["a", "b", "hash"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)]
        new, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal before, new, n
            held = [np.concatenate([before[i], *(x[i] for x in new)]) for i in range(4)]
            again = np.flatnonzero((held[0][1:] == held[0][:-1]) & (held[1][1:] == held[1][:-1])) + 1  # rows of one set
            held = [np.delete(x, again) for x in held]
            yield from some(held, len(before[0]))
            before, new, n = [x[-window - 1 :] for x in held], [], 0

        for b in batches:
            if b.num_rows:
                new.append([b.column(i).to_numpy() for i in range(4)])
                n += b.num_rows
                if n > 100_000:
                    yield from flush()
        if n:
            yield from flush()

    return run


def _verify(bound: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = _hashes(b.column(2)), _hashes(b.column(3))
            good = [bool(reaches(len(np.intersect1d(p, q, assume_unique=True)), len(p) + len(q), bound)) for p, q in zip(x, y, strict=True)]
            yield b.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return run


def parity(h: np.ndarray) -> bytes:
    """For each of BITS classes of hashes, whether a set holds an odd number of it. Of two sets, as many bits differ
    as there are hashes in one alone, or fewer."""
    return np.packbits(np.bincount(((h >> np.uint64(40)) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).tobytes()


def _parities(make: Callable) -> Callable:
    def step(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = _hashes(b.column(3))
        return pa.RecordBatch.from_arrays([b.column(2), pa.array([len(x) for x in sets], pa.int32()), pa.array([parity(x) for x in sets], pa.binary())], names=["node", "size", "bits"])

    return then(make, step)


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bits differ between each row of x and each of y (rows of 64-bit words)."""
    out = np.zeros((len(x), len(y)), np.int32)
    for i in range(0, len(x), 32):
        out[i : i + 32] = np.bitwise_count(x[i : i + 32, None, :] ^ y[None, :, :]).sum(axis=2, dtype=np.int32)
    return out


def _block_pairs(bound: float, best: bool) -> Callable:
    """Pairs of a member on the left and one on the right that lie in different components and may reach the bound;
    with `best`, of each left one the pair of the fewest differing bits."""
    most = (1 - bound) / (1 + bound)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        side = t["side"].to_numpy()
        left, right = t.filter(pa.array(side == 0)), t.filter(pa.array(side == 1))
        a = b = np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            x, y = (np.frombuffer(b"".join(z["bits"].to_pylist()), "<u8").reshape(-1, BITS // 64) for z in (left, right))
            off = differing(x, y)
            n, m = (z["size"].to_numpy().astype(np.float32) for z in (left, right))
            roots = right["root"].to_numpy()
            may = (off <= most * np.add.outer(n, m) + 1e-3) & (left["root"].to_numpy()[:, None] != roots[None, :])
            may &= np.minimum.outer(n, m) >= bound * np.maximum.outer(n, m) - 1e-3
            if best:
                i = np.flatnonzero(may.any(axis=1))
                j = np.where(may[i], off[i], BITS + 1).argmin(axis=1) if len(i) else i
            else:
                i, j = np.nonzero(may)
            a, b = left["node"].to_numpy()[i], right["node"].to_numpy()[j]
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return run


def _made_of(keys: DataFrame, texts: DataFrame, nodes: DataFrame, step: Callable, kind: str) -> DataFrame:
    """What `step` makes of one text of each of the nodes listed, a row (node, ...) per node."""
    wanted = written(keys.join(nodes.distinct(), "node").groupBy("node").agg(F.min("text_hash").alias("text_hash")).select("text_hash"))
    if wanted.count() <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    chosen = texts.join(wanted, "text_hash", "left_semi").select("id", "text_hash", "text")
    return chosen.mapInArrow(step, kind).dropDuplicates(["node"])


def _large_group_pairs(members: DataFrame, parities: DataFrame, roots: DataFrame, bound: float, block: int, best: bool) -> DataFrame:
    """Pairs of members (hash, node) of a group that lie in different components and may reach the bound, by the
    bits of `parities` (node, size, bits).

    Of such a pair one at least is outside the group's largest component; those meet all members, in blocks, so a
    group of near copies that is joined but for a few costs its size times those few. What meets is a row of bits,
    not a set. Hashes with the same members are one group.
    """
    labelled = written(members.join(roots, "node", "left").select("hash", "node", F.coalesce("root", "node").alias("root")))
    groups = labelled.groupBy("hash", "root").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    groups = groups.groupBy("hash").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.max(F.struct("n", "root")).alias("most"))
    groups = groups.groupBy("n", "x", "y").agg(F.min("hash").alias("hash"), F.min("most").alias("most")).where("most.n < n")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(block))).cast("int")
    groups = groups.select("hash", F.col("most.root").alias("largest"), blocks(F.col("n") - F.col("most.n")).alias("nl"), blocks(F.col("n")).alias("nr"))
    mine = labelled.join(groups, "hash").withColumn("own", F.xxhash64("node", F.lit(2))).join(parities, "node")
    spread = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at = lambda n: F.array(F.pmod("own", F.col(n)).cast("int"))
    place = lambda side, i, j: F.transform(F.arrays_zip(i.alias("i"), j.alias("j")), lambda p: F.struct(F.lit(side).alias("side"), p["i"].alias("i"), p["j"].alias("j")))
    left = place(0, F.array_repeat(F.element_at(at("nl"), 1), F.col("nr")), spread("nr"))
    right = place(1, spread("nl"), F.array_repeat(F.element_at(at("nr"), 1), F.col("nl")))
    places = F.when(F.col("root") != F.col("largest"), F.concat(left, right)).otherwise(right)
    placed = mine.select("hash", "node", "root", "size", "bits", F.explode(places).alias("p")).select("hash", "node", "root", "size", "bits", "p.side", "p.i", "p.j")
    return placed.groupBy("hash", "i", "j").applyInArrow(_block_pairs(bound, best), "a long, b long").distinct()


def _apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs (a, b) that no link joins, neither their own nor two to one node, the least that either is linked to."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m")))
    x, y = (least.select(F.col("node").alias(n), F.col("m").alias(f"of_{n}")) for n in "ab")
    return pairs.join(x, "a", "left").join(y, "b", "left").where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def similar_components(keys: DataFrame, texts: DataFrame, make: Callable, bound: float, window: int = WINDOW, block: int = BLOCK, likely: DataFrame | None = None) -> DataFrame:
    """(node, root) of the nodes that a link joins to another; root is the least node of the component.

    Pairs (a, b) of `likely` are verified first; of the others only those that these links don't join yet are.

    make turns batches of texts (id, text_hash, text) into (id, text_hash, node, hashes): a set's name and its packed
    hashes; sets are made again for each use, as they take more room than the texts. keys has the (node, text_hash)
    of all.
    """
    shared = keys.sparkSession.sparkContext.broadcast(counters(texts, make))
    prefixes = texts.mapInArrow(_chained(make, _prefixes(shared, bound)), "hash long, node long, size int, place int")
    dealt = prefixes.repartition("hash").sortWithinPartitions("hash", "node")
    found = written(dealt.mapInArrow(_neighbours(bound, window), "a long, b long, hash long"))
    shared.unpersist()

    def verified(pairs: DataFrame) -> DataFrame:
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node"))
        sets = _made_of(keys, texts, nodes, then(make, lambda b: b.select([2, 3])), "node long, hashes binary")
        x, y = (sets.select(F.col("node").alias(n), F.col("hashes").alias(f"of_{n}")) for n in "ab")
        wide = pairs.join(x, "a").join(y, "b").select("a", "b", "of_a", "of_b")
        return written(wide.mapInArrow(_verify(bound), "a long, b long"))

    pairs = found.where("hash IS NULL").select("a", "b").distinct()
    if likely is None:
        links = verified(written(pairs))
    else:
        links = verified(written(likely))
        links = links.unionByName(verified(written(_apart(pairs, links))))
    roots = connected_components(links)
    members = written(found.where("hash IS NOT NULL").select("hash", F.col("a").alias("node")).distinct())
    if members.isEmpty():
        return roots
    parities = written(_made_of(keys, texts, members.select("node"), _parities(make), "node long, size int, bits binary"))
    # first the likeliest pair of each member, again while that joins components; then all pairs that are left between
    # components, which only the bits that two differences share let through
    for _ in range(BEST_ROUNDS):
        more = verified(written(_large_group_pairs(members, parities, roots, bound, block, True)))
        if more.isEmpty():
            break
        links = links.unionByName(more)
        roots = connected_components(links)
    more = verified(written(_large_group_pairs(members, parities, roots, bound, block, False)))
    return roots if more.isEmpty() else connected_components(links.unionByName(more))
