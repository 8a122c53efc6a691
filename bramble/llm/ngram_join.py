"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersection of sorted arrays.

A document's set is its distinct `width`-word shingles as 64-bit fingerprints; with fewer words, the whole sequence as one.
Two documents link if 100 * intersection >= percent * union. Equal sets are one node from the start, so copies cost nothing.

Which nodes meet in a tile. Linked sets of sizes a <= b differ in at most k = (100 - percent) / (100 + percent) * (a + b)
shingles. Sizes are cut into bands; each band, and each border between two bands, is a context with a bound on a + b and so on
k. In each context the shingles are dealt by hash into k + 1 + spare slots. A differing shingle spoils one slot at most, so two
linked sets agree in all slots but k. A slot is filed if it has enough shingles. If either set files more slots than can be
spoiled, one in which they agree is among them, and as its content is the same, the other set files it too; a set that files
fewer is dealt again with another seed, and after the last seed files its empty slots too. Sets that agree in no slot can't be
linked: none is lost. Slot keys are shuffled as packed arrays, and each key's nodes are tied to its smallest; that is done
before the shuffle too, so a key that a third of all nodes have reaches its task once for each buffer filled.

From a k of `PAIRED` on, enough is two shingles in the first deal. A slot of one shingle is the same in all sets that have it to
themselves there, so passages that each are in few sets would tie more and more long documents as a table grows, in the end all
of them, and a tied group is compared with the square of its size. Two shared shingles seldom have a slot to themselves.

The first deals leave out frequent shingles, so that a passage in many documents doesn't tie them all; later deals take whole
sets. Leaving the same shingles out of two sets makes them differ in no more than before, so nothing is lost by it whichever
shingles they are. They are found by counting all distinct sets, a task's part at a time, and are at most `FREQUENT_MOST`.

Tiles. Tied nodes form groups. A group of up to `block` nodes and `block_shingles` shingles is a tile; a larger one is cut by
size band and hash into blocks, and pairs of blocks of the same or neighbouring bands are its tiles. In a tile, nodes are
sorted by size; for each, the later ones of fitting size are held against it by the bit count of their bitmaps' difference,
which bounds the intersection from above, and what is left by the exact intersection of the sorted arrays. A tile gives the
components of its nodes and each node's number of links, never the pairs (only pairs() does); where only components are asked
for, nodes that are connected already aren't held against each other. Components of groups that are one tile are done with that.

Fingerprints of 64 bits stand for shingles and sets: among d sets two different ones count as equal with a chance of d^2 / 2^65.

Defined cases: a null text or one without words has an empty set and links with nothing; its component is its own id. Rows
with a null id take part; a component's id is its smallest id that isn't null. Repeated rows are copies. An empty table gives
an empty result. Further columns are not read by components(), and kept by deduplicate().
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .shared import materialize, text_slices
from .words import mix, windows, words_of

#: A band ends at about this times its start.
BAND = 1.41
SEEDS = 3
#: From so large a k on, slots of one shingle aren't filed at first, and of so many percent of k are the slots to spare then.
PAIRED, SPARE = 16, 36
BLOCK, BLOCK_SHINGLES = 2048, 2_000_000
#: Slot keys that a task holds before it hands them on, keys for a part after the shuffle, and partitions, of several parts each if need be.
HELD_KEYS, PARTITION_KEYS, MOST_PARTITIONS = 500_000, 1_000_000, 20_000
#: Slot keys that a task holds after the shuffle before it brings each down to one node.
TIED_KEYS = 4_000_000
#: Links that a task holds before it hands them on, where pairs are asked for, and shingles that are intersected at once.
HELD_LINKS, HELD_SHINGLES = 100_000, 500_000
#: Groups of more than one tile whose band counts are broadcast; more of them are joined.
BROADCAST_GROUPS = 20_000
#: A shingle is frequent if it is in so many sets, of which parts of a task with at least so many count; of more, the most frequent are taken.
FREQUENT, FREQUENT_PART, FREQUENT_MOST = 64, 4, 500_000
#: Shingles of a part, and those of a set that are worked on at once.
PART_SHINGLES, STEP = 2_000_000, 1 << 18
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    h, bounds = words_of(texts, lower=True)
    every = windows(h, width)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            own = every[a : b - width + 1]
            own.sort()  # in place: no other text has any of it
            new = np.ones(len(own), dtype=bool)
            np.not_equal(own[1:], own[:-1], out=new[1:])
            yield own[new]
        elif b > a:
            yield windows(h[a:b], b - a)
        else:
            yield every[:0]


def _steps(x: np.ndarray) -> Iterator[np.ndarray]:
    return (x[at : at + STEP] for at in range(0, len(x), STEP))


def node_of(shingles: np.ndarray) -> np.int64:
    """One 64-bit name for a set."""
    total = np.zeros(1, dtype=np.uint64)
    for x in _steps(shingles):
        total += mix(x ^ _C[0]).sum(dtype=np.uint64)
    return mix(total + np.array([len(shingles)], dtype=np.uint64) * _C[1]).view(np.int64)[0]


@lru_cache(8)
def contexts(percent: int) -> list[tuple[int, int, int]]:
    """(smallest size, largest size, k) of each context: bands, and borders between bands."""
    out, start = [], 1
    while start < 1 << 40:
        end = max(start + 1, int(start * BAND))  # exclusive
        out.append((start, end - 1, (100 - percent) * 2 * (end - 1) // (100 + percent)))
        out.append((-(-percent * end // 100), (end - 1) * 100 // percent, (100 - percent) * (end - 1) // percent))
        start = end
    return out


def _contexts_of(size: int, percent: int) -> list[tuple[int, int]]:
    """(number, k) of the contexts of a size; with k = 0 only equal sets link, which are one node anyway."""
    starts = _starts(percent)
    at = int(np.searchsorted(starts, size, side="right"))
    every = contexts(percent)
    return [(i, every[i][2]) for i in range(max(0, 2 * at - 6), min(len(every), 2 * at + 4)) if every[i][0] <= size <= every[i][1] and every[i][2] > 0]


@lru_cache(8)
def _starts(percent: int) -> np.ndarray:
    return np.array([x[0] for x in contexts(percent)[::2]])


def _deals(k: int) -> tuple[int, list[tuple[int, bool]]]:
    """The number of slots of a context, and of each deal in it how many shingles a slot must have to be filed, and whether it leaves out frequent ones."""
    if k < PAIRED:
        return k + 2 + -(-k // 10), [(1, True), *[(1, False)] * SEEDS]
    return k + 1 + -(-SPARE * k // 100), [(2, True), (1, True), (2, False), (1, False)]


def slot_keys(shingles: np.ndarray, percent: int, frequent: np.ndarray | None = None) -> np.ndarray:
    """The keys under which a set is filed. frequent: sorted shingles that some deals leave out."""
    out, rare, n = [], shingles, len(shingles)
    if frequent is not None and len(frequent):
        rare = np.concatenate([x[frequent[np.minimum(np.searchsorted(frequent, x), len(frequent) - 1)] != x] for x in _steps(shingles)] or [shingles])
    for number, k in _contexts_of(n, percent):
        m, deals = _deals(k)
        # In no more shingles does the set differ from a linked one that it meets in this context.
        apart = min(k, (100 - percent) * (n + min(contexts(percent)[number][1], 100 * n // percent)) // (100 + percent))
        for seed, (least, sparing) in enumerate(deals):
            digest, held = np.zeros(m, dtype=np.uint64), np.zeros(m, dtype=np.int64)
            for x in _steps(rare if sparing else shingles):
                own = mix(x + _C[2] * np.array([seed + 1], dtype=np.uint64))
                slot = ((own >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
                np.add.at(digest, slot, mix(own ^ _C[3]))
                held += np.bincount(slot, minlength=m)
            used = np.flatnonzero(held >= least)
            salt = np.array([number * (SEEDS + 1) + seed + 1], dtype=np.uint64) * _C[0]
            if len(used):
                out.append(mix(digest[used] + used.astype(np.uint64) * _C[1] + salt))
            if len(used) > apart:
                break
        else:
            empty = np.setdiff1d(np.arange(m), used)
            out.append(mix(empty.astype(np.uint64) * _C[2] + salt))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _new(seen: set, node: int) -> bool:
    """Whether a task meets a node for the first time, as far as bounded memory tells."""
    if node in seen:
        return False
    if len(seen) >= 500_000:
        seen.clear()
    seen.add(node)
    return True


def _read(width: int):
    """A row for each text, and beside them, of each part of a task's distinct sets, in how many sets a shingle is."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["n", "node", "shingle", "sets"], [pa.int64()] * 4

        def counts(held: list, kept: list) -> pa.RecordBatch:
            shingles, n = np.unique(np.concatenate(held), return_counts=True)
            many = n >= FREQUENT_PART
            blank = [pa.nulls(int(many.sum()), kind) for _, kind in [*kept, *zip(names[:2], kinds[:2], strict=True)]]
            return pa.RecordBatch.from_arrays([*blank, pa.array(shingles[many].view(np.int64)), pa.array(n[many], pa.int64())], [*(c for c, _ in kept), *names])

        seen: set = set()
        held, size, kept = [], 0, []
        for piece, texts in text_slices(batches, "_text"):
            sets = list(shingle_sets(texts, width))
            nodes = [int(node_of(s)) if len(s) else None for s in sets]
            kept = [(c, k) for c, k in zip(piece.schema.names, piece.schema.types, strict=True) if c != "_text"]
            own = [piece.column(piece.schema.get_field_index(c)) for c, _ in kept]
            yield pa.RecordBatch.from_arrays([*own, pa.array(map(len, sets), pa.int64()), pa.array(nodes, pa.int64()), *(pa.nulls(len(sets), k) for k in kinds[2:])], [*(c for c, _ in kept), *names])
            for node, x in zip(nodes, sets, strict=True):
                if node is None or not _new(seen, node):
                    continue
                if size + len(x) > PART_SHINGLES and len(held) >= FREQUENT_PART:
                    yield counts(held, kept)
                if size + len(x) > PART_SHINGLES:
                    held, size = [], 0
                held.append(x)
                size += len(x)
        if len(held) >= FREQUENT_PART:  # in fewer sets no shingle counts
            yield counts(held, kept)

    return read


def frequent_shingles(counted: DataFrame) -> np.ndarray:
    """Sorted; at most FREQUENT_MOST. counted: shingle and sets, by parts."""
    many = materialize(counted.groupBy("shingle").agg(F.sum("sets").alias("sets")).where(F.col("sets") >= FREQUENT), "frequent")
    if many.count() > FREQUENT_MOST:
        many = many.orderBy(F.desc("sets"), "shingle").limit(FREQUENT_MOST)
    return np.sort(many.select("shingle").toArrow().column(0).to_numpy().view(np.uint64))


def _file(width: int, percent: int, bits: int, frequent: np.ndarray):
    """Packed slot keys and nodes, by partition: the first bits of the key. Each key leaves a buffer once; what else it ties is packed beside."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: list, nodes: list) -> pa.RecordBatch:
            k, n, ties = compact(np.concatenate(keys), np.concatenate(nodes))
            part = (k >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(k), dtype=np.int64)
            parts, first = np.unique(part, return_index=True)
            edges = [*first.tolist(), len(k)]
            packed = [k[a:b].tobytes() + n[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            is_ties = [False] * len(packed)
            if len(ties):  # they need no key any more, so any partition will do
                parts = np.append(parts, int(mix(ties[:1, 1].view(np.uint64))[0] >> np.uint64(64 - bits)) if bits else 0)
                packed.append(ties.T.tobytes())
                is_ties.append(True)
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(is_ties), pa.array(packed, pa.binary())], ["p", "ties", "packed"])

        keys, nodes, held, seen = [], [], 0, set()
        for _, texts in text_slices(batches, "_text"):
            for own in shingle_sets(texts, width):
                if not len(own) or not _new(seen, node := int(node_of(own))):
                    continue
                k = slot_keys(own, percent, frequent)
                keys.append(k)
                nodes.append(np.full(len(k), node, dtype=np.int64))
                held += len(k)
                if held >= HELD_KEYS:
                    yield out(keys, nodes)
                    keys, nodes, held = [], [], 0
        if held:
            yield out(keys, nodes)

    return file


def compact(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, nodes, ties): each key once, ascending, with its smallest node; and that node with each other one of the key, as (ties, 2)."""
    order = np.argsort(keys, kind="stable")
    keys, nodes = keys[order], nodes[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(nodes, first)
    leader = least[np.cumsum(new) - 1]
    other = leader != nodes
    a, b = leader[other], nodes[other]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    once = np.ones(len(a), dtype=bool)
    once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return keys[first], least, np.column_stack((a[once], b[once]))


def _tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(ties: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ties[:, 0], pa.int64()), pa.array(ties[:, 1], pa.int64())], ["a", "b"])

    part, keys, nodes, held, most = None, [], [], 0, TIED_KEYS
    for batch in batches:
        for p, is_ties, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            raw = packed.as_buffer()
            half = raw.size // 2
            first, second = raw.slice(0, half), raw.slice(half)
            if is_ties:
                yield out(np.column_stack((np.frombuffer(first, dtype=np.int64), np.frombuffer(second, dtype=np.int64))))
                continue
            full = held >= most
            if keys and (p != part or full):
                k, n, ties = compact(np.concatenate(keys), np.concatenate(nodes))
                yield out(ties)
                keys, nodes, held = ([k], [n], len(k)) if p == part else ([], [], 0)
                most = max(TIED_KEYS, 2 * held)
            part = p
            keys.append(np.frombuffer(first, dtype=np.uint64).copy())
            nodes.append(np.frombuffer(second, dtype=np.int64).copy())
            held += half // 8
    if keys:
        yield out(compact(np.concatenate(keys), np.concatenate(nodes))[2])


def _tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return graph.contract(_tie(batches))


def _sets(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_slices(batches, "_text"):
            kept = [c for c in piece.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(piece.column(piece.schema.get_field_index(c)) for c in kept), pa.array([s.tobytes() for s in shingle_sets(texts, width)], pa.binary())], [*kept, "shingles"])

    return sets


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 64-bit words for each set, about eight bits for each shingle of the largest."""
    bits = 1 << int(np.clip(np.ceil(np.log2(8 * max(map(len, sets)))), 8, 15))
    out = np.empty((len(sets), bits // 64), dtype=np.uint64)
    row = np.zeros(bits, dtype=bool)
    for i, s in enumerate(sets):
        at = s & np.uint64(bits - 1)
        row[at] = True
        out[i] = np.packbits(row).view(np.uint64)
        row[at] = False
    return out


def _near(maps: np.ndarray, size: np.ndarray, i: int, rest: np.ndarray, percent: int) -> list[int]:
    """Those of rest whose bitmaps let them link with i."""
    both = size[rest] + size[i]
    apart = np.bitwise_count(maps[rest] ^ maps[i]).sum(axis=1, dtype=np.int64)
    need = -(-percent * both // (100 + percent))
    return rest[(both - apart) // 2 >= need].tolist()


def _linked(sets: list[np.ndarray], size: np.ndarray, i: int, near: list[int], percent: int) -> np.ndarray:
    """Those of near that link with i, by the exact intersections of the sorted arrays."""
    out, low = [], 0
    while low < len(near):
        high, held = low, 0
        while high < len(near) and (high == low or held + size[near[high]] <= HELD_SHINGLES):
            held += size[near[high]]
            high += 1
        some = np.array(near[low:high])
        flat = np.concatenate([sets[j] for j in some])
        at = np.searchsorted(sets[i], flat)
        at[at == size[i]] = 0
        common = np.add.reduceat(sets[i][at] == flat, np.cumsum(size[some]) - size[some], dtype=np.int64)
        out.append(some[100 * common >= percent * (size[i] + size[some] - common)])
        low = high
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def compared(nodes: np.ndarray, sets: list[np.ndarray], side: np.ndarray, copies: np.ndarray, percent: int, count: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, roots, links) of the nodes of a tile that link: the smallest node of the component, and with count the copies
    of the nodes that link with it, else 0. side: 0 for a tile of one block, else 1 and 2 for two blocks held against each other."""
    size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    order = np.lexsort((nodes, size))
    nodes, sets, side, copies, size = nodes[order], [sets[i] for i in order], side[order], copies[order], size[order]
    maps, label, links = bitmaps(sets), np.arange(len(sets)), np.zeros(len(sets), dtype=np.int64)
    some = np.zeros(len(sets), dtype=bool)
    for i in range(len(sets) - 1):
        end = int(np.searchsorted(size, size[i] * 100 // percent, side="right"))
        open_ = np.ones(max(0, end - i - 1), dtype=bool) if count else label[i + 1 : end] != label[i]
        if side[i]:
            open_ &= side[i + 1 : end] != side[i]
        rest = np.flatnonzero(open_) + i + 1
        near = _near(maps, size, i, rest, percent) if len(rest) else []
        step = max(1, len(near)) if count else 16  # where only components are asked for, few are intersected before labels are looked at again
        while near:
            now, near = near[:step], near[step:]
            found = _linked(sets, size, i, now, percent)
            if len(found):
                links[i] += copies[found].sum()
                links[found] += copies[i]
                some[i] = some[found] = True
                label[np.isin(label, label[found])] = label[i]
            if not count:
                near = [j for j in near if label[j] != label[i]]
    least = np.full(len(sets), np.iinfo(np.int64).max)
    np.minimum.at(least, label, nodes)
    return nodes[some], least[label[some]], links[some] if count else np.zeros(int(some.sum()), dtype=np.int64)


def every_link(nodes: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> Iterator[np.ndarray]:
    """All links of a tile, as (links, 2) for one node after the other."""
    size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    order = np.lexsort((nodes, size))
    nodes, sets, side, size = nodes[order], [sets[i] for i in order], side[order], size[order]
    maps = bitmaps(sets)
    for i in range(len(sets) - 1):
        rest = np.arange(i + 1, int(np.searchsorted(size, size[i] * 100 // percent, side="right")))
        if side[i]:
            rest = rest[side[rest] != side[i]]
        found = _linked(sets, size, i, _near(maps, size, i, rest, percent), percent) if len(rest) else rest
        if len(found):
            yield np.column_stack((np.full(len(found), nodes[i]), nodes[found]))


def _by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]]:
    """(tile, nodes, sets, sides, copies) of each tile of two nodes or more; rows of a tile follow each other."""

    def out(rows: dict) -> tuple:
        nodes, side, copies = (np.fromiter(x, dtype=np.int64) for x in ((k[0] for k in rows), (k[1] for k in rows), (c for c, _ in rows.values())))
        return tile, nodes, [s for _, s in rows.values()], side, copies

    tile, rows = None, {}
    for batch in batches:
        for t, side, node, copies, packed in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
            if t != tile and len(rows) > 1:
                yield out(rows)
            if t != tile:
                tile, rows = t, {}
            if (node, side) not in rows:  # rows with the same id and text bring it twice
                rows[node, side] = copies, np.frombuffer(packed.as_buffer(), dtype=np.uint64).copy()
    if len(rows) > 1:
        yield out(rows)


def _compare(percent: int, count: bool):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, *own in _by_tile(batches):
            found = compared(*own, percent, count)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in found), pa.array([":" in tile] * len(found[0]), pa.bool_())], ["node", "root", "links", "part"])

    return compare


def _pairs(percent: int):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list) -> pa.RecordBatch:
            found = np.concatenate(held)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0], pa.int64()), pa.array(found[:, 1], pa.int64())], ["a", "b"])

        held, size = [], 0
        for _, nodes, sets, side, _ in _by_tile(batches):
            for found in every_link(nodes, sets, side, percent):
                held.append(found)
                size += len(found)
                if size >= HELD_LINKS:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    return pairs


def _tiles(active: DataFrame, percent: int, block: int, block_shingles: int) -> DataFrame:
    """active (root, node, n, ...) with its tiles: an array of (tile, side) for each node."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent)))).cast("long")
    active = active.withColumn("_band", band)
    counts = active.groupBy("root", "_band").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    blocks = counts.withColumn("b", F.greatest(F.ceil(F.col("c") / block), F.ceil(F.col("s") / block_shingles)).cast("long"))
    groups = blocks.groupBy(F.col("root").alias("_root")).agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.map_from_entries(F.collect_list(F.struct("_band", "b"))).alias("_b"))
    groups = groups.where((F.col("c") > block) | (F.col("s") > block_shingles)).select("_root", "_b")
    # Most groups are one tile and need no counts, so nodes aren't shuffled by group, of which one may hold a third of them.
    large = groups.limit(BROADCAST_GROUPS + 1).toArrow()
    if large.num_rows <= BROADCAST_GROUPS:
        groups = F.broadcast(active.sparkSession.createDataFrame(large, groups.schema))
    joined = active.join(groups, active["root"] == groups["_root"], "left").drop("_root")
    of = lambda b: F.coalesce(F.element_at("_b", b), F.lit(0).cast("long"))
    own = F.pmod(F.xxhash64("node"), of(F.col("_band")))
    seq = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    tile = lambda b, x, c, y: F.concat_ws(":", *(v.cast("string") for v in (F.col("root"), b, x, c, y)))
    here, below, above = F.col("_band"), F.col("_band") - 1, F.col("_band") + 1
    side = lambda k: F.lit(k).alias("side")
    within = F.transform(seq(of(here)), lambda o: F.struct(tile(here, F.least(own, o), here, F.greatest(own, o)).alias("tile"), F.when(own == o, 0).when(own < o, 1).otherwise(2).alias("side")))
    up = F.transform(seq(of(above)), lambda o: F.struct(tile(here, own, above, o).alias("tile"), side(1)))
    down = F.transform(seq(of(below)), lambda o: F.struct(tile(below, o, here, own).alias("tile"), side(2)))
    alone = F.array(F.struct(F.col("root").cast("string").alias("tile"), side(0)))
    return joined.withColumn("_tiles", F.when(F.col("_b").isNull(), alone).otherwise(F.concat(within, up, down))).drop("_b", "_band")


#: A filter of text hashes takes at most 2^27 bits, 16 MB; with more hashes than bits it would let all rows pass and isn't made.
FILTER_BITS, FILTER_PARTS = 27, 6


def _filter_part(bits: int):
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            number = (at >> np.uint64(bits - FILTER_PARTS)).astype(np.int64)
            for k in np.unique(number).tolist():
                flags = own.setdefault(k, np.zeros(1 << (bits - FILTER_PARTS), dtype=bool))
                flags[(at[number == k] & np.uint64(len(flags) - 1)).astype(np.int64)] = True
        for k, flags in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], ["k", "flags"])

    return part


def _pass(flags: np.ndarray, bits: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(batch.schema.get_field_index("_th")).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)
            yield batch.filter(pa.array((flags[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)))

    return keep


def _that_may_match(slim: DataFrame, hashes: DataFrame) -> DataFrame:
    """Rows of slim whose text hash may be among hashes (one column), by a bit filter of bounded size: texts that no group needs aren't shuffled."""
    n = hashes.count()
    if n > 1 << FILTER_BITS:
        return slim
    bits = int(np.clip(np.ceil(np.log2(8 * max(1, n))), FILTER_PARTS + 3, FILTER_BITS))
    part = F.shiftrightunsigned(F.col(hashes.columns[0]), 64 - FILTER_PARTS)
    rows = hashes.repartition(1 << FILTER_PARTS, part).mapInArrow(_filter_part(bits), "k long, flags binary").collect()  # FILTER_PARTS pieces of the filter
    flags = np.zeros(1 << (bits - 3), dtype=np.uint8)
    size = len(flags) >> FILTER_PARTS
    for r in rows:
        flags[r["k"] * size : (r["k"] + 1) * size] |= np.frombuffer(r["flags"], dtype=np.uint8)
    return slim.mapInArrow(_pass(flags, bits), slim.schema)


def _laid(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, block: int, block_shingles: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (_id, _th: the text's hash, n, node), nodes (node, one, n, copies), and the tiles' sets, those of a tile together."""
    if not 75 <= percent <= 100:
        raise ValueError("percent must be 75 to 100")
    kind = dict(docs.dtypes)[id_col]
    slim = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_text"))
    read = materialize(slim.mapInArrow(_read(width), f"_id {kind}, _th long, n long, node long, shingle long, sets long"), "sets")
    named = read.where("shingle IS NULL").drop("shingle", "sets")
    one = F.min(F.struct(F.col("_id").isNull().alias("no"), F.col("_id").alias("id"), F.col("_th").alias("th"))).alias("one")
    nodes = materialize(named.where("node IS NOT NULL").groupBy("node").agg(one, F.first("n").alias("n"), F.count("*").alias("copies")), "nodes")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1.0, total * 0.45 / PARTITION_KEYS)))))
    frequent = frequent_shingles(read.where("shingle IS NOT NULL").select("shingle", "sets"))
    filed = slim.select("_text").mapInArrow(_file(width, percent, bits, frequent), "p long, ties boolean, packed binary")
    ties = graph.settled(filed.repartition(min(1 << bits, MOST_PARTITIONS), "p").sortWithinPartitions("p").mapInArrow(_tied, "u long, v long"))
    active = materialize(nodes.join(ties, "node").select("root", "node", "n", "copies", F.col("one.id").alias("_one"), F.col("one.th").alias("_one_th")), "tied")
    texts = _that_may_match(slim, active.select("_one_th"))
    laid = _tiles(active, percent, block, block_shingles)
    # A merge join at every size: a broadcast would put two Python steps into one task, with a worker each.
    with_text = texts.join(laid.hint("merge"), texts["_id"].eqNullSafe(laid["_one"]) & (texts["_th"] == laid["_one_th"])).select("node", "copies", "_tiles", "_text")
    sets = with_text.mapInArrow(_sets(width), "node long, copies long, _tiles array<struct<tile:string,side:int>>, shingles binary")
    by_tile = sets.select(F.explode("_tiles").alias("t"), "node", "copies", "shingles").select("t.tile", "t.side", "node", "copies", "shingles")
    return named, nodes, by_tile.repartition("tile").sortWithinPartitions("tile")


def _components(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, block: int, block_shingles: int, count: bool) -> DataFrame:
    """_id, _th (the text's hash), n, component, n_links, and of non-empty sets first: the id and text hash that come first in the component, ids before nulls."""
    named, nodes, laid = _laid(docs, id_col, text_col, width, percent, block, block_shingles)
    found = materialize(laid.mapInArrow(_compare(percent, count), "node long, root long, links long, part boolean"), "links")
    by_node = found.groupBy("node").agg(F.min("root").alias("root"), F.sum("links").alias("links"))
    parts = found.where("part")
    if not parts.isEmpty():
        whole = graph.components(parts, "node", "root").withColumnRenamed("root", "_whole")
        by_node = by_node.join(whole, "node", "left").select("node", F.coalesce("_whole", "root").alias("root"), "links")
    # Nodes that are one document and link with nothing need no more.
    more = nodes.join(by_node, "node", "left").where("copies > 1 OR root IS NOT NULL")
    more = materialize(more.select("node", "one", F.coalesce("root", "node").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")), "linked")
    first = more.groupBy(F.col("root").alias("_root")).agg(F.min("one").alias("first"))
    known = more.join(first, more["root"] == first["_root"]).select(F.col("node").alias("_node"), "first", "links")
    out = named.join(known, named["node"] == known["_node"], "left")
    own = F.when(F.col("node").isNotNull(), F.struct(F.col("_id").isNull().alias("no"), F.col("_id").alias("id"), F.col("_th").alias("th")))
    return out.select("_id", "_th", "n", F.when(F.col("_node").isNull(), F.col("_id")).otherwise(F.col("first.id")).alias("component"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("first", own).alias("first"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """A row for each document: _id, n (the size of its set), component (the smallest id it is connected with) and n_links,
    the number of other rows that it links with, copies among them."""
    return _components(docs, id_col, text_col, width, percent, block, block_shingles, True).select("_id", "n", "component", "n_links")


def pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> tuple[DataFrame, DataFrame]:
    """All links: members (_id, n, node: null for an empty set), a row for each document, and linked (a, b), each pair of linked nodes once.

    Documents of one node are linked too. Their number grows with the square of a group's size: components() counts them without giving them.
    """
    named, _, laid = _laid(docs, id_col, text_col, width, percent, block, block_shingles)
    return named.select("_id", "n", "node"), materialize(laid.mapInArrow(_pairs(percent), "a long, b long"), "links")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, of which one of each component stays: that with the smallest id, nulls last.

    Of rows with equal id and text one stays; of rows with equal id and other texts in one component, one by the texts' hashes.
    Documents with an empty set all stay.
    """
    found = materialize(_components(docs, id_col, text_col, width, percent, BLOCK, BLOCK_SHINGLES, False).where("n > 0").groupBy("_id", "_th", "first").count(), "found")
    goes = ~(F.col("_id").eqNullSafe(F.col("first.id")) & (F.col("_th") == F.col("first.th")))
    same = lambda rows, keys: rows[id_col].eqNullSafe(keys["_id"]) & (F.xxhash64(rows[text_col]) == keys["_th"])
    gone = found.where(goes).select("_id", "_th")
    out = docs.join(gone, same(docs, gone), "left_anti")
    twice = found.where(~goes & (F.col("count") > 1)).select("_id", "_th")
    if twice.isEmpty():
        return out
    return out.join(twice, same(out, twice), "left_anti").unionByName(out.join(twice, same(out, twice), "left_semi").dropDuplicates([id_col, text_col]))
