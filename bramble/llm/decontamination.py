"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

A window is `width` consecutive words of an item; an item with fewer words, but some, is one window. A window occurs where
its words stand one after another in a document, and then those document words are hit.

All shingles of a window must be in a document that holds it, so a prefix of one shingle is enough if it is the rarest:
a first pass over the documents counts in how many of them each item shingle occurs, and each window is filed under its
rarest shingle. A second pass looks up the documents' shingles; the place of a match within the window gives the place of
the window, which must lie inside the document (length and position), and all its words are then compared.

Windows are made and told apart in Spark and dealt by hash into blocks of about `block_windows`; the driver holds one block at
a time, whose index is broadcast, and more items mean more passes over the documents. What the blocks find is put together
before anything is decided, so no result depends on their size.

Defined cases: null texts have no words; an item without words has no window; items with a null id mark words as hit but
aren't counted among the items; repeated items count once; repeated documents give repeated rows; an empty benchmark hits
nothing. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, text_slices
from .words import ALPHA, windows, words_of

#: Words of a shingle, fewer in shorter windows.
SHINGLE = 4
#: Windows of one broadcast block: with 10 words each, 16 MB of fingerprints.
BLOCK_WINDOWS = 200_000
#: Places in texts and windows that are compared at once.
PAIRS = 50_000
_BITS = 20


@dataclass
class Index:
    """Windows of equal length, each filed under one of its shingles."""

    size: int  # words of a window
    shingle: int  # words of a shingle
    words: np.ndarray  # (windows, size)
    items: list[list[str]]  # ids of the items that have each window
    keys: np.ndarray  # shingles under which windows are filed, sorted
    first: np.ndarray  # of each key, its first place in filed; one more at the end
    filed: np.ndarray  # windows, by key
    offset: np.ndarray  # of each window, the place of its key
    hint: np.ndarray  # whether any key has these low bits


def _hint(keys: np.ndarray) -> np.ndarray:
    hint = np.zeros(1 << _BITS, dtype=bool)
    hint[keys & np.uint64((1 << _BITS) - 1)] = True
    return hint


def _found(values: np.ndarray, keys: np.ndarray, hint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in values that hold a key, and the keys' numbers."""
    at = np.flatnonzero(hint[values & np.uint64((1 << _BITS) - 1)])
    number = np.searchsorted(keys, values[at])
    number[number == len(keys)] = 0
    good = keys[number] == values[at]
    return at[good], number[good]


def _item_windows(width: int):
    """Each window of each item: its length, its words' fingerprints and the item's id as text."""

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_slices(batches, "_text"):
            h, bounds = words_of(texts, ALPHA, lower=True)
            ids = piece.column(piece.schema.get_field_index("_item")).to_pylist()
            for item, start, end in zip(ids, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                size = min(width, end - start)
                if not size:
                    continue
                own = {h[i : i + size].tobytes() for i in range(start, end - size + 1)}
                yield pa.RecordBatch.from_arrays([pa.array([size] * len(own), pa.int32()), pa.array(sorted(own), pa.binary()), pa.array([item] * len(own), pa.string())], ["size", "words", "item"])

    return item_windows


def benchmark_windows(benchmark: DataFrame, width: int, item_col: str = "item_id", item_text_col: str = "text", block_windows: int = BLOCK_WINDOWS) -> tuple[DataFrame, int]:
    """The distinct windows (size, words, items: the ids that have it, block), written once, and the number of blocks."""
    slim = benchmark.select(F.col(item_col).cast("string").alias("_item"), F.col(item_text_col).alias("_text"))
    every = slim.mapInArrow(_item_windows(width), "size int, words binary, item string")
    told = materialize(every.groupBy("size", "words").agg(F.array_sort(F.collect_set("item")).alias("items")), "windows")
    blocks = -(-told.count() // block_windows)
    return told.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(max(1, blocks)))), blocks


Block = list[tuple[int, np.ndarray, list[list[str]]]]


def _block(told: DataFrame, number: int) -> Block:
    """A block's windows by length: rows of word fingerprints, and the ids of the items of each."""
    own = told.where(F.col("block") == number).select("size", "words", "items").toArrow()
    size = own.column("size").to_numpy()
    out = []
    for k in np.unique(size).tolist():
        some = own.filter(pa.array(size == k)).sort_by("words")
        out.append((k, np.frombuffer(b"".join(some.column("words").to_pylist()), dtype=np.uint64).reshape(-1, k), some.column("items").to_pylist()))
    return out


def _shingles(words: np.ndarray, shingle: int) -> np.ndarray:
    """(windows, places): the shingles of each window."""
    n, size = words.shape
    every = windows(words.reshape(-1), shingle)
    return np.lib.stride_tricks.as_strided(np.append(every, np.zeros(size, dtype=np.uint64)), (n, size - shingle + 1), (8 * size, 8)).copy()


def _count(vocabularies: dict[int, np.ndarray], text_col: str):
    """In how many of a task's documents each item shingle occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hints = {k: _hint(v) for k, v in vocabularies.items()}
        totals = {k: np.zeros(len(v), dtype=np.int64) for k, v in vocabularies.items()}
        for _, texts in text_slices(batches, text_col):
            h, bounds = words_of(texts, ALPHA, lower=True)
            for k, keys in vocabularies.items():
                at, number = _found(windows(h, k), keys, hints[k])
                doc = np.searchsorted(bounds, at, side="right") - 1
                whole = at + k <= bounds[doc + 1]
                pairs = np.unique(doc[whole] * len(keys) + number[whole])
                totals[k] += np.bincount(pairs % len(keys), minlength=len(keys))
        for k, keys in vocabularies.items():
            some = np.flatnonzero(totals[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k), pa.int32()), pa.array(keys[some].view(np.int64)), pa.array(totals[k][some])], ["size", "shingle", "docs"])

    return count


def _index(block: Block, rarity: dict[int, tuple[np.ndarray, np.ndarray]]) -> list[Index]:
    out = []
    for size, words, items in block:
        k = min(SHINGLE, size)
        grid = _shingles(words, k)
        keys, docs = rarity.get(k, (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)))
        if not len(keys):
            continue  # no document has any of these shingles
        place = np.minimum(np.searchsorted(keys, grid), len(keys) - 1)
        seen = np.where(keys[place] == grid, docs[place], 0)
        offset = seen.argmin(axis=1)
        possible = seen[np.arange(len(grid)), offset] > 0  # a shingle that no document has rules its window out
        words, grid, offset, items = words[possible], grid[possible], offset[possible], [x for x, ok in zip(items, possible, strict=True) if ok]
        if not len(words):
            continue
        own = grid[np.arange(len(grid)), offset]
        order = np.argsort(own, kind="stable")
        used, first = np.unique(own[order], return_index=True)
        out.append(Index(size, k, words, items, used, np.append(first, len(order)), order, offset, _hint(used)))
    return out


def _search(indexes: list[Index], text_col: str):
    """n_words, the hit runs of words (starts and ends) and the ids of the occurring items, beside the id column."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_slices(batches, text_col):
            h, bounds = words_of(texts, ALPHA, lower=True)
            n = len(texts)
            ids: list[set] = [set() for _ in range(n)]
            delta = np.zeros(len(h) + 1, dtype=np.int64)
            for index in indexes:
                at, number = _found(windows(h, index.shingle), index.keys, index.hint)
                many = index.first[number + 1] - index.first[number]
                last = np.cumsum(many)
                # Each place with each window filed under its shingle, however many share one, in steps of bounded size.
                for low in range(0, int(many.sum()), PAIRS):
                    pair = np.arange(low, min(low + PAIRS, int(last[-1])))
                    place = np.searchsorted(last, pair, side="right")
                    window = index.filed[index.first[number[place]] + pair - (last - many)[place]]
                    start = at[place] - index.offset[window]
                    doc = np.searchsorted(bounds, at[place], side="right") - 1
                    fits = (start >= bounds[doc]) & (start + index.size <= bounds[doc + 1])
                    window, start, doc = window[fits], start[fits], doc[fits]
                    equal = np.ones(len(start), dtype=bool)
                    for i in range(index.size):
                        equal &= h[start + i] == index.words[window, i]
                    np.add.at(delta, start[equal], 1)
                    np.add.at(delta, start[equal] + index.size, -1)
                    for w, d in zip(window[equal].tolist(), doc[equal].tolist(), strict=True):
                        ids[d].update(index.items[w])
            hit = np.cumsum(delta[:-1]) > 0
            starts, ends = [], []
            for i in range(n):
                own = hit[bounds[i] : bounds[i + 1]]
                edges = np.flatnonzero(np.diff(own, prepend=False, append=False)) if own.any() else np.zeros(0, dtype=np.int64)
                starts.append(edges[::2].tolist())
                ends.append(edges[1::2].tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(piece.schema.get_field_index("_id")),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.array(starts, pa.list_(pa.int64())),
                    pa.array(ends, pa.list_(pa.int64())),
                    pa.array([sorted(x) for x in ids], pa.list_(pa.string())),
                ],
                ["_id", "n_words", "starts", "ends", "items"],
            )

    return search


def _indexed(docs: DataFrame, text_col: str, block: Block) -> list[Index]:
    """Order the shingles of a block by their rarity in all documents, and file its windows."""
    vocabularies: dict[int, list[np.ndarray]] = {}
    for size, words, _ in block:
        vocabularies.setdefault(min(SHINGLE, size), []).append(_shingles(words, min(SHINGLE, size)).reshape(-1))
    sets = {k: np.unique(np.concatenate(v)) for k, v in vocabularies.items()}
    counted = docs.select(F.col(text_col).alias("_text")).mapInArrow(_count(sets, "_text"), "size int, shingle long, docs long")
    rows = counted.groupBy("size", "shingle").agg(F.sum("docs").alias("docs")).toArrow()  # at most the block's shingles
    size, shingle, seen = (rows.column(c).to_numpy() for c in ("size", "shingle", "docs"))
    rarity = {}
    for k in sets:
        own = shingle[size == k].view(np.uint64)
        order = np.argsort(own)
        rarity[k] = (own[order], seen[size == k][order])
    return _index(block, rarity)


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 10,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """A row for each document: _id, n_words, starts and ends of the hit runs (word numbers, ends exclusive), items (sorted ids as text)."""
    kind = dict(docs.dtypes)[id_col]
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    told, blocks = benchmark_windows(benchmark, width, item_col, item_text_col, block_windows)
    if blocks < 2:
        return slim.mapInArrow(_search(_indexed(docs, text_col, _block(told, 0)) if blocks else [], "_text"), f"_id {kind}, {_FOUND}")
    # Several passes: rows are told apart by their numbers in a table written once.
    keyed = materialize(slim.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    return keyed.select("_id", "_row").join(_together(keyed, told, blocks), "_row").drop("_row")


_FOUND = "n_words long, starts array<long>, ends array<long>, items array<string>"


def _together(keyed: DataFrame, told: DataFrame, blocks: int) -> DataFrame:
    """What all blocks find in each row of keyed (_row, _text): _row, n_words, starts, ends, items."""
    rows, passes = keyed.select(F.col("_row").alias("_id"), "_text"), None
    for number in range(blocks):
        one = materialize(rows.mapInArrow(_search(_indexed(rows, "_text", _block(told, number)), "_text"), f"_id long, {_FOUND}").where((F.size("starts") > 0) | F.lit(number == 0)), "hits")
        passes = one if passes is None else passes.unionByName(one)
    runs = passes.groupBy("_id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    run = "array<struct<starts:long,ends:long>>"
    merged = F.aggregate(
        F.array_sort("runs"),
        F.struct(F.array().cast(run).alias("done"), F.array().cast(run).alias("open")),
        lambda acc, x: F.when((F.size(acc["open"]) > 0) & (acc["open"][0]["ends"] >= x["starts"]), F.struct(acc["done"].alias("done"), F.array(F.struct(acc["open"][0]["starts"].alias("starts"), F.greatest(acc["open"][0]["ends"], x["ends"]).alias("ends"))).alias("open"))).otherwise(
            F.struct(F.concat(acc["done"], acc["open"]).alias("done"), F.array(x).alias("open"))
        ),
        lambda acc: F.concat(acc["done"], acc["open"]),
    )
    return runs.withColumn("m", merged).select(F.col("_id").alias("_row"), "n_words", F.col("m.starts").alias("starts"), F.col("m.ends").alias("ends"), "items")


def _keep(indexes: list[Index], text_col: str, max_hit_percent: float):
    find_hits = _search(indexes, "_text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_slices(batches, text_col):
            slim = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["_id", "_text"])
            good = np.zeros(len(texts), dtype=bool)
            for out in find_hits(iter([slim])):
                for row in out.to_pylist():
                    hit = sum(row["ends"]) - sum(row["starts"])
                    good[row["_id"]] = hit == 0 or 100 * hit <= max_hit_percent * row["n_words"]
            yield piece.filter(pa.array(good))

    return keep


def filter_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, max_hit_percent: float = 0.0, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of docs, with all their columns, whose words hit by any item are at most max_hit_percent of their words.

    With one block, no text is shuffled; with several, rows are numbered and those that go are taken out by number.
    """
    told, blocks = benchmark_windows(benchmark, width, item_col, item_text_col, block_windows)
    if not blocks:
        return docs
    if blocks == 1:
        return docs.mapInArrow(_keep(_indexed(docs, text_col, _block(told, 0)), text_col, max_hit_percent), docs.schema)
    number = "_row"
    while number in {c.lower() for c in docs.columns}:
        number += "_"
    keyed = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    found = _together(keyed.select(F.col(number).alias("_row"), F.col(text_col).alias("_text")), told, blocks)
    add = lambda column: F.aggregate(column, F.lit(0).cast("long"), lambda a, x: a + x)
    hit = found.select(F.col("_row").alias("_gone"), "n_words", (add("ends") - add("starts")).alias("_hit"))
    gone = hit.where((F.col("_hit") > 0) & (100 * F.col("_hit") > F.lit(float(max_hit_percent)) * F.col("n_words"))).select("_gone")
    return keyed.join(gone, keyed[number] == gone["_gone"], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
