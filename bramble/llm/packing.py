"""Sum-of-squares packing of documents into sequences of a fixed number of tokens.

A document is its token ids and one end id. Only longer ones are cut, into pieces of the full size, of which the first may be
shorter. The pieces are dealt by hash into groups of about `group_pieces`, whose number grows with the input; each group is
packed by itself, longest piece first. A piece goes to the open sequence for which the sum over all residual gaps of the
squared number of open sequences with that gap becomes smallest (equal sums: the smallest gap left); a new sequence is opened
if no open one has room. Only lengths reach a group; where ids are asked for, they join their places by the piece's number.

Defined cases: null and empty texts are the end id alone; repeated rows and null ids are packed as rows of their own; an
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .shared import materialize, text_slices
from .tokens import encode

#: Pieces of a group: two seconds of packing, a few MB.
GROUP_PIECES = 100_000


def cut(length: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: full ones, but for the first."""
    first = length % size if length > size else length
    return ([(0, first)] if first else []) + [(at, size) for at in range(first, length, size)]


def _pieces(path: str, size: int, end_id: int, with_ids: bool):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_slices(batches, "_text"):
            ids, bounds = encode(path, texts)
            own: list[list] = [[], [], [], [], []]
            row = []
            for i in range(len(texts)):
                doc = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(doc), size)):
                    raw = doc[start : start + length].tobytes()
                    row.append(i)
                    for column, value in zip(own, (k, start, length, zlib.crc32(raw), raw), strict=True):
                        column.append(value)
            arrays = [piece.column(0).take(pa.array(row, pa.int64())), pa.array(own[0], pa.int32()), *(pa.array(c, pa.int64()) for c in own[1:4])]
            names = ["_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(own[4], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return pieces


def pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """_id, piece, start, length and ids_crc32 of each piece; with_ids adds the ids as little-endian unsigned 32-bit integers."""
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = f"_id {dict(docs.dtypes)[id_col]}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return slim.mapInArrow(_pieces(path, size, end_id, with_ids), schema)


def place(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, taken in the given order."""
    n_open = np.zeros(size + 1, dtype=np.int64)  # by residual gap
    bins: list[list[int]] = [[] for _ in range(size + 1)]
    out, offset, used = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        gap, own = size, -1
        if s < size:
            # A move from gap g to g - s changes the sum by -2 n(g) + 1 + 2 n(g - s) + 1; a full sequence isn't open.
            here, there = n_open[s:], n_open[: size - s + 1]
            change = np.where(here > 0, 2 * (there - here) + 2, 1 << 40)
            change[0] -= 1
            best = int(change.argmin())
            if here[best] > 0:
                gap = best + s
                own = bins[gap].pop()
                n_open[gap] -= 1
        if own < 0:
            own, used = used, used + 1
        out[i], offset[i] = own, size - gap
        if gap > s:
            n_open[gap - s] += 1
            bins[gap - s].append(own)
    return out, offset


def _pack(size: int):
    def pack(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        order = np.argsort(-lengths, kind="stable")
        own, at = place(lengths[order], size)
        bins, offset = np.empty_like(own), np.empty_like(at)
        bins[order], offset[order] = own, at
        group = table.column("_group").to_numpy()
        table = table.drop_columns(["_group"])
        return table.append_column("sequence_id", pa.array(group * (1 << 32) + bins, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return pack


def assign(parts: DataFrame, size: int = 2048, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """parts (with a column length, at most size) and for each row its sequence_id and offset; binary columns aren't shuffled by group."""
    parts = materialize(parts.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-parts.count() // group_pieces))
    heavy = [f.name for f in parts.schema if f.dataType == BinaryType()]
    light = parts.drop(*heavy)
    keyed = light.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)).cast("long"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in light.schema)
    placed = keyed.groupBy("_group").applyInArrow(_pack(size), f"{kinds}, sequence_id long, offset long")
    if not heavy:
        return placed.drop("_row")
    places = placed.select(F.col("_row").alias("_placed"), "sequence_id", "offset")
    return parts.join(places, parts["_row"] == places["_placed"]).drop("_row", "_placed")


def sequences(placed: DataFrame) -> DataFrame:
    """Whole sequences from placed pieces with ids: sequence_id, n_tokens and the ids, gapless. A group is one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", group_pieces: int = GROUP_PIECES, with_ids: bool = False) -> DataFrame:
    """A row for each piece: _id, piece, start, length, ids_crc32 (, ids), sequence_id, offset."""
    return assign(pieces(docs, path, size, end_id, id_col, text_col, with_ids), size, group_pieces)
