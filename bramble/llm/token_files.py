"""Token-id files in patched frame-of-reference blocks, with a writer and a reader.

A file, little-endian:

    header    "PFOR1\\0\\0\\0", u32 ids of a block, u32 0
    blocks    u32 minimum, u8 width, u8 0, u16 exceptions (e), packed (value - minimum) of `width` bits each, lowest bit first,
              e x u16 places, e x u32 (value - minimum)
    documents for each: i64 id, u8 1 if the id is null, u64 ids before it in the file
    index     u64 start of each block in the file
    footer    u64 documents, u64 blocks, u64 ids, u64 start of documents, u32 CRC-32 of documents and index, "PFOREND1"

A block's width is the number of bits that `percentile` of its values need after the minimum is taken off; the values that need
more are stored as exceptions and are zero in the packed part.

write() deals the documents out by ranges of their ids, in ascending order (nulls first), a file for each range, through the
file system that the shared folder names. A task that runs twice writes another file; the manifest, written last, names the
files that count. read() decodes whole files block by block.

Defined cases: null and empty texts are the end id alone; repeated ids stand in the order of their texts; an empty table has
no files and reads back as an empty table; further columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import fresh_path, materialize, text_slices
from .tokens import encode

MAGIC, END = b"PFOR1\0\0\0", b"PFOREND1"
BLOCK = 512
PERCENTILE = 95
#: Blocks packed or unpacked in one numpy step.
STEP = 256


def bits_of(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.where(values > 0, np.floor(np.log2(np.maximum(values, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def pack_blocks(values: np.ndarray, percentile: int = PERCENTILE) -> list[bytes]:
    """values: (blocks, size) of u32. The bytes of each block."""
    n, size = values.shape
    low = values.min(axis=1)
    rest = (values - low[:, None]).astype(np.uint32)
    width = bits_of(np.sort(rest, axis=1)[:, min(size - 1, size * percentile // 100)])
    out: list[bytes] = [b""] * n
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        part = rest[own]
        beyond = part >= (1 << int(w))
        inside = np.where(beyond, 0, part).astype(np.uint32)
        bits = (inside[:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)
        packed = np.packbits(bits.reshape(len(own), -1).astype(np.uint8), axis=1, bitorder="little")
        for k, i in enumerate(own.tolist()):
            places = np.flatnonzero(beyond[k])
            head = np.uint32(low[i]).astype("<u4").tobytes() + bytes((int(w), 0)) + len(places).to_bytes(2, "little")
            out[i] = head + packed[k].tobytes() + places.astype("<u2").tobytes() + part[k][places].astype("<u4").tobytes()
    return out


def unpack_block(raw: memoryview, size: int) -> np.ndarray:
    """The values of one block."""
    low, width, n = int.from_bytes(raw[:4], "little"), raw[4], int.from_bytes(raw[6:8], "little")
    n_packed = -(-size * width // 8)
    end = 8 + n_packed
    if len(raw) != end + 6 * n:
        raise ValueError("a block's length doesn't fit its head")
    if width:
        bits = np.unpackbits(np.frombuffer(raw[8:end], dtype=np.uint8), count=size * width, bitorder="little").reshape(size, width)
        whole = np.zeros((size, -(-width // 8) * 8), dtype=np.uint8)
        whole[:, :width] = bits
        four = np.zeros((size, 4), dtype=np.uint8)
        four[:, : whole.shape[1] // 8] = np.packbits(whole, axis=1, bitorder="little")
        values = four.view("<u4").reshape(size).astype(np.uint32)
    else:
        values = np.zeros(size, dtype=np.uint32)
    if n:
        places = np.frombuffer(raw[end : end + 2 * n], dtype="<u2")
        values[places] = np.frombuffer(raw[end + 2 * n :], dtype="<u4")
    return values + np.uint32(low)


class Writer:
    """Writes one file to an output stream, in bounded memory but for 17 bytes a document and 8 a block."""

    def __init__(self, sink, block: int = BLOCK, percentile: int = PERCENTILE):
        self.sink, self.block, self.percentile = sink, block, percentile
        self.at = 0
        self.ids: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []
        self.names: list[int | None] = []
        self.index: list[int] = []
        self.n_ids = self.waiting = 0
        self._put(MAGIC + block.to_bytes(4, "little") + bytes(4))

    def _put(self, raw: bytes) -> None:
        self.sink.write(raw)
        self.at += len(raw)

    def add(self, names: list[int | None], ids: np.ndarray, bounds: np.ndarray) -> None:
        """Documents with their ids, one after another."""
        self.names += names
        self.starts.append(bounds[:-1] + self.n_ids)
        self.n_ids += len(ids)
        self.ids.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block * STEP:
            self._flush()

    def _flush(self, last: bool = False) -> None:
        joined = np.concatenate(self.ids) if self.ids else np.zeros(0, dtype=np.uint32)
        n = len(joined) // self.block
        for low in range(0, n, STEP):
            part = joined[low * self.block : min(low + STEP, n) * self.block].reshape(-1, self.block)
            self._blocks(pack_blocks(part, self.percentile))
        rest = joined[n * self.block :]
        if last and len(rest):
            self._blocks(pack_blocks(rest.reshape(1, -1), self.percentile))
            rest = rest[:0]
        self.ids, self.waiting = [rest], len(rest)

    def _blocks(self, raw: list[bytes]) -> None:
        for x in raw:
            self.index.append(self.at)
            self._put(x)

    def close(self) -> None:
        self._flush(last=True)
        table = np.zeros(len(self.names), dtype=[("id", "<i8"), ("null", "u1"), ("start", "<u8")])
        table["id"] = [x or 0 for x in self.names]
        table["null"] = [x is None for x in self.names]
        table["start"] = np.concatenate(self.starts) if self.starts else []
        tail = table.tobytes() + np.array(self.index, dtype="<u8").tobytes()
        begins = self.at
        self._put(tail)
        self._put(np.array([len(self.names), len(self.index), self.n_ids, begins], dtype="<u8").tobytes() + zlib.crc32(tail).to_bytes(4, "little") + END)


class Reader:
    """Reads one file: the document table and index first, then ids of any range, by the blocks that hold them."""

    def __init__(self, source):
        self.source = source
        source.seek(0)
        head = source.read(16)
        length = source.size()
        source.seek(length - 44)
        foot = source.read(44)
        if head[:8] != MAGIC or foot[-8:] != END:
            raise ValueError("no token file, or one that was cut off")
        self.block = int.from_bytes(head[8:12], "little")
        n_docs, n_blocks, self.n_ids, self.tail = np.frombuffer(foot[:32], dtype="<u8").astype(int).tolist()
        source.seek(self.tail)
        tail = source.read(length - 44 - self.tail)
        if zlib.crc32(tail) != int.from_bytes(foot[32:36], "little"):
            raise ValueError("the document table or index is damaged")
        self.docs = np.frombuffer(tail[: 17 * n_docs], dtype=[("id", "<i8"), ("null", "u1"), ("start", "<u8")])
        self.index = np.append(np.frombuffer(tail[17 * n_docs :], dtype="<u8").astype(np.int64), self.tail)
        if len(self.index) != n_blocks + 1:
            raise ValueError("the index has another number of blocks than the footer")

    def blocks(self, first: int, end: int) -> np.ndarray:
        """The ids of the blocks first to end (exclusive)."""
        if first >= end:
            return np.zeros(0, dtype=np.uint32)
        self.source.seek(int(self.index[first]))
        raw = memoryview(self.source.read(int(self.index[end] - self.index[first])))
        sizes = [min(self.block, self.n_ids - b * self.block) for b in range(first, end)]
        return np.concatenate([unpack_block(raw[self.index[b] - self.index[first] : self.index[b + 1] - self.index[first]], s) for b, s in zip(range(first, end), sizes, strict=True)])

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids start to end (exclusive) of the file."""
        first = start // self.block
        return self.blocks(first, -(-end // self.block))[start - first * self.block : end - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, start, ids) of all documents in order, decoding STEP blocks at a time."""
        bounds = np.append(self.docs["start"].astype(np.int64), self.n_ids)
        at, have = 0, np.zeros(0, dtype=np.uint32)  # the ids at .. at + len(have)
        done = 0
        for i in range(len(self.docs)):
            start, end = int(bounds[i]), int(bounds[i + 1])
            have, at = have[start - at :], start
            if end > at + len(have):
                more = max(done + STEP, -(-end // self.block))
                more = min(more, len(self.index) - 1)
                have = np.concatenate((have, self.blocks(done, more)))
                done = more
            yield None if self.docs["null"][i] else int(self.docs["id"][i]), start, have[: end - start]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _write(folder: str, path: str, end_id: int, block: int, percentile: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = _filesystem(folder)
        files.create_dir(at, recursive=True)
        part, name = TaskContext.get().partitionId(), None
        writer = stream = None
        for piece, texts in text_slices(batches, "_text"):
            if writer is None:
                name = f"part-{part:06d}-{uuid.uuid4().hex}.pfor"
                stream = files.open_output_stream(f"{at}/{name}")
                writer = Writer(stream, block, percentile)
            ids, bounds = encode(path, texts)
            n = np.diff(bounds) + 1
            stops = np.cumsum(n)
            out = np.full(int(stops[-1]), end_id, dtype=np.uint32)
            inside = np.ones(len(out), dtype=bool)
            inside[stops - 1] = False
            out[inside] = ids
            writer.add(piece.column(piece.schema.get_field_index("_id")).to_pylist(), out, np.concatenate(([0], stops)))
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([len(writer.names)], pa.int64()), pa.array([writer.n_ids], pa.int64())], ["part", "path", "n_docs", "n_ids"])

    return write


def write(docs: DataFrame, path: str, folder: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, percentile: int = PERCENTILE) -> DataFrame:
    """Write the token files and return their manifest: part, path, n_docs, n_ids and ids_before (of all files before), in order of part."""
    folder = folder or fresh_path(docs.sparkSession, "tokens")
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    dealt = slim.repartitionByRange("_id").sortWithinPartitions("_id", "_text")
    files = materialize(dealt.mapInArrow(_write(folder, path, end_id, block, percentile), "part int, path string, n_docs long, n_ids long"), "token-files")
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row a file
    return files.withColumn("ids_before", F.coalesce(before, F.lit(0).cast("long")))


def _read(with_ids: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, at = _filesystem(row["path"])
                with files.open_input_file(at) as source:
                    columns: list[list] = [[], [], [], [], []]
                    held = 0
                    reader = Reader(source)
                    if len(reader.docs) != row["n_docs"] or reader.n_ids != row["n_ids"]:
                        raise ValueError(f"{row['path']} isn't what the manifest says")
                    for name, start, ids in reader.documents():
                        raw = ids.astype("<u4").tobytes()
                        for column, value in zip(columns, (name, start + row["ids_before"], len(ids), zlib.crc32(raw), raw if with_ids else None), strict=True):
                            column.append(value)
                        held += len(raw)
                        if len(columns[0]) >= 5000 or with_ids and held > 1 << 24:
                            yield _batch(columns, with_ids)
                            columns, held = [[], [], [], [], []], 0
                    yield _batch(columns, with_ids)

    return read


def _batch(columns: list[list], with_ids: bool) -> pa.RecordBatch:
    arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + ([pa.array(columns[4], pa.binary())] if with_ids else [])
    return pa.RecordBatch.from_arrays(arrays, ["_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)


def read(spark: SparkSession, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """_id, start, n_tokens and ids_crc32 (, ids as little-endian unsigned 32-bit integers) of each document in the manifest's files."""
    files = manifest.select("path", "n_docs", "n_ids", "ids_before").repartition(max(1, manifest.count()), "path")  # a file or so to each task
    return files.mapInArrow(_read(with_ids), "_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
