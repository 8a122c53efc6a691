"""Zstandard WARC archives: a dictionary in the leading skippable frame, then one frame for each record.

write() stores a record for each page. Of pages whose payloads are equal and have at least `min_dedup_bytes` bytes, the one
with the smallest id becomes a response record and the others become revisit records that name it; shorter payloads are all
responses. Only digests and ids are grouped; the payloads pass one join. read() takes the dictionary from the leading frame,
walks the frames by their block heads, decodes one record a frame, and validates each record's version, headers and lengths,
the payload's digest, and that nothing follows the record.

Record ids are `urn:page:<id>`, percent-encoded; a page without an id has `urn:no-page`. A revisit record keeps the HTTP head, whose Content-Length is the full payload's, and no
payload. Files go through the file system that the shared folder names; a task that runs twice writes another file, and the
manifest, written last, names the files that count.

Defined cases: null html is an empty payload; a page with a null id is always a response with the id `urn:no-page` and is
never referred to; ids of text may hold any character, and an empty one isn't null; of rows with equal payload and the same smallest id, one that is first in its file order stays a response and so
do its twins, as they have the same id; an empty table gives no archive and an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import islice
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_path, materialize
from .token_files import _filesystem

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Of the first pages of a file, for its dictionary: how many, and their bytes together.
DICTIONARY_PAGES, DICTIONARY_SOURCE, DICTIONARY_BYTES = 200, 1 << 20, 32 << 10
#: Records of a batch on the way back.
READ_ROWS = 10_000
SCHEMA = "_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}"


class ArchiveError(ValueError):
    """An archive that isn't well-formed."""


def _urn(page_id) -> str:
    return "<urn:no-page>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='', errors='surrogatepass')}>"


def _page(urn: str) -> tuple[str | None] | None:
    """(page id,) of a record id; None if it is none."""
    if urn == "<urn:no-page>":
        return (None,)
    found = re.fullmatch(r"<urn:page:([A-Za-z0-9._~%-]*)>", urn)
    return (unquote(found[1], errors="surrogatepass"),) if found else None


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One record: a response with its payload, or a revisit without it."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    if url:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    head.append(("Content-Length", str(len(block))))
    return VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.split(b"\r\n"):
        name, sign, value = line.partition(b":")
        if not sign or not name or name != name.strip():
            raise ArchiveError(f"no header: {line[:80]!r}")
        key = name.decode("ascii").lower()
        if key in out:
            raise ArchiveError(f"header twice: {key}")
        out[key] = value.strip().decode("utf-8")
    return out


def parse(raw: bytes) -> tuple[str, int, str, str, str | None]:
    """(page, payload bytes, digest, type, page referred to) of a record; raises ArchiveError unless all of it fits together."""
    if not raw.startswith(VERSION + b"\r\n"):
        raise ArchiveError("another version, or no record")
    head, sign, rest = raw[len(VERSION) + 2 :].partition(b"\r\n\r\n")
    if not sign:
        raise ArchiveError("headers without an end")
    told = _headers(head)
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"} - told.keys()
    if missing:
        raise ArchiveError(f"headers missing: {sorted(missing)}")
    length = told["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ArchiveError("the block's length isn't Content-Length")
    http, sign, payload = rest[:-4].partition(b"\r\n\r\n")
    status, _, lines = http.partition(b"\r\n")
    if not sign or not status.startswith(b"HTTP/1.1 "):
        raise ArchiveError("no HTTP head")
    size = _headers(lines).get("content-length", "")
    kind, digest = told["warc-type"], told["warc-payload-digest"]
    if not size.isdigit() or not re.fullmatch(r"sha256:[0-9a-f]{64}", digest):
        raise ArchiveError("no payload length or digest")
    page, refers = (_page(told.get(k, "")) for k in ("warc-record-id", "warc-refers-to"))
    if not page:
        raise ArchiveError("an unknown record id")
    if kind == "response":
        if len(payload) != int(size) or hashlib.sha256(payload).hexdigest() != digest[7:]:
            raise ArchiveError("the payload isn't what its head says")
    elif kind != "revisit" or payload or not refers or told.get("warc-profile") != REVISIT_PROFILE:
        raise ArchiveError("an unknown type, or a revisit that isn't one")
    return page[0], int(size), digest[7:], kind, refers[0] if refers else None


def write_archive(sink, records: Iterator[bytes], sample: list[bytes]) -> None:
    """The dictionary, trained on sample if that is enough, in a skippable frame; then a frame for each record."""
    try:
        own = zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes() if len(sample) >= 8 else b""
    except zstandard.ZstdError:
        own = b""  # too little, or too alike: an empty dictionary
    sink.write(DICTIONARY_MAGIC.to_bytes(4, "little") + len(own).to_bytes(4, "little") + own)
    kinds = {"dict_data": zstandard.ZstdCompressionDict(own)} if own else {}
    compressor = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True, **kinds)
    for x in records:
        sink.write(compressor.compress(x))


def _frame_end(raw: memoryview, at: int) -> int:
    """Where the frame that starts at `at` ends, from its own heads."""
    if int.from_bytes(raw[at : at + 4], "little") != FRAME_MAGIC or at + 6 > len(raw):
        raise ArchiveError(f"no frame at byte {at}")
    told = raw[at + 4]
    single = told >> 5 & 1
    size = (1 if single else 0, 2, 4, 8)[told >> 6]
    at += 5 + (not single) + (0, 1, 2, 4)[told & 3] + size
    while True:
        if at + 3 > len(raw):
            raise ArchiveError("a frame is cut off")
        block = int.from_bytes(raw[at : at + 3], "little")
        kind, length = block >> 1 & 3, block >> 3
        if kind == 3:
            raise ArchiveError("a reserved block")
        at += 3 + (1 if kind == 1 else length)
        if block & 1:
            break
    at += 4 * (told >> 2 & 1)
    if at > len(raw):
        raise ArchiveError("a frame is cut off")
    return at


def read_archive(source, step: int = 8 << 20) -> Iterator[bytes]:
    """The records of an archive, decoded frame by frame; holds about `step` bytes of it and one record."""
    head = source.read(8)
    if len(head) < 8 or int.from_bytes(head[:4], "little") != DICTIONARY_MAGIC:
        raise ArchiveError("no dictionary frame in front")
    size = int.from_bytes(head[4:], "little")
    own = source.read(size)
    if len(own) != size:
        raise ArchiveError("the dictionary is cut off")
    if own[:4] == FRAME_MAGIC.to_bytes(4, "little"):
        own = zstandard.ZstdDecompressor().decompressobj().decompress(own)
    decompressor = zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(own)} if own else {}))
    held = b""
    while True:
        more = source.read(step)
        held += more
        raw, at = memoryview(held), 0
        while at < len(held):
            try:
                end = _frame_end(raw, at)
            except (ArchiveError, IndexError):
                if not more:
                    raise
                break
            frame = bytes(raw[at:end])
            if zstandard.frame_content_size(frame) < 0:
                raise ArchiveError("a frame without its content's size")
            yield decompressor.decompress(frame)
            at = end
        del raw
        held = held[at:]
        if not more:
            if held:
                raise ArchiveError("bytes after the last frame")
            return


def _write(folder: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield from zip(*(part.column(i).to_pylist() for i in range(5)), strict=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = rows(batches)
        first, held = [], 0
        for row in source:
            own = record(row[0], row[1], (row[2] or "").encode("utf-8", "surrogatepass"), row[3], row[4])
            first.append(own)
            held += len(own)
            if len(first) >= DICTIONARY_PAGES or held >= DICTIONARY_SOURCE:
                break
        if not first:
            return
        files, at = _filesystem(folder)
        files.create_dir(at, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
        n = 0

        def records() -> Iterator[bytes]:
            nonlocal n
            for x in first:
                n += 1
                yield x
            for row in source:
                n += 1
                yield record(row[0], row[1], (row[2] or "").encode("utf-8", "surrogatepass"), row[3], row[4])

        with files.open_output_stream(f"{at}/{name}") as sink:
            write_archive(sink, records(), [x[:8192] for x in first])
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], ["path", "n_records"])

    return write


def write(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_dedup_bytes: int = 100) -> DataFrame:
    """Write the archives and return their manifest: path and n_records of each."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    slim = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), html.alias("_html"), F.sha2(html.cast("binary"), 256).alias("_digest"))
    long = F.octet_length("_html") >= min_dedup_bytes
    # Counts and smallest ids are combined before the shuffle; only payloads that occur twice reach the join's small side.
    again = slim.where(long).groupBy("_digest").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select(F.col("_digest").alias("_same"), "_first")
    again = materialize(again, "payloads")
    joined = slim.join(again, slim["_digest"] == again["_same"], "left")
    refers = F.when(F.col("_id") != F.col("_first"), F.col("_first"))
    stored = joined.select("_id", "_url", "_html", "_digest", refers.alias("_refers"))
    return materialize(stored.mapInArrow(_write(folder), "path string, n_records long"), "warc-files")


def _read(numeric: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = lambda x: None if x is None else int(x) if numeric else x
        kind = pa.int64() if numeric else pa.string()
        for batch in batches:
            for row in batch.to_pylist():
                files, at = _filesystem(row["path"])
                n = 0
                with files.open_input_stream(at) as source:
                    records = map(parse, read_archive(source))
                    while out := list(islice(records, READ_ROWS)):
                        n += len(out)
                        page, size, digest, what, refers = zip(*out, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(map(value, page), kind), pa.array(size, pa.int64()), pa.array(digest), pa.array(what), pa.array(map(value, refers), kind)], ["_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                if n != row["n_records"]:
                    raise ArchiveError(f"{row['path']} has {n} records, not {row['n_records']}")

    return read


def read(spark: SparkSession, manifest: DataFrame, numeric_ids: bool = True) -> DataFrame:
    """_id, payload_bytes, payload_digest, record_type and refers_to of each record in the manifest's archives."""
    files = manifest.select("path", "n_records").repartition(max(1, manifest.count()), "path")
    return files.mapInArrow(_read(numeric_ids), SCHEMA.format(kind="long" if numeric_ids else "string"))
