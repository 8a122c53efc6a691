"""Token counts of whole texts by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of a batch lie one after another in an array of symbols. In each round every sequence merges its pair
of lowest rank, wherever it stands, all sequences at the same time; sequences without a pair that merges are done. The number
of symbols that survive is the pre-token's count. Counts are remembered by pre-token, in bounded memory.

Works for byte-level BPE files of the tokenizers library (.json). Merging all places of the lowest pair at once is what the
library does one place at a time, since a merged symbol takes part only in merges of later rank.

Defined cases: null and empty texts have 0 bytes and 0 tokens; special strings inside texts count as one token each, as the
library takes them by default; repeated rows give repeated rows; further columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import Pretokens
from .shared import text_slices

_NONE = np.int32(2**31 - 1)


def byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the rest is numbered from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Merges:
    """A file's merges as sorted arrays."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        left = np.array([vocabulary[a] for a, _ in pairs], dtype=np.uint64)
        right = np.array([vocabulary[b] for _, b in pairs], dtype=np.uint64)
        keys = left << np.uint64(32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        signs = byte_signs()
        self.first = np.array([vocabulary[signs[b]] for b in range(256)], dtype=np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.rank[at], _NONE)

    def count(self, sequences: list[bytes]) -> np.ndarray:
        """Symbols left of each byte sequence."""
        out = np.zeros(len(sequences), dtype=np.int64)
        size = np.fromiter(map(len, sequences), dtype=np.int64, count=len(sequences))
        symbol = self.first[np.frombuffer(b"".join(sequences), dtype=np.uint8)]
        number = np.flatnonzero(size)  # the sequence that each ragged row is
        size = size[number]
        if not len(symbol):
            return out
        last = np.cumsum(size) - 1
        rank = np.full(len(symbol), _NONE, dtype=np.int32)  # of the pair that starts at each place
        inner = np.ones(len(symbol), dtype=bool)
        inner[last] = False
        at = np.flatnonzero(inner)
        rank[at] = self.ranks(symbol[at], symbol[at + 1])
        while len(number):
            first = last - size + 1
            lowest = np.minimum.reduceat(rank, first)
            done = lowest == _NONE
            if done.any():
                out[number[done]] = size[done]
                keep = np.repeat(~done, size)
                symbol, rank = symbol[keep], rank[keep]
                number, size, lowest = number[~done], size[~done], lowest[~done]
                if not len(number):
                    break
                last = np.cumsum(size) - 1
                first = last - size + 1
            row = np.repeat(np.arange(len(size)), size)
            hit = rank == lowest[row]
            place = np.flatnonzero(hit)
            # In a run such as "aaaa" the pair stands at each place; every second one merges, from the left.
            begins = np.ones(len(place), dtype=bool)
            begins[1:] = place[1:] != place[:-1] + 1
            since = np.arange(len(place)) - np.maximum.accumulate(np.where(begins, np.arange(len(place)), 0))
            place = place[since % 2 == 0]
            symbol[place] = self.made[rank[place]]
            gone = np.zeros(len(symbol), dtype=bool)
            gone[place + 1] = True
            size = size - np.bincount(row[place], minlength=len(size))
            new = place - np.arange(len(place))  # the merged symbols' places once the others are gone
            symbol, rank = symbol[~gone], rank[~gone]
            last = np.cumsum(size) - 1
            end = np.zeros(len(symbol), dtype=bool)
            end[last] = True
            again = np.concatenate((new, new[new > 0] - 1))
            rank[again] = _NONE
            again = again[~end[again]]
            rank[again] = self.ranks(symbol[again], symbol[again + 1])
        return out


@lru_cache(2)
def counter(path: str) -> Pretokens:
    """Counts the tokens of each pre-token of a byte-level file."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    before = told["pre_tokenizer"] or {}
    if told["model"]["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or told["normalizer"] or told["model"].get("ignore_merges"):
        raise ValueError(f"{path} is no byte-level BPE file of the known form")
    merges = Merges(told["model"]["vocab"], told["model"]["merges"])
    specials = {x["content"]: x["id"] for x in told["added_tokens"]}
    return Pretokens(specials, True, lambda words: (merges.count([w.encode("utf-8", "surrogatepass") for w in words]), np.zeros(0, dtype=np.uint32)))


def count_tokens(path: str, texts: list[str | None]) -> np.ndarray:
    """The number of tokens of each text."""
    return counter(path).counts(texts)


def _count(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_slices(batches, "_text"):
            n_bytes = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n_bytes, pa.int64()), pa.array(count_tokens(path, texts), pa.int64())], ["_id", "n_bytes", "n_tokens"])

    return count


def with_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, n_bytes and n_tokens of each row, without a shuffle. path: the vocabulary file, at the same place on every machine."""
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return slim.mapInArrow(_count(path), f"_id {dict(docs.dtypes)[id_col]}, n_bytes long, n_tokens long")
