"""Token ids of whole texts by the tokenizers library, asked once for each distinct pre-token that a worker meets."""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

from .pretokens import Pretokens

#: Normaliser input on which lower-casing is all that it changes: code points below the combining marks, but for two whose lower case isn't one character or isn't stable.
_PLAIN_BELOW = 0x300


def default_path(name: str) -> str:
    """Where the public vocabulary files are on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _plain(text: str) -> bool:
    return text.isascii() or (max(text) < chr(_PLAIN_BELOW) and "İ" not in text)


@lru_cache(4)
def encoder(path: str) -> Pretokens | None:
    """The fast encoder for a tokenizer file of either known form; None for other files."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    library = Tokenizer.from_file(path)
    specials = {x["content"]: x["id"] for x in told["added_tokens"]}
    simple = all(not (x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]) for x in told["added_tokens"])
    before = told["pre_tokenizer"] or {}
    byte_level = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and told["normalizer"] is None
    word_level = before.get("type") == "Sequence" and [x["type"] for x in before["pretokenizers"]] == ["Split", "ByteLevel"] and before["pretokenizers"][0]["pattern"].get("Regex") == WORD_PATTERN and [x["type"] for x in (told["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
    if not simple or told["post_processor"] is not None and not byte_level or not (byte_level or word_level):
        return None

    def make(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = [e.ids for e in library.encode_batch_fast(words, add_special_tokens=False)]
        count = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        flat = np.fromiter((i for r in rows for i in r), dtype=np.uint32, count=int(count.sum()))
        return count, flat

    def normalize(text: str) -> str:
        return text.lower() if _plain(text) else library.normalizer.normalize_str(text)

    return Pretokens(specials, bool(byte_level), make, normalize if word_level else None)


#: Fixed value: the split pattern of the word-level vocabulary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(4)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode(path: str, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of the texts, null as empty: what the library gives for each whole text without added special tokens."""
    fast = encoder(path)
    if fast is not None:
        return fast.ids(texts)
    rows = [e.ids for e in _library(path).encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, rows), dtype=np.int64, count=len(rows)))))
    return np.fromiter((i for r in rows for i in r), dtype=np.uint32, count=int(bounds[-1])), bounds
