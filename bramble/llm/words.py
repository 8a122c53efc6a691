"""Words of whole texts as 64-bit fingerprints, computed for many texts at once with numpy.

A fingerprint is a polynomial over per-byte random values, mixed with the word's length. Two different words agree
with a chance of about 2^-64, so fingerprints stand for words where texts are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LENGTH = np.uint64(0xD1B54A32D192ED03)
_POWERS = np.multiply.accumulate(np.full(64, _BASE, dtype=np.uint64))

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words are maximal runs of anything but ASCII white space.
PLAIN = ~_SPACE
#: Words are maximal runs of ASCII letters and of all that is not ASCII.
ALPHA = np.zeros(256, dtype=bool)
ALPHA[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100), *range(0x41, 0x5B)]] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash: each input bit changes about half of the output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.multiply.accumulate(np.full(max(n, 2 * len(_POWERS)), _BASE, dtype=np.uint64))
    return _POWERS


#: Bytes of a buffer that are worked on at once: temporary arrays take about 60 times this, however long a text or a word is.
CHUNK = 1 << 20


def _fingerprints(buffer: np.ndarray, kind: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = kind[buffer]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, dtype=np.uint64)
    length = ends - starts
    first = np.cumsum(length) - length
    place = np.arange(first[-1] + length[-1]) - np.repeat(first, length)
    own = buffer[inside]
    values = _BYTE[_LOWER[own] if lower else own]
    values *= _powers(int(length.max()))[place]
    h = np.add.reduceat(values, first)
    return starts, ends, mix(h + length.astype(np.uint64) * _LENGTH)


def _one_word(word: np.ndarray, lower: bool) -> np.ndarray:
    """The fingerprint of a word of any length, by its sums over chunks."""
    total, powers = 0, _powers(CHUNK)[:CHUNK]
    for at in range(0, len(word), CHUNK):
        own = word[at : at + CHUNK]
        values = _BYTE[_LOWER[own] if lower else own] * powers[: len(own)]
        total += int(values.sum(dtype=np.uint64)) * pow(int(_BASE), at, 1 << 64)
    return mix(np.array([(total + len(word) * int(_LENGTH)) % (1 << 64)], dtype=np.uint64))


def fingerprints(buffer: np.ndarray, kind: np.ndarray, lower: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, ends, fingerprints) of the words in a byte buffer, chunk by chunk."""
    if len(buffer) <= 2 * CHUNK:
        yield _fingerprints(buffer, kind, lower)
        return
    at, n = 0, len(buffer)
    while at < n:
        end = min(at + CHUNK, n)
        inner = end
        while end < n and not len(gap := np.flatnonzero(~kind[buffer[end : end + CHUNK]])):
            end = min(end + CHUNK, n)
        if end < n:
            end += int(gap[0])
        if end - inner > CHUNK:  # the last word is a long one
            gaps = np.flatnonzero(~kind[buffer[at:inner]])
            inner = at + (int(gaps[-1]) + 1 if len(gaps) else 0)
            own = [_fingerprints(buffer[at:inner], kind, lower), (np.array([inner - at]), np.array([end - at]), _one_word(buffer[inner:end], lower))]
        else:
            own = [_fingerprints(buffer[at:end], kind, lower)]
        yield from ((starts + at, ends + at, h) for starts, ends, h in own)
        at = end


def words_of(texts: list[str | None], kind: np.ndarray = PLAIN, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words of all texts, one after another, and the offset where each text's words start (one more at the end).

    Of a long text only fingerprints are kept beside its bytes: the words' places are counted chunk by chunk.
    """
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    starts_at = np.cumsum([0, *(len(r) + 1 for r in raw)])
    buffer = np.frombuffer(raw[0] if len(raw) == 1 else b"\n".join(raw), dtype=np.uint8)
    del raw
    before, parts = np.zeros(len(starts_at), dtype=np.int64), [np.zeros(0, dtype=np.uint64)]
    for starts, _, h in fingerprints(buffer, kind, lower):
        before += np.searchsorted(starts, starts_at)
        parts.append(h)
    del buffer
    return np.concatenate(parts), before


#: Odd factors, one for each place in a window.
_PLACE = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of all runs of `width` consecutive words of h, also those that span two texts."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.empty(n, dtype=np.uint64)
    for at in range(0, n, CHUNK):
        end = min(at + CHUNK, n)
        own = h[at:end] * _PLACE[0]
        for i in range(1, width):
            own += h[at + i : end + i] * _PLACE[i]
        out[at:end] = mix(own + np.uint64(width))
    return out


def whole(h: np.ndarray) -> np.ndarray:
    """One fingerprint of a short sequence of words, by the rule of windows() for its own length."""
    return windows(h, len(h))
