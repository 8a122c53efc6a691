"""Pre-tokens of many texts at once, as numpy boundaries, and what is remembered of each distinct one.

Both public BPE files split text by one pattern family: English contractions, runs of letters, of digits, of other signs, and
white space. The byte-level file keeps white space (a blank joins the run after it); the word file drops it, takes digits
one by one and normalises first. Character classes come from the tokenizers library itself, one code point at a time, so the
two agree by construction.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

from .words import _PLACE, mix

LETTER, NUMBER, BLANK, OTHER = 1, 2, 3, 0
_LAST = 0x110000
_RNG = np.random.Generator(np.random.PCG64(77))
_LOW = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_HIGH = _RNG.integers(0, 2**63, 1 << 13, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point, by the regular expressions of the tokenizers library."""
    from tokenizers import Regex
    from tokenizers.normalizers import Replace

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, _LAST)]))
    out = np.zeros(_LAST, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
        rest = np.frombuffer(Replace(Regex(pattern), "").normalize_str(every).encode("utf-32-le"), dtype=np.uint32)
        gone = np.ones(_LAST, dtype=bool)
        gone[rest] = False
        gone[0xD800:0xE000] = False
        out[gone] = kind
    return out


def split(code: np.ndarray, ends: np.ndarray, keep_blanks: bool, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the pre-tokens of the segments that end at `ends` (exclusive, ascending, the last is len(code)).

    keep_blanks: the byte-level rule; otherwise white space is dropped and each digit stands alone.
    """
    n = len(code)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    kind = table[code]
    edge = np.zeros(n + 1, dtype=bool)  # where a segment starts
    edge[0] = edge[n] = True
    edge[ends] = True
    new = np.ones(n + 1, dtype=bool)  # where a run of one class starts
    new[1:n] = kind[1:] != kind[:-1]
    new |= edge
    runs = new.copy()
    blank = kind == BLANK
    if keep_blanks:
        # The last of a run of white space stays with the run after it if it is U+0020, else it stands alone; all of it at the end of a segment is one.
        last = np.flatnonzero(blank & new[1:] & ~edge[1:])
        new[last] = True
        joins = last[code[last] == 0x20]
        new[joins + 1] = False
    else:
        joins = np.zeros(0, dtype=np.int64)
        digits = np.flatnonzero(kind == NUMBER)
        new[digits] = True
    # A contraction: an apostrophe that is a run of its own, not joined to a blank, and its letters.
    mark = np.flatnonzero((code == 0x27) & runs[:n] & runs[1:])
    mark = mark[mark + 1 < n]
    if keep_blanks and len(mark):
        mark = mark[new[mark]]  # not joined
    mark = mark[~edge[mark + 1]]
    if len(mark):
        one = code[mark + 1]
        two = np.where((mark + 2 < n) & ~runs[np.minimum(mark + 2, n)], code[np.minimum(mark + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        pair = np.zeros(len(mark), dtype=bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        size = np.where(short, 1, np.where(pair, 2, 0))
        mark, size = mark[size > 0], size[size > 0]
        new[mark + 1] = False
        new[mark + 1 + size] = True
    at = np.flatnonzero(new)
    starts, stops = at[:-1], at[1:]
    if not keep_blanks:
        word = ~blank[starts]
        starts, stops = starts[word], stops[word]
    return starts, stops


def keys_of(code: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the pre-tokens."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    length = stops - starts
    powers = np.multiply.accumulate(np.full(int(length.max()), _STEP, dtype=np.uint64))
    values = _LOW[code & 0xFF] * _HIGH[code >> 8]
    first = np.cumsum(length) - length
    if int(length.sum()) != len(code):
        place = np.arange(int(length.sum())) + np.repeat(starts - first, length)
        values = values[place]
    values *= powers[np.arange(len(values)) - np.repeat(first, length)]
    return mix(np.add.reduceat(values, first) + length.astype(np.uint64) * _PLACE[1])


class Memo:
    """Rows of integers by 64-bit key, in sorted arrays; emptied when it holds `most` keys, so its memory is bounded."""

    def __init__(self, most: int = 1_500_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.first = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int32)
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key, and whether it is there."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return at, (self.keys[at] == keys) if len(self.keys) else np.zeros(len(keys), dtype=bool)

    def add(self, keys: np.ndarray, count: np.ndarray, flat: np.ndarray) -> None:
        """keys: sorted, new. The caller clears; one batch of texts may go beyond `most`."""
        first = np.cumsum(count) - count + self.used
        if self.used + len(flat) > len(self.flat):
            grown = np.zeros(2 * (self.used + len(flat)), dtype=np.uint32)
            grown[: self.used] = self.flat[: self.used]
            self.flat = grown
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.first = np.insert(self.first, at, first)
        self.count = np.insert(self.count, at, count.astype(np.int32))


#: Characters of a text that are worked on at once.
LONG = 1 << 20
_CUT = re.compile("[A-Za-z] (?=[A-Za-z])")
#: Distinct pre-tokens handed to `make` at once.
MAKE = 20_000


class Pretokens:
    """Turns texts into rows of integers for each pre-token; `make` is asked only for pre-tokens not seen before.

    make(strings) -> (count, flat): how many integers each has, and all of them.
    """

    def __init__(self, specials: dict[str, int], keep_blanks: bool, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], normalize: Callable[[str], str] | None = None, most: int = 1_500_000):
        self.specials, self.keep_blanks, self.make, self.normalize = specials, keep_blanks, make, normalize
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True))) or "(?!)")
        self.table, self.memo = classes(), Memo(most)

    def _segments(self, text: str) -> Iterator[str | int]:
        """Plain pieces of a text and the ids of the special strings between them; the leftmost, then the longest special wins."""
        at = 0
        for found in self.special.finditer(text):
            if found.start() > at:
                yield text[at : found.start()]
            yield self.specials[found[0]]
            at = found.end()
        if at < len(text):
            yield text[at:]

    def rows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(token_count, place, bounds, extra): for each pre-token its number of integers and its place in memo.flat; the
        offsets of each text's pre-tokens. A special string is a pre-token too, of place -1 - id."""
        pieces: list[str] = []
        fixed: list[tuple[int, int]] = []  # (piece, id)
        of_text = np.zeros(len(texts) + 1, dtype=np.int64)
        for i, text in enumerate(texts):
            if text:
                if any(s in text for s in self.specials):
                    for x in self._segments(text):
                        if isinstance(x, int):
                            fixed.append((len(pieces), x))
                            pieces.append("\x00")
                        else:
                            pieces.append(self.normalize(x) if self.normalize else x)
                else:
                    pieces.append(self.normalize(text) if self.normalize else text)
            of_text[i + 1] = len(pieces)
        joined = "".join(pieces)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)))
        starts, stops = split(code, ends[ends < len(code)] if len(ends) else ends, self.keep_blanks, self.table)
        keys = keys_of(code, starts, stops)
        begin = np.concatenate(([0], ends))
        bounds = np.searchsorted(starts, begin[of_text])
        distinct, sample, inverse = np.unique(keys, return_index=True, return_inverse=True)
        at, known = self.memo.find(distinct)
        if not known.all():
            new = np.flatnonzero(~known)
            if len(self.memo.keys) + len(new) > self.memo.most:
                self.memo.clear()
                new = np.arange(len(distinct))
            for low in range(0, len(new), MAKE):
                part = new[low : low + MAKE]
                words = [joined[starts[sample[i]] : stops[sample[i]]] for i in part]
                self.memo.add(distinct[part], *self.make(words))
            at, _ = self.memo.find(distinct)
        place, count = (self.memo.first[at])[inverse], (self.memo.count[at])[inverse].astype(np.int64)
        for piece, special in fixed:
            k = np.searchsorted(starts, begin[piece])
            place[k], count[k] = -1 - special, 1
        return count, place, bounds, self.memo.flat

    def parts(self, text: str) -> Iterator[str]:
        """Pieces of a long text whose pre-tokens are, one after another, the text's: cut before a blank between ASCII letters, off any special string."""
        at = 0
        while len(text) - at > LONG:
            end = None
            for found in _CUT.finditer(text, at + LONG):
                i = found.start() + 1
                if all(text.find(x, max(0, i - len(x)), i + 1 + len(x)) < 0 for x in self.specials):
                    end = i
                    break
            if end is None:
                break
            yield text[at:end]
            at = end
        yield text[at:]

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """The number of integers of each text."""
        if any(t and len(t) > LONG for t in texts):
            return np.array([sum(int(self._counts([x])[0]) for x in self.parts(t or "")) for t in texts], dtype=np.int64)
        return self._counts(texts)

    def _counts(self, texts: list[str | None]) -> np.ndarray:
        count, _, bounds, _ = self.rows(texts)
        total = np.concatenate(([0], np.cumsum(count)))
        return total[bounds[1:]] - total[bounds[:-1]]

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All integers of all texts, and the offsets of each text's."""
        if any(t and len(t) > LONG for t in texts):
            rows = [np.concatenate([self._ids([x])[0] for x in self.parts(t or "")]) for t in texts]
            return np.concatenate(rows), np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int64)
        return self._ids(texts)

    def _ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        count, place, bounds, flat = self.rows(texts)
        if not len(count):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(texts) + 1, dtype=np.int64)
        total = np.concatenate(([0], np.cumsum(count)))
        source = np.repeat(np.maximum(place, 0) - total[:-1], count) + np.arange(total[-1])
        out = flat[source]
        special = np.flatnonzero(place < 0)
        out[total[special]] = -1 - place[special]
        return out, total[bounds]
