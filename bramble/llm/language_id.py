"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams (1 to 3) of the lower-cased letters, with one blank for whatever lies between letters. Document
frequencies cover all training documents; the classifier is fitted to a stratified sample of them with follow-the-regularised-
leader steps and L1 and L2 penalties. The sample is drawn by hash, equal rows once, `sample_rows` at most over all languages
(one at least of each language that has a document with letters, however large or small its share is) and `SAMPLE_BYTES` of
features. A fifth of it is kept back to fit the temperature by which the scores are divided: to the kept-back texts and short
snippets of them, which can be wrong, with a prior that keeps it off the ends of the search. Prediction reads each whole text
once; there is no shuffle but of counts.

Defined cases: null texts and texts without a letter are `und` with score 0; without training documents all are; a null id
isn't held out and isn't learned from; a null language is predicted but not learned from; repeated rows are predicted each
time; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import io
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import text_slices
from .words import mix

BITS = 15
ORDERS = (1, 2, 3)
#: Characters of a text that are worked on at once.
LONG = 1 << 20
#: The bound on documents that the classifier is fitted to; all of them are counted for the document frequencies.
SAMPLE_ROWS = 4000
#: The bound on the features of the sample, 6 bytes for each n-gram of a document; each language's first document is taken whatever its size.
SAMPLE_BYTES = 256 << 20
#: Characters of the snippets of kept-back texts, and the spread of the prior of the temperature's logarithm.
SNIPPETS, PRIOR = (12, 25, 50, 100), 1.5
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def _hashed(code: np.ndarray, n: int) -> np.ndarray:
    """The buckets of all runs of n signs."""
    h = np.full(max(0, len(code) - n + 1), n, dtype=np.uint64)
    for i in range(n):
        h = h * np.uint64(0x100000001B3) + code[i : i + len(h)]
    return (mix(h) >> np.uint64(64 - BITS)).astype(np.int64)


def _features_of_long(text: str) -> tuple[np.ndarray, np.ndarray]:
    """As features() of one text, chunk by chunk: temporary arrays don't grow with it."""
    counts, kept, before, seen = np.zeros(1 << BITS, dtype=np.int64), np.array([0x20], dtype=np.uint64), False, 0
    for at in range(0, len(text) + 1, LONG):
        part = text[at : at + LONG]
        part += " " if at + LONG > len(text) else ""
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _letters()[code]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] |= before
        before = bool(letter[-1])
        new = np.where(letter, code, 0x20)[keep].astype(np.uint64)
        seen += int(letter.sum())
        code = np.concatenate((kept, new))
        for n in ORDERS:
            h = _hashed(code, n)
            counts += np.bincount(h[max(0, len(kept) - n + 1) :], minlength=1 << BITS)
        kept = code[-(max(ORDERS) - 1) :]
    if not seen:
        counts[:] = 0
    else:
        counts[_hashed(np.array([0x20], dtype=np.uint64), 1)] += 1  # the blank in front
    some = np.flatnonzero(counts)
    return some, counts[some]


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the buckets of its n-grams, ascending, and their counts."""
    if any(t and len(t) > LONG for t in texts):
        for t in texts:
            yield _features_of_long(t.lower()) if t and len(t) > LONG else next(features([t]))
        return
    lowered = [" " + t.lower() + " " if t else " " for t in texts]
    sizes = np.fromiter(map(len, lowered), dtype=np.int64, count=len(lowered))
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[code]
    first = np.zeros(len(code), dtype=bool)
    first[np.cumsum(sizes) - sizes] = True
    keep = letter | first
    keep[1:] |= letter[:-1]  # one blank after each run of letters
    code = np.where(letter, code, 0x20)[keep].astype(np.uint64)
    begin = np.cumsum(keep)[np.cumsum(sizes) - sizes] - 1
    bounds = np.append(begin, len(code))
    hashed = [_hashed(code, n) for n in ORDERS]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        counts = np.bincount(np.concatenate([h[a : max(a, b - n + 1)] for n, h in zip(ORDERS, hashed, strict=True)]), minlength=1 << BITS) if b - a > 1 else np.zeros(1, dtype=np.int64)
        some = np.flatnonzero(counts)
        yield some, counts[some]


def weigh(buckets: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[buckets]
    norm = np.sqrt((x * x).sum())
    return x / norm if norm else x


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 3) -> np.ndarray:
    """Weights (buckets, classes) by follow-the-regularised-leader steps over (buckets, values, class)."""
    z, n = np.zeros((1 << BITS, n_classes)), np.zeros((1 << BITS, n_classes))
    weights = lambda z, n: np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, k = rows[i]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = _softmax(x @ w)
            p[k] -= 1
            g = np.outer(x, p)
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[at] = more
    return weights(z, n)


def temperature(scores: np.ndarray, classes: np.ndarray) -> float:
    """The divisor of the scores with the smallest log loss and penalty of its logarithm, by golden-section search."""
    if not len(scores):
        return 1.0
    row = np.arange(len(classes))
    loss = lambda t: -np.log(np.maximum(_softmax(scores / np.exp(t))[row, classes], 1e-300)).sum() + t * t / (2 * PRIOR * PRIOR)
    low, high, ratio = -5.0, 5.0, (np.sqrt(5) - 1) / 2
    for _ in range(50):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def snippets(text: str, seed: int) -> list[str]:
    """Pieces of a text from its middle, at places that depend on the seed, each with a letter."""
    out = []
    for i, size in enumerate(SNIPPETS):
        if len(text) > 2 * size:
            at = (seed + i * 7919) % (len(text) - size)
            piece = text[at : at + size]
            if any(c.isalpha() for c in piece):
                out.append(piece)
    return out


def _count_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, langs, least, any_row = np.zeros(1 << BITS, dtype=np.int64), {}, {}, False
    for piece, texts in text_slices(batches, "_text"):
        any_row = True
        own = (piece.column(piece.schema.get_field_index(c)).to_pylist() for c in ("_lang", "_hash"))
        for lang, h, (buckets, _) in zip(*own, features(texts), strict=True):
            df[buckets] += 1
            langs[lang] = langs.get(lang, 0) + 1
            if len(buckets):
                least[lang] = min(h, least.get(lang, h))
    if any_row:
        some, names = np.flatnonzero(df), ["bucket", "lang", "n", "least"]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.nulls(len(some), pa.string()), pa.array(df[some]), pa.nulls(len(some), pa.int64())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(langs), pa.int64()), pa.array(list(langs), pa.string()), pa.array(list(langs.values()), pa.int64()), pa.array([least.get(k) for k in langs], pa.int64())], names)


def _train(idf: np.ndarray, langs: list[str]):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: i for i, x in enumerate(langs)}
        rows, back, first, held = [], [], set(), 0
        for piece, texts in text_slices(batches, "_text"):
            own = piece.column(piece.schema.get_field_index("_lang")).to_pylist()
            for lang, text, (b, c) in zip(own, texts, features(texts), strict=True):
                k, size = number[lang], 6 * len(b)
                if not size or (held + size > SAMPLE_BYTES and k in first):
                    continue
                held += size
                example = b.astype(np.uint16), weigh(b, c, idf).astype(np.float32), k
                if k in first and (len(rows) + len(back)) % 5 == 4:  # a language's first row is fitted to
                    back.append((*example, text))
                else:
                    rows.append(example)
                first.add(k)
        weights = fit(rows, len(langs))
        scores, classes = [], []
        for i, (b, x, k, text) in enumerate(back):
            pieces = [(b, x), *((s, weigh(s, c, idf)) for s, c in features(snippets(text, i * 104729)))]
            scores += [v @ weights[s] for s, v in pieces]
            classes += [k] * len(pieces)
        out = io.BytesIO()
        np.savez_compressed(out, weights=weights.astype(np.float32), temperature=temperature(np.array(scores).reshape(-1, len(langs)), np.array(classes, dtype=int)))
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["model"])

    return train


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.langs, self.idf, self.weights, self.temperature = langs, idf, weights, temperature

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for buckets, counts in features(texts):
            if not len(buckets) or not self.langs:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            p = _softmax(weigh(buckets, counts, self.idf) @ self.weights[buckets] / self.temperature)
            best = int(p.argmax())
            langs.append(self.langs[best])
            scores.append(float(p[best]))
        return langs, scores


def _limit(n: int, quota: int, least: int | None) -> int:
    """Of a language's n rows those are sampled whose hash isn't over this: about quota of them, and that of the least hash with letters."""
    share = -(1 << 63) + (min(quota, n) << 64) // n - 1
    return max(share, -(1 << 63) if least is None else least)


def _sample(rows: DataFrame, langs: dict[str, int], least: dict[str, int | None], quota: int) -> DataFrame:
    """At most quota rows of each language, and that of the least hash with letters; equal rows hash alike and are taken once, before any shuffle."""
    of = lambda own: F.create_map(*(F.lit(x).cast(kind) for k in langs for x, kind in ((k, "string"), (own(k), "long"))))[F.col("_lang")]
    drawn = rows.where(F.col("_hash") <= of(lambda k: _limit(langs[k], quota, least[k]))).groupBy("_lang", "_hash").agg(F.min("_text").alias("_text"))
    place = F.row_number().over(Window.partitionBy("_lang").orderBy("_hash"))
    return drawn.withColumn("_place", place).where((F.col("_place") <= quota) | (F.col("_hash") == of(least.get))).drop("_place")


def train(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the rows for which `learn` is true and the language isn't null."""
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"), F.xxhash64(id_col, text_col).alias("_hash"))
    counted = rows.select("_lang", "_text", "_hash").mapInArrow(_count_documents, "bucket long, lang string, n long, least long")
    found = counted.groupBy("bucket", "lang").agg(F.sum("n").alias("n"), F.min("least").alias("least")).collect()  # a row for each bucket and language
    langs = {r["lang"]: r["n"] for r in found if r["lang"] is not None}
    least = {r["lang"]: r["least"] for r in found}
    df = np.zeros(1 << BITS)
    for r in found:
        if r["bucket"] is not None:
            df[r["bucket"]] = r["n"]
    idf = np.log((1 + sum(langs.values())) / (1 + df)) + 1
    names = sorted(langs)
    if not names:
        return Model([], idf, np.zeros((1 << BITS, 0)), 1.0)
    quota = max(1, sample_rows // len(names))
    one = _sample(rows, langs, least, quota).repartition(1).sortWithinPartitions("_hash", "_lang")
    with np.load(io.BytesIO(one.mapInArrow(_train(idf, names), "model binary").first()["model"])) as told:
        return Model(names, idf, told["weights"].astype(np.float64), float(told["temperature"]))


def _predict(model: Model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_slices(batches, "_text"):
            langs, scores = model.predict(texts)
            kept = [c for c in piece.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(piece.column(piece.schema.get_field_index(c)) for c in kept), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"])

    return predict


def held_out(id_col: str = "doc_id") -> Column:
    """True for the documents that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """A row for each document: _id, held_out, lang_pred and score."""
    model = train(docs, ~held_out(id_col) & F.col(id_col).isNotNull(), text_col, lang_col, id_col, sample_rows)
    slim = docs.select(F.col(id_col).alias("_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"))
    return slim.mapInArrow(_predict(model), f"_id {dict(docs.dtypes)[id_col]}, held_out boolean, lang_pred string, score double")
