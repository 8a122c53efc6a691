"""Host-level quality rules: document rules, failures per host, rates shrunk by an empirical beta prior.

Words are runs of anything but ASCII white space. A document fails the base rules with fewer than `min_words` words or if
the words inside 5-word windows that occur twice or more in it are over `max_repeat_percent` of its words. Two further rules
(symbols, repeated lines) count towards a host's failures but don't reject a document by themselves.

A host's failure rate is shrunk towards the corpus: Beta(a, b) is fitted to the hosts' rates by moments, and a host is
rejected when (failures + a) / (documents + a + b) exceeds `host_threshold`. All documents of a rejected host go.

Defined cases: null text has no words and fails; a null host is a host of its own that is never rejected; with no host, one
host, or no spread between the hosts, the prior is the corpus rate with weight `prior_weight`; repeated rows count each time;
an empty table gives an empty result. Further input columns, whatever their names, are kept by filter_documents() and not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, text_slices
from .words import windows, words_of

SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
#: Hosts to reject beyond which the verdicts aren't broadcast.
BROADCAST_HOSTS = 200_000
WINDOW = 5
#: Windows of a text that are looked up at once.
STEP = 1 << 18
METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _repeat_words(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a window found twice or more in that text."""
    out = np.zeros(len(bounds) - 1, dtype=np.int64)
    every = windows(h, WINDOW)
    for i in np.flatnonzero(np.diff(bounds) > WINDOW):
        start, end = bounds[i], bounds[i + 1]
        own = every[start : end - WINDOW + 1]
        ranked = np.sort(own)
        twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
        del ranked
        if not len(twice):
            continue
        inside = np.zeros(end - start, dtype=bool)
        for at in range(0, len(own), STEP):
            some = own[at : at + STEP]
            found = twice[np.minimum(np.searchsorted(twice, some), len(twice) - 1)] == some
            for k in range(WINDOW):
                inside[at + k : at + k + len(some)] |= found
        out[i] = np.count_nonzero(inside)
    return out


def _lines(text: str) -> int:
    lines = text.split("\n")
    if len(lines) == 1:
        return 0
    counts = Counter(x for x in lines if x.strip(SPACES))
    return sum(counts.values()) - len(counts)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece, texts in text_slices(batches, "_text"):
        h, bounds = words_of(texts)
        texts = [t or "" for t in texts]
        new = {
            "n_words": np.diff(bounds),
            "word_chars": [len(t) - sum(map(t.count, SPACES)) for t in texts],
            "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts],
            "n_dup_lines": [_lines(t) for t in texts],
            "n_repeat_words": _repeat_words(h, bounds),
        }
        kept = [c for c in piece.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays([*(piece.column(piece.schema.get_field_index(c)) for c in kept), *(pa.array(v, pa.int64()) for v in new.values())], [*kept, *new])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """_id, _host and the metrics of each row; the texts are read once and not shuffled."""
    kinds = dict(docs.dtypes)
    return docs.select(F.col(id_col).alias("_id"), F.col(host_col).alias("_host"), F.col(text_col).alias("_text")).mapInArrow(_measure, f"_id {kinds[id_col]}, _host {kinds[host_col]}, {METRICS}")


def with_rules(metrics: DataFrame, min_words: int, max_repeat_percent: int, max_symbol_percent: int, max_dup_lines: int) -> DataFrame:
    """The rules' outcomes beside the metrics: base_failed, and failed if any rule fails."""
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    more = (100 * F.col("n_symbols") > max_symbol_percent * F.col("word_chars")) | (F.col("n_dup_lines") > max_dup_lines)
    return metrics.withColumns({"base_failed": base, "failed": base | more})


def fit_prior(hosts: DataFrame, prior_weight: float) -> tuple[float, float]:
    """Beta(a, b) by the moments of the hosts' rates; one aggregated row reaches the driver."""
    p = F.col("fails") / F.col("docs")
    row = hosts.agg(F.count("*").alias("k"), F.sum("docs").alias("n"), F.sum("fails").alias("x"), F.avg(p).alias("m"), F.var_samp(p).alias("v"), F.avg(1 / F.col("docs")).alias("r")).first()
    mean = (row["x"] or 0) / row["n"] if row["n"] else 0.0
    if not row["k"] or row["k"] < 2 or not 0 < mean < 1:
        return max(mean, 1e-3) * prior_weight, max(1 - mean, 1e-3) * prior_weight
    between = row["v"] - mean * (1 - mean) * row["r"]  # the spread of the hosts beyond what chance gives
    weight = mean * (1 - mean) / between - 1 if between > 0 else 0.0
    weight = weight if weight > 0 else prior_weight
    return mean * weight, (1 - mean) * weight


def host_verdicts(ruled: DataFrame, host_threshold: float, prior_weight: float) -> DataFrame:
    """_host, docs, fails, shrunk_rate and rejected of each host; counts are combined before the shuffle."""
    hosts = materialize(ruled.groupBy("_host").agg(F.count("*").alias("docs"), F.sum(F.col("failed").cast("long")).alias("fails")), "hosts")
    a, b = fit_prior(hosts, prior_weight)
    rate = (F.col("fails") + F.lit(a)) / (F.col("docs") + F.lit(a + b))
    return hosts.withColumn("shrunk_rate", rate).withColumn("rejected", F.col("_host").isNotNull() & (rate > host_threshold))


def _rejected(hosts: DataFrame) -> DataFrame:
    """The rejected hosts: few as a rule, and then broadcast; if not, a join shuffles and Spark splits its skew."""
    bad = hosts.where("rejected").select(F.col("_host").alias("_bad_host"))
    return F.broadcast(bad) if bad.count() <= BROADCAST_HOSTS else bad


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 10,
    max_repeat_percent: int = 20,
    max_symbol_percent: int = 10,
    max_dup_lines: int = 3,
    host_threshold: float = 0.5,
    prior_weight: float = 20.0,
) -> DataFrame:
    """A row for each document: _id, _host, the metrics, base_failed, failed, host_rejected and kept."""
    ruled = materialize(with_rules(measure(docs, id_col, text_col, host_col), min_words, max_repeat_percent, max_symbol_percent, max_dup_lines), "rules")
    bad = _rejected(host_verdicts(ruled, host_threshold, prior_weight))
    out = ruled.join(bad, ruled["_host"] == bad["_bad_host"], "left")
    rejected = F.col("_bad_host").isNotNull()
    return out.withColumn("host_rejected", rejected).withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_bad_host")


def _keep_base(text_col: str, min_words: int, max_repeat_percent: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_slices(batches, text_col):
            h, bounds = words_of(texts)
            n = np.diff(bounds)
            yield piece.filter(pa.array((n >= min_words) & (100 * _repeat_words(h, bounds) <= max_repeat_percent * n)))

    return keep


def filter_documents(
    docs: DataFrame,
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 10,
    max_repeat_percent: int = 20,
    max_symbol_percent: int = 10,
    max_dup_lines: int = 3,
    host_threshold: float = 0.5,
    prior_weight: float = 20.0,
) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns. The texts are read twice and never shuffled."""
    first = docs.columns[0]
    ruled = with_rules(measure(docs, first, text_col, host_col).drop("_id"), min_words, max_repeat_percent, max_symbol_percent, max_dup_lines)
    hosts = host_verdicts(ruled, host_threshold, prior_weight)
    rows = docs.mapInArrow(_keep_base(text_col, min_words, max_repeat_percent), docs.schema)
    bad = _rejected(hosts)
    return rows.join(bad, rows[host_col] == bad["_bad_host"], "left_anti")
