"""The pipeline's stages against brute force on a small table."""

import re
import struct
import zlib

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from bramble.llm import pii  # noqa: E402


def words(text):
    return [w for w in re.split(r"[ \t\n\r\x0b\x0c]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def survivors(rows, percent=80):
    sets = {d: shingles(t) for d, t in rows}
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {d for d in ids if find(d) == d}


def kept_by_quality(rows):
    """Base rules of each document, then hosts by rates shrunk with a beta prior fitted by moments."""
    base, failed, docs, fails = {}, {}, {}, {}
    for r in rows.values():
        text = r["text"] or ""
        own = [w for w in re.split(r"[ \t\n\r\x0b\x0c]+", text) if w]
        windows = [tuple(own[i : i + 5]) for i in range(len(own) - 4)]
        twice = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)} if len(set(windows)) < len(windows) else set()
        base[r["doc_id"]] = len(own) < 10 or 100 * len(twice) > 20 * len(own)
        lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        symbols = sum(c in "#*$%&|<>" for c in text)
        failed[r["doc_id"]] = base[r["doc_id"]] or 100 * symbols > 10 * sum(map(len, own)) or len(lines) - len(set(lines)) > 3
        docs[r["source"]] = docs.get(r["source"], 0) + 1
        fails[r["source"]] = fails.get(r["source"], 0) + failed[r["doc_id"]]
    n, mean, rates = len(rows), sum(fails.values()) / len(rows), [fails[h] / docs[h] for h in docs]
    assert n and len(rates) > 1 and 0 < mean < 1
    middle = sum(rates) / len(rates)
    between = sum((x - middle) ** 2 for x in rates) / (len(rates) - 1) - mean * (1 - mean) * sum(1 / x for x in docs.values()) / len(docs)
    weight = mean * (1 - mean) / between - 1 if between > 0 else 0
    weight = weight if weight > 0 else 20.0
    bad = {h for h in docs if (fails[h] + mean * weight) / (docs[h] + weight) > 0.5}
    return {d for d, r in rows.items() if not base[d] and r["source"] not in bad}


def base_spans(t):
    luhn = lambda d: sum(int(c) if i % 2 == 0 else int(c) * 2 - (9 if int(c) > 4 else 0) for i, c in enumerate(reversed(d))) % 10 == 0
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def redacted(text, spans):
    out, at = [], 0
    for start, last, kind in sorted((s, -e, k) for k, s, e in spans):
        if start >= at:
            out += [text[at:start], ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]")[kind]]
        at = max(at, -last)
    return "".join(out) + text[at:]


def test_stages(spark, sf_small, tmp_path):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, sf_small)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == columns, name
            after = {r["doc_id"]: r for r in docs.collect()}
            assert after.keys() <= before.keys()
            assert len(after) == docs.count()
        if name == "quality rules":
            assert set(after) == kept_by_quality(before)
        if name == "n-gram Jaccard join":
            assert set(after) == survivors([(d, r["text"]) for d, r in before.items()])
        if name == "benchmark decontamination":
            items = [re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"])) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
            windows = {tuple(w[k : k + min(10, len(w))]) for w in items for k in range(max(1, len(w) - 9)) if w}
            for d, r in before.items():
                own = re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]))
                held = any(tuple(own[k : k + n]) in windows for n in {len(w) for w in windows} for k in range(len(own) - n + 1))
                assert (d in after) == (not held), d
        if name == "PII":
            assert after.keys() == before.keys()
            said = pii.find(spark.createDataFrame([(d, r["text"]) for d, r in before.items()], "doc_id long, text string"))
            for row in said.collect():
                text, spans = before[row["_id"]]["text"], [(c["kind"], c["start"], c["end"]) for c in row["spans"]]
                assert [(c["kind"], c["start"], c["end"]) for c in row["spans"] if c["base"]] == base_spans(text)
                assert after[row["_id"]]["text"] == redacted(text, spans) and after[row["_id"]]["n_chars"] == len(redacted(text, spans))
        if name == "best-fit packing":
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == before.keys()
            library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
            pieces = {(r["doc_id"], r["start"]): r for r in docs.collect()}
            for d, r in before.items():
                ids = [*library.encode(r["text"], add_special_tokens=False).ids, 0]
                first = len(ids) % 2048 if len(ids) > 2048 else len(ids)
                cuts = [x for x in ([(0, first)] if first else []) + [(i, 2048) for i in range(first, len(ids), 2048)]]
                assert sorted(s for x, s in pieces if x == d) == [i for i, _ in cuts]
                for k, (start, length) in enumerate(cuts):
                    row = pieces[d, start]
                    assert (row["piece"], row["length"], row["ids_crc32"]) == (k, length, zlib.crc32(struct.pack(f"<{length}I", *ids[start : start + length])))
            by_sequence = {}
            for r in docs.collect():
                by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            for parts in by_sequence.values():
                at = 0
                for offset, length in sorted(parts):
                    assert offset == at
                    at += length
                assert at <= 2048


def test_run(spark, sf_small):
    assert pipeline.run(spark, sf_small).count() > 0
