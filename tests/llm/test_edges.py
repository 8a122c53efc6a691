"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, further columns with clashing names."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("bramble.llm")
from bramble.llm import decontamination, graph, language_id, ngram_join, packing, perspectives, pii, quality_rules, shared, token_counts, token_files, tokens, warc, words  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _text string, _host string, node long, n long, tile string, _spans string, _gone long, _bad_host string, piece string, _group int"
CLASH = ("id", "text", "host", 1, 2, "tile", "spans", 3, "bad", "piece", 4)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


LONG = prose(1, 60_000)
ROWS = [
    (1, prose(2, 60), "en", "a"),
    (2, prose(2, 60), "en", "a"),
    (3, prose(2, 60) + " more", None, None),
    (3, prose(2, 60) + " more", None, None),
    (4, None, "en", "b"),
    (5, "", None, "b"),
    (6, " \n\t ", "de", "b"),
    (7, LONG, "de", "c"),
    (8, LONG + " end", None, "c"),
    (None, prose(3, 30), "en", "a"),
    (None, None, None, None),
    (9, "x", "en", "a"),
    (10, "X", "en", "a"),
    (11, "mail me@example.com or +1 (212) 555-1234 now\n" + prose(4, 20), "en", "a"),
    (12, "same line here\n" * 9, "en", "d"),
    (13, "é😀 " * 40, "fr", "d"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, la, s, len(t) if t else None, *CLASH) for i, t, la, s in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def both(out):
    return sorted(map(tuple, out.collect()), key=str)


def test_quality_rules(docs, none):
    out = quality_rules.judge(docs).collect()
    assert len(out) == len(ROWS)
    found = {r["_id"]: r for r in out}
    assert found[4]["n_words"] == 0 and found[4]["base_failed"] and not found[4]["kept"]
    assert found[12]["n_dup_lines"] == 8 and found[12]["n_repeat_words"] == 27 and found[13]["word_chars"] == 80
    assert found[7]["n_words"] == 60_000 and not found[7]["base_failed"]
    assert quality_rules.judge(none).count() == 0
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns and quality_rules.filter_documents(none).count() == 0
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((r["_id"] for r in out if r["kept"]), key=str)


def test_hosts_are_rejected_by_shrunk_rates(spark):
    good, bad = prose(5, 40), "too short"
    rows = [(i, good if i % 20 else bad, f"h{i % 5}") for i in range(1000)] + [(2000 + i, bad if i % 10 else good, "junk") for i in range(200)] + [(3000, bad, "once")]
    out = {r["_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(out[2000 + i]["kept"] for i in range(200)) and out[2000]["host_rejected"] and not out[2000]["base_failed"]
    assert all(out[i]["kept"] == bool(i % 20) for i in range(1000)) and not out[1]["host_rejected"]


def brute_components(rows, width, percent):
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[ \t\n\r\x0b\x0c]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
                links[i] += 1
                links[j] += 1
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted(((rows[i][0], len(sets[i]), least[find(i)] if sets[i] else rows[i][0], links[i]) for i in range(len(rows))), key=str)


def test_ngram_join(docs, none):
    assert both(ngram_join.components(docs, width=4, percent=85)) == brute_components([(i, t) for i, t, *_ in ROWS], 4, 85)
    assert ngram_join.components(none).count() == 0
    out = ngram_join.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted([1, 4, 5, 6, 7, None, None, 9, 11, 12, 13], key=str)
    assert ngram_join.deduplicate(none).count() == 0


def test_deduplicate_with_repeated_ids(spark):
    """Ids that aren't unique, and components of null ids alone."""
    a, b, c = prose(21, 50), prose(22, 50), prose(23, 50)
    rows = [(1, a), (1, a), (2, a + " x"), (1, b), (1, b + " y"), (5, b), (None, c), (None, c + " z"), (None, c), (7, None), (7, None), (8, "")]
    out = ngram_join.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in out if r["doc_id"] in (7, 8)) == [7, 7, 8]
    assert [r["text"] for r in out if r["doc_id"] == 1 and r["text"] == a] == [a]
    assert sum((r["text"] or "").startswith(b) for r in out) == 1 and sum((r["text"] or "").startswith(c) for r in out) == 1
    assert len(out) == 6


@pytest.mark.parametrize("width,percent,block", [(4, 85, 2048), (5, 80, 7), (3, 90, 3)])
def test_ngram_join_near_copies(spark, width, percent, block):
    """Groups around the threshold, chains, and blocks so small that groups are cut into many tiles."""
    rng, rows = random.Random(percent), []
    for g in range(12):
        base = prose(100 + g, rng.choice([4, 6, 9, 15, 30, 80, 200])).split()
        for _ in range(rng.choice([1, 2, 5, 14])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(words) // 20])):
                at = rng.randrange(len(words))
                words[at : at + rng.choice([0, 1])] = [rng.choice(["new", "word", "Here"])]
            rows.append((len(rows) + 10, " ".join(words)))
            base = words if g % 3 == 0 else base
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert both(ngram_join.components(df, width=width, percent=percent, block=block, block_shingles=10**9)) == brute_components(rows, width, percent)


@pytest.mark.parametrize("block", [2048, 3])
def test_ngram_pairs(spark, block):
    """All links, not only those that connect a component; with small blocks too, each once."""
    base = prose(31, 80).split()
    near = [" ".join(base[:i] + ["zz"] + base[i + 1 :]) for i in range(0, 80, 9)] + [" ".join(base[:k]) for k in (74, 77, 77, 80)]
    df = spark.createDataFrame(list(enumerate(near)), "doc_id long, text string")
    members, found = ngram_join.pairs(df, width=4, percent=85, block=block)
    copies = {}
    for r in members.collect():
        copies[r["node"]] = copies.get(r["node"], 0) + 1
    links = [(r["a"], r["b"]) for r in found.collect()]
    assert len({frozenset(x) for x in links}) == len(links)
    twice = sum(copies[a] * copies[b] for a, b in links) * 2 + sum(n * (n - 1) for n in copies.values())
    want = brute_components(list(enumerate(near)), 4, 85)
    assert twice == sum(n for *_, n in want) and len(links) > len(copies)
    assert both(ngram_join.components(df, width=4, percent=85, block=block)) == want


def test_a_chained_group_of_many_nodes():
    """20,000 sets tied to one another, of which each links with its neighbours only: every link is found, however the group is cut."""
    n, step, size = 20_000, 4, 60
    words = np.unique(np.random.default_rng(1).integers(0, 2**63, n * step + size, dtype=np.uint64))
    order = np.random.default_rng(2).permutation(len(words))
    sets = [np.sort(words[order[i * step : i * step + size]]) for i in range(n)]
    nodes, ones = np.arange(n, dtype=np.int64), np.ones(n, dtype=np.int64)
    found, compared_pairs, links = [], 0, np.zeros(n, dtype=np.int64)
    blocks = np.array_split(np.random.default_rng(3).permutation(n), -(-n // ngram_join.BLOCK))
    for i, x in enumerate(blocks[:3]):  # of the tiles of a group, those of three blocks
        for j, y in enumerate(blocks[: i + 1]):
            own = np.concatenate((x, y)) if i != j else x
            side = np.concatenate((np.ones(len(x), dtype=np.int64), np.full(len(y), 2))) if i != j else np.zeros(len(x), dtype=np.int64)
            compared_pairs += len(x) * len(y) if i != j else len(x) * (len(x) - 1) // 2
            some, roots, count = ngram_join.compared(nodes[own], [sets[k] for k in own], side, ones[own], 85, True)
            np.add.at(links, some, count)
            found.append((some, roots))
    held = np.sort(np.concatenate(blocks[:3]))
    near = np.diff(held) == 1  # of 60 shingles 56 in common: 56 / 64 = 0.875; two apart 52 / 68
    assert compared_pairs == len(held) * (len(held) - 1) // 2 > 10_000_000
    want = np.zeros(n, dtype=np.int64)
    np.add.at(want, held[1:][near], 1)
    np.add.at(want, held[:-1][near], 1)
    assert (links == want).all()
    got = dict(zip(*map(np.ndarray.tolist, graph.forest(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))), strict=True))
    first = held[np.maximum.accumulate(np.where(np.concatenate(([True], ~near)), np.arange(len(held)), 0))]
    assert all(got.get(k, k) == f for k, f in zip(held.tolist(), first.tolist(), strict=True))


@pytest.mark.parametrize("percent", [80, 85, 90])
def test_linked_sets_share_a_key(percent):
    rng = np.random.default_rng(percent)
    for n in [5, 6, 7, 8, 10, 12, 15, 16, 22, 23, 31, 45, 64, 90, 180, 500]:
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            for _ in range(50):  # as different as a linked set can be
                out, new = rng.integers(0, n // 4 + 1), rng.integers(0, n // 4 + 1)
                b = np.unique(np.concatenate((rng.permutation(a)[out:], rng.integers(0, 2**63, new, dtype=np.uint64))))
                common = len(np.intersect1d(a, b))
                if 100 * common >= percent * (len(a) + len(b) - common) and (out or new):
                    break
            else:
                continue
            for share in (0, 0.3, 0.9, 1):  # whichever shingles count as frequent
                every = np.union1d(a, b)
                frequent = np.sort(rng.permutation(every)[: int(share * len(every))])
                assert np.intersect1d(ngram_join.slot_keys(a, percent, frequent), ngram_join.slot_keys(b, percent, frequent)).size, (n, out, new, share)


@pytest.mark.parametrize("percent", [80, 85])
def test_long_linked_sets_share_a_key(percent):
    """As test_linked_sets_share_a_key, of sets whose slots of one shingle aren't filed at first, at the very limit of what links."""
    rng = np.random.default_rng(percent)
    for n in [70, 100, 140, 200, 281, 400, 563, 1100, 2500]:
        for part in (0, 0.2, 0.5, 1):  # of what differs, the share that b lacks
            for _ in range(6):
                a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
                linked = lambda out, new: 100 * (n - out) >= percent * (n + new)
                d = max(d for d in range(n) if linked(int(part * d), d - int(part * d)))
                b = np.unique(np.concatenate((rng.permutation(a)[int(part * d) :], rng.integers(0, 2**63, d - int(part * d), dtype=np.uint64))))
                for share in (0, 0.2, 0.7):
                    frequent = np.sort(rng.permutation(every := np.union1d(a, b))[: int(share * len(every))])
                    assert np.intersect1d(ngram_join.slot_keys(a, percent, frequent), ngram_join.slot_keys(b, percent, frequent)).size, (n, part, share)


def test_shared_passages_tie_few_long_sets():
    """Passages in so few sets that none is frequent: if each tied its sets, all long ones would be one group, compared with the square of their number."""
    rng = np.random.default_rng(5)
    passages = rng.integers(0, 2**63, (40, 6), dtype=np.uint64)
    sets = [np.unique(np.concatenate((rng.integers(0, 2**63, n, dtype=np.uint64), passages[rng.permutation(40)[:3]].ravel()))) for n in rng.integers(1500, 3000, 300).tolist()]
    keys = [ngram_join.slot_keys(s, 80) for s in sets]
    ties = ngram_join.compact(np.concatenate(keys), np.repeat(np.arange(len(sets)), [len(k) for k in keys]))[2]
    assert len(np.unique(ties)) < 20


def test_tables_written_leave_no_shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        every = blocks.getAllFiles()
        return {n for k in range(every.size()) if (n := every.apply(k).getName()).startswith("shuffle_")}

    before = shuffles()
    with shared.scope(spark):
        out = shared.materialize(spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count(), "some")
        until = time.time() + 10
        while (left := shuffles() - before) and time.time() < until:
            time.sleep(0.1)
        assert not left and out.count() == 7


def test_small_buffers_tie_the_same_nodes(monkeypatch):
    """Keys leave a buffer once, before and after the shuffle; what is tied stays tied, and a key of all nodes is shuffled once a buffer."""
    base = prose(31, 80)
    texts = [f"{base} {prose(600 + i, 2)}" for i in range(120)] + [prose(900 + i // 2, 30) + " z" * (i % 2) for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["_text"])
    none_frequent = np.zeros(0, dtype=np.uint64)

    def tied(bits):
        filed = [x for b in ngram_join._file(4, 85, bits, none_frequent)(iter([batch])) for x in b.to_pylist()]
        filed.sort(key=lambda r: r["p"])
        rows = pa.RecordBatch.from_pylist(filed, schema=pa.schema([("p", pa.int64()), ("ties", pa.bool_()), ("packed", pa.binary())]))
        ties = {(r["a"], r["b"]) for out in ngram_join._tie(iter([rows])) for r in out.to_pylist()}
        root = {n: n for t in ties for n in t}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in ties:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        return {n: find(n) for n in root}, sum(len(r["packed"]) for r in filed if not r["ties"]) // 16

    whole, n_keys = tied(0)
    assert len(set(whole.values())) <= 21 and len(whole) >= 120
    every = sum(len(ngram_join.slot_keys(s, 85)) for s in ngram_join.shingle_sets(texts, 4))
    assert n_keys < every / 2
    for held in (50, 500):
        monkeypatch.setattr(ngram_join, "HELD_KEYS", held)
        monkeypatch.setattr(ngram_join, "TIED_KEYS", held)
        for bits in (0, 3):
            assert tied(bits)[0] == whole


def test_frequent_shingles_change_no_result(spark, monkeypatch):
    """A passage in every text: found to be frequent, and the components are what they are without that."""
    monkeypatch.setattr(ngram_join, "FREQUENT", 10)
    passage = prose(77, 60)
    rows = [(i, f"{prose(500 + i // 3, 40 + i)} {passage}" + " x y z"[: 2 * (i % 3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    counted = df.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).mapInArrow(ngram_join._read(5), "_id long, n long, node long, shingle long, sets long")
    assert len(ngram_join.frequent_shingles(counted.where("shingle IS NOT NULL"))) >= 56
    assert both(ngram_join.components(df)) == brute_components(rows, 5, 80)


@pytest.mark.parametrize("one_task", [graph.ONE_TASK, 0])
def test_components_of_graphs(spark, monkeypatch, one_task):
    """Chains, hubs at either end, copies of edges and loops; by one task and by rounds."""
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 300) if i % 50] + [(1000, x) for x in range(1001, 1200)] + [(3000, x) for x in range(2000, 2200)] + [(7, 7), (1001, 1000), (9000, 9000)]
    edges += [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(260)]
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in edges]
    rng.shuffle(edges)
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    out = graph.components(spark.createDataFrame(edges, "a long, b long").repartition(7), one_task=one_task).collect()
    assert sorted((r["node"], r["root"]) for r in out) == sorted((x, find(x)) for x in root)
    assert graph.components(spark.createDataFrame([], "a long, b long"), one_task=one_task).count() == 0


def test_long_texts_in_chunks(monkeypatch):
    """Kernels that work on a text chunk by chunk give what they give on the whole, also for words longer than a chunk."""
    rng = random.Random(1)
    text = "".join(rng.choices("ab cdé😀 \n1Z", k=6000)) + "x" * 700 + " end\t" + "y" * 90 + " aΣ bΣ"
    texts = [text, "a b", None, text[:300], ""]
    for kind in (words.PLAIN, words.ALPHA):
        whole = words.words_of(texts, kind, lower=True)
        for chunk in (16, 100):
            monkeypatch.setattr(words, "CHUNK", chunk)
            assert all((a == b).all() for a, b in zip(whole, words.words_of(texts, kind, lower=True), strict=True))
        monkeypatch.undo()
    sets, h, bounds = list(ngram_join.shingle_sets(texts, 4)), *words.words_of(texts)
    frequent = np.sort(np.concatenate(sets)[::5])
    plain = lambda x: (ngram_join.node_of(x), np.sort(ngram_join.slot_keys(x, 85, frequent)).tolist())
    whole, repeats = [plain(x) for x in sets if len(x)], quality_rules._repeat_words(h, bounds)
    for step in (1, 7, 100):
        for module, name in ((ngram_join, "STEP"), (quality_rules, "STEP"), (words, "CHUNK")):
            monkeypatch.setattr(module, name, step)
        assert all((a == b).all() for a, b in zip(sets, ngram_join.shingle_sets(texts, 4), strict=True))
        assert [plain(x) for x in sets if len(x)] == whole and (quality_rules._repeat_words(h, bounds) == repeats).all()
    monkeypatch.undo()
    texts += ["123 . ", " abc", "abc1", "é", "1" * 9 + "a" * 9 + "b"]
    whole = list(language_id.features(texts))
    for long in (3, 7, 100):
        monkeypatch.setattr(language_id, "LONG", long)
        assert all((a == c).all() and (b == d).all() for (a, b), (c, d) in zip(whole, language_id.features(texts), strict=True))


def test_packing(docs, none):
    path = tokens.default_path("byte_bpe_50k.json")
    library = tokens._library(path)
    out = packing.pack(docs, path, size=256, group_pieces=50, with_ids=True)
    rows = out.collect()
    whole = sorted(tuple(library.encode(t or "", add_special_tokens=False).ids) + (0,) for _, t, *_ in ROWS)
    assert sum(r["length"] for r in rows) == sum(map(len, whole))
    for r in rows:
        ids = np.frombuffer(r["ids"], dtype="<u4")
        assert len(ids) == r["length"] <= 256 and zlib.crc32(r["ids"]) == r["ids_crc32"]
    sequences = {r["sequence_id"]: r for r in packing.sequences(out).collect()}
    for r in rows:
        assert sequences[r["sequence_id"]]["ids"][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == r["ids"]
    assert all(len(s["ids"]) == 4 * s["n_tokens"] <= 1024 for s in sequences.values())
    assert packing.pack(none, path).count() == 0


def test_sum_of_squares_choice():
    for seed in range(30):
        rng = np.random.default_rng(seed)
        lengths = rng.integers(1, 17, 60)
        bins, offset = packing.place(lengths, 16)
        gaps = {}
        for s, b, o in zip(lengths.tolist(), bins.tolist(), offset.tolist(), strict=True):
            score = lambda g: sum(v * v for k, v in _counts({**gaps, g[0]: g[1]}).items() if k)
            fits = [(score((x, free - s)), free) for x, free in gaps.items() if free >= s]
            if fits:
                assert b in gaps and gaps[b] == 16 - o and (score((b, gaps[b] - s)), gaps[b]) == min(fits)
            else:
                assert b not in gaps and o == 0
            gaps[b] = 16 - o - s


def _counts(gaps):
    out = {}
    for v in gaps.values():
        out[v] = out.get(v, 0) + 1
    return out


def test_token_files(spark, docs, none):
    path = tokens.default_path("word_bpe_49k.json")
    library = tokens._library(path)
    out = token_files.read(spark, token_files.write(docs, path, block=64), with_ids=True).collect()
    want = sorted(((-1 if i is None else i), t or "") for i, t, *_ in ROWS)
    at, got = 0, sorted(out, key=lambda r: r["start"])
    for (i, t), r in zip(sorted(want, key=lambda x: (x[0], x[1])), got, strict=True):
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        assert (-1 if r["_id"] is None else r["_id"], r["start"], r["n_tokens"]) == (i, at, len(ids))
        assert np.frombuffer(r["ids"], dtype="<u4").tolist() == ids and zlib.crc32(r["ids"]) == r["ids_crc32"]
        at += len(ids)
    assert token_files.read(spark, token_files.write(none, path)).count() == 0


def test_token_blocks_round_trip(tmp_path):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    values = [rng.integers(0, 50_000, 512), np.full(512, 7), np.where(rng.random(512) < 0.03, 2**32 - 1, rng.integers(3, 9, 512)), np.arange(512) * 2**23, rng.integers(0, 2, 512)]
    grid = np.array(values, dtype=np.uint32)
    for percentile in (0, 50, 95, 100):
        for raw, row in zip(token_files.pack_blocks(grid, percentile), grid, strict=True):
            assert np.array_equal(token_files.unpack_block(memoryview(raw), 512), row)
    with pa.OSFile(str(tmp_path / "f"), "wb") as sink:
        writer = token_files.Writer(sink, block=16)
        docs = [rng.integers(0, 2**32, n, dtype=np.uint32) for n in (0, 1, 5000, 16, 15, 33, 9000)]
        for k, d in enumerate(docs):
            writer.add([None if k == 3 else k], d, np.array([0, len(d)]))
        writer.close()
    with pa.OSFile(str(tmp_path / "f"), "rb") as source:
        reader = token_files.Reader(source)
        assert [(i, d.tolist()) for i, _, d in reader.documents()] == [(None if k == 3 else k, d.tolist()) for k, d in enumerate(docs)]
        every = np.concatenate(docs)
        for a, b in ((0, 0), (3, 9), (15, 17), (4999, 5100), (len(every) - 1, len(every))):
            assert np.array_equal(reader.ids(a, b), every[a:b])
    whole = (tmp_path / "f").read_bytes()
    (tmp_path / "g").write_bytes(whole[:-9])
    with pa.OSFile(str(tmp_path / "g"), "rb") as source, pytest.raises(ValueError):
        token_files.Reader(source)


def test_language_id(docs, none, spark):
    out = language_id.identify(docs).collect()
    assert len(out) == len(ROWS) and all(r["lang_pred"] == "und" and r["score"] == 0 for r in out if r["_id"] in (4, 5, 6))
    assert all(r["held_out"] == (r["_id"] is not None and zlib.crc32(str(r["_id"]).encode()) % 4 == 2) for r in out)
    assert language_id.identify(none).count() == 0
    nothing = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(nothing).collect()} == {("und", 0.0)}


def test_language_id_learns_every_language(spark):
    """Also those of whose documents the sample takes a small share: with 30 languages, one of each is its quota."""
    rows = [(40 * k + i, prose(1000 * k + i, 30), f"l{k:02}") for k in range(30) for i in range(40)]
    learned = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), sample_rows=30)
    assert len(learned.langs) == 30 and (learned.weights.max(axis=0) > 0).all()


def test_language_id_sample_of_a_large_language():
    """The share isn't rounded to nothing, and what it takes is about the quota."""
    for n in (1, 39, 40, 41, 50_000_000, 10**12):
        limit = language_id._limit(n, 40, None)
        assert -(2**63) < limit < 2**63 and abs((limit + 2**63 + 1) / 2**64 * n - min(n, 40)) < 1e-3
    assert language_id._limit(10**12, 1, 5) == 5


def test_language_id_sample_of_equal_rows(spark):
    """A row that is repeated many times is sampled once, and no language gets more than its quota."""
    same = spark.range(200_000).select(F.lit("en").alias("_lang"), F.lit("one text in many copies").alias("_text"), F.lit(5).cast("long").alias("_hash"))
    other = spark.range(30_000).select(F.lit("de").alias("_lang"), F.concat(F.lit("ein text "), F.col("id")).alias("_text"), F.xxhash64("id").alias("_hash"))
    found = language_id._sample(same.union(other), {"en": 200_000, "de": 30_000}, {"en": 5, "de": None}, 50).groupBy("_lang").count().collect()
    count = {r["_lang"]: r["count"] for r in found}
    assert count["en"] == 1 and 25 <= count["de"] <= 50


def mixed(h):
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 % 2**64
    h ^= h >> 27
    h = h * 0x94D049BB133111EB % 2**64
    return h ^ h >> 31


def test_language_id_features():
    """N-grams of letters with one blank between runs, counted by brute force."""
    for text in ("Ab, c1d\n ÉÉ  e", "  x", "a", "...", "1a2b", "ΑΣ ΑΣΑ"):
        runs = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        signs = " " + "".join(r + " " for r in runs)
        want = {}
        for n in (1, 2, 3):
            for i in range(len(signs) - n + 1 if runs else 0):
                h = n
                for c in signs[i : i + n]:
                    h = (h * 0x100000001B3 + ord(c)) % 2**64
                bucket = mixed(h) >> (64 - language_id.BITS)
                want[bucket] = want.get(bucket, 0) + 1
        (buckets, counts), idf = next(language_id.features([text])), np.linspace(1, 3, 1 << language_id.BITS)
        assert dict(zip(buckets.tolist(), counts.tolist(), strict=True)) == want, text
        if want:
            raw = {k: (1 + np.log(c)) * idf[k] for k, c in want.items()}
            norm = sum(x * x for x in raw.values()) ** 0.5
            assert np.allclose(language_id.weigh(buckets, counts, idf), [raw[k] / norm for k in sorted(raw)])


def test_language_id_fit_by_brute_force():
    """The regularised leader, one weight after the other."""
    rng = np.random.default_rng(9)
    rows = [(np.sort(rng.choice(12, 4, replace=False)), rng.random(4), int(rng.integers(3))) for _ in range(25)]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.02
    z, n = {}, {}

    def weight(key):
        if abs(z.get(key, 0)) <= l1:
            return 0.0
        return -(z[key] - np.sign(z[key]) * l1) / ((beta + n[key] ** 0.5) / alpha + l2)

    order = np.random.default_rng(5)
    for _ in range(2):
        for i in order.permutation(len(rows)):
            at, x, k = rows[i]
            score = [sum(v * weight((b, c)) for b, v in zip(at, x, strict=True)) for c in range(3)]
            e = np.exp(score)
            now = {(b, c): weight((b, c)) for b in at for c in range(3)}
            for b, v in zip(at, x, strict=True):
                for c in range(3):
                    g = v * (e[c] / e.sum() - (c == k))
                    before = n.get((b, c), 0.0)
                    n[b, c] = before + g * g
                    z[b, c] = z.get((b, c), 0.0) + g - (n[b, c] ** 0.5 - before**0.5) / alpha * now[b, c]
    got = language_id.fit(rows, 3, alpha, beta, l1, l2, epochs=2)
    want = np.array([[weight((b, c)) if (b, c) in z else 0.0 for c in range(3)] for b in range(12)])
    assert np.allclose(got[:12], want) and not got[12:].any() and (want == 0).sum() < 36


def test_language_id_temperature():
    """The best of a fine grid, and off the ends of the search where every score is right."""
    rng = np.random.default_rng(4)
    scores, classes = rng.normal(size=(200, 3)), rng.integers(0, 3, 200)
    scores[np.arange(200), classes] += 1.5
    grid = np.linspace(-5, 5, 4001)
    loss = [-np.log(language_id._softmax(scores / np.exp(t))[np.arange(200), classes]).sum() + t * t / (2 * language_id.PRIOR**2) for t in grid]
    assert abs(np.log(language_id.temperature(scores, classes)) - grid[int(np.argmin(loss))]) < 5e-3
    right = np.full((500, 2), -1.0)
    right[:, 0] = 1
    assert abs(np.log(language_id.temperature(right, np.zeros(500, dtype=int)))) < 4.5


def test_language_id_scores_are_calibrated(spark, sf_small):
    """Of held-out snippets with a score near p, about p are right: they are short enough to be wrong."""
    df = spark.read.parquet(f"{sf_small}/../sf0.01/documents.parquet")
    model = language_id.train(df, ~language_id.held_out())
    rows = [(piece, r["lang"]) for i, r in enumerate(df.where(language_id.held_out()).select("text", "lang").collect()) for piece in language_id.snippets(r["text"], i * 31)]
    langs, scores = model.predict([t for t, _ in rows])
    scores, right = np.array(scores), np.array([a == b for a, (_, b) in zip(langs, rows, strict=True)])
    bins = np.minimum((scores * 10).astype(int), 9)
    error = sum(abs(scores[bins == k].mean() - right[bins == k].mean()) * (bins == k).mean() for k in np.unique(bins))
    print(f"expected calibration error {error:.4f}, mean score {scores.mean():.4f}, right {right.mean():.4f}, temperature {model.temperature:.4f}")
    assert len(rows) > 500 and error < 0.05 and -4.5 < np.log(model.temperature) < 4.5


def test_language_id_accuracy(spark, sf_small):
    df = spark.read.parquet(f"{sf_small}/documents.parquet")
    out = language_id.identify(df).join(df.withColumnRenamed("doc_id", "_id").select("_id", "lang"), "_id").where("held_out").collect()
    assert len(out) > 30 and sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_decontamination(spark, docs, none):
    items = [(1, " ".join(prose(2, 60).split()[5:30])), (2, "X"), (3, None), (4, ""), (None, " ".join(prose(3, 30).split()[:12])), (5, LONG[-200:]), (5, LONG[-200:]), (6, "not, there: at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = []
    for d, t, *_ in ROWS:
        w, hit, ids = split(t), set(), set()
        for item, text in items:
            own = split(text)
            n = min(10, len(own))
            windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
            for k in range(len(w) - n + 1) if n else ():
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    ids.add(item)
        want.append((d, len(w), len(hit), sorted(str(x) for x in ids if x is not None)))
    for most in (200_000, 5):  # one block, many blocks
        out = decontamination.find(docs, bench, block_windows=most).collect()
        assert sorted(((r["_id"], r["n_words"], sum(r["ends"]) - sum(r["starts"]), list(r["items"])) for r in out), key=str) == sorted(want, key=str)
        kept = decontamination.filter_documents(docs, bench, block_windows=most)
        assert kept.columns == docs.columns
        assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((d for d, _, n, _ in want if not n), key=str)
    assert decontamination.find(none, bench).count() == 0
    assert all(not r["starts"] for r in decontamination.find(docs, bench.limit(0)).collect())


def test_decontamination_percent_of_all_blocks(spark):
    """What is hit is added up over all items before the percentage is taken, however the benchmark is cut into blocks."""
    words_ = prose(41, 100).split()
    bench = spark.createDataFrame([("a", " ".join(words_[10:25])), ("b", " ".join(words_[20:36])), ("c", "nowhere at all")], "item_id string, text string")
    rows = [(1, " ".join(words_)), (1, " ".join(words_)), (2, " ".join(words_[:9])), (None, None), (3, " ".join(words_[10:25])), (4, " ".join(words_ + words_[30:36] + prose(42, 200).split()))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _row string")
    for percent, want in ((20, [2, 4, None]), (26, [1, 1, 2, 4, None])):  # 26 of 100 words are hit in 1, of 306 in 4
        for most in (1, 6, 200_000):
            kept = decontamination.filter_documents(docs, bench, max_hit_percent=percent, block_windows=most)
            assert kept.columns == docs.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(want, key=str), (percent, most)


def test_decontamination_of_items_under_one_shingle(spark):
    """400 windows are filed under one shingle and met at 400 places of one text: more pairs than one step takes."""
    items = [(i, "one phrase of all " + " ".join(f"w{i}x{k}" for k in range(6))) for i in range(400)]
    assert len(items) ** 2 > 3 * decontamination.PAIRS
    rows = [(1, " ".join(t for _, t in items)), (2, items[7][1].rsplit(" ", 1)[0] + " other"), (3, "one phrase of all " + items[7][1]), (4, "one phrase of all")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    out = {r["_id"]: (r["n_words"], r["starts"], r["ends"], r["items"]) for r in decontamination.find(docs, bench).collect()}
    assert out == {1: (4000, [0], [4000], sorted(str(i) for i, _ in items)), 2: (10, [], [], []), 3: (14, [4], [14], ["7"]), 4: (4, [], [], [])}


def test_pii(spark, docs, none):
    out = {r["_id"]: r["spans"] for r in pii.find(docs).collect() if r["_id"] is not None}
    assert [(pii.KINDS[c["kind"]], c["start"], c["end"]) for c in out[11]] == [("email", 5, 19), ("phone", 23, 40)] and not out[4] and not out[5]
    assert pii.find(none).count() == 0 and pii.redact(none).count() == 0
    red = pii.redact(docs)
    assert red.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in red.collect()}
    assert texts[11].startswith("mail [EMAIL] or [PHONE] now\n") and texts[4] is None and texts[5] == "" and texts[7] == LONG


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - (9 if int(c) > 4 else 0) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_base_against_brute_force(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choices(["a", "B", "1", "22", "333", ".", "@", "-", "+", " ", "(", ")", "_", "%", "é", "😀", "4111111111111111", "x@y.z", "\n", "+1"], k=rng.randint(0, 60))) for _ in range(1500)]
    texts += ["9" * 20_000, "a" * 20_000 + "@", "1." * 20_000, "+" + "1-" * 9000, "a@" * 9000, "1 " * 9000]
    found = {r["_id"]: r["spans"] for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert [(pii.KINDS[c["kind"]], c["start"], c["end"]) for c in found[i] if c["base"]] == base_spans(t), t[:200]


def test_reliabilities_find_the_good_labelers():
    rng, counts = random.Random(1), {}
    for _ in range(4000):
        truth = rng.random() < 0.4
        votes = tuple((1 if truth == (rng.random() < q) else -1) if rng.random() < 0.9 else 0 for q in (0.95, 0.85, 0.7, 0.5))
        counts[votes] = counts.get(votes, 0) + 1
    cells = [(0, v, float(c)) for v, c in sorted(counts.items())]
    posterior, table = pii.reliabilities(cells)
    right = [table[j, 1, 1] / (table[j, 1, 1] + table[j, -1, 1]) for j in range(4)]
    assert right[0] > 0.9 and right[0] > right[1] > right[2] > right[3] and abs(right[3] - 0.5) < 0.12
    weights = pii.classifier(cells, [(0, 0, 0, 0)] * len(cells), posterior)
    assert weights[0, 1] > weights[2, 1] > 0 > weights[0, -1]


def test_pii_classifier_learns_the_spans_features():
    """Where the votes say less, the features of the spans decide."""
    cells = [(2, (1, 1, 0, 1), 400.0), (2, (-1, -1, 0, -1), 400.0), (2, (0, 0, 0, 0), 10.0), (2, (0, 0, 0, 0), 10.0)]
    features = [(2, 0, 3, 1), (1, 2, 1, 0), (2, 0, 3, 1), (1, 2, 1, 0)]
    weights = pii.classifier(cells, features, [0.99, 0.01, 0.5, 0.5])
    score = [sum(weights[x] for x in pii._active(k, v, f)) for (k, v, _), f in zip(cells, features, strict=True)]
    assert score[0] > score[2] > 0 > score[3] > score[1]


def test_pii_accepted_by_brute_force(spark):
    """Scores, the threshold, and no overlap with a base span, one candidate after the other."""
    rng = random.Random(6)
    names = [("kind", k) for k in range(4)] + [(j, v) for j in range(4) for v in (-1, 1)] + [(k, f, x) for k in range(4) for f, n in pii.FEATURES.items() for x in range(n)]
    weights = {name: rng.uniform(-1.5, 1.5) for name in names}
    docs = []
    for i in range(300):
        own = []
        for _ in range(rng.randint(0, 5)):
            start = rng.randint(0, 30)
            votes, features = [rng.choice([-1, 0, 1]) for _ in pii.LABELERS], [rng.randrange(n) for n in pii.FEATURES.values()]
            own.append((rng.randrange(4), start, start + rng.randint(1, 9), rng.random() < 0.3, *votes, *features))
        docs.append((i, own))
    fields = ", ".join(f"{c}:int" for c in (*pii.LABELERS, *pii.FEATURES))
    df = spark.createDataFrame(docs, f"i int, c array<struct<kind:int,start:long,end:long,base:boolean,{fields}>>")
    got = {r["i"]: [tuple(x) for x in r["a"]] for r in df.select("i", pii.accepted("c", weights, 0.7).alias("a")).collect()}
    for i, own in docs:
        base = [c for c in own if c[3]]
        score = lambda c: sum(weights[x] for x in pii._active(c[0], c[4:8], c[8:]))
        more = [c for c in own if not c[3] and 1 / (1 + np.exp(-score(c))) >= 0.7 and not any(b[1] < c[2] and c[1] < b[2] for b in base)]
        assert got[i] == sorted(base + more), i


def test_pii_added_spans(spark):
    """Planted spans that no base pattern finds, among base ones and what only looks like them: precision and recall."""
    rng, rows, planted = random.Random(12), [], {}
    number = lambda n: "".join(rng.choices("0123456789", k=n))
    area = lambda: str(rng.randint(201, 989))
    for i in range(600):
        before, after = prose(2000 + i, rng.randint(3, 30)), prose(4000 + i, rng.randint(3, 30))
        what, real = [
            (f"mail {prose(i, 1)}{number(2)}@mail.example.com", False),
            (f"call +1 ({area()}) 555-{number(4)}", False),
            (f"server 10.{rng.randint(1, 250)}.3.4", False),
            (f"write to {prose(i, 1)}{number(2)} (at) example (dot) com", True),
            (f"phone ({area()}) 555-{number(4)}", True),
            (f"mobile {area()}-555-{number(4)}", True),
            (f"host {':'.join(f'{rng.randrange(4096, 65536):x}' for _ in range(8))}", True),
            (f"order {number(13)}x", False),
            (f"build 1.{number(3)}.{number(4)}.{number(2)}", False),
            (f"isbn 1{number(2)}-{number(3)}-{number(4)}", False),
        ][i % 10]
        head = f"{before} {what.split(' ')[0]} "
        value = what.split(" ", 1)[1].removeprefix("to ")
        text = f"{before} {what} {after}"
        rows.append((i, text))
        if real:
            at = text.index(value, len(head) - 2)
            planted[i] = (at, at + len(value))
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    added = {(r["_id"], c["start"], c["end"]) for r in found for c in r["spans"] if not c["base"]}
    want = {(i, *x) for i, x in planted.items()}
    precision, recall = len(added & want) / max(1, len(added)), len(added & want) / len(want)
    print(f"added spans: precision {precision:.3f}, recall {recall:.3f} of {len(want)}")
    assert precision >= 0.95 and recall >= 0.8


def test_token_counts(docs, none):
    path = tokens.default_path("byte_bpe_50k.json")
    library = tokens._library(path)
    got = sorted(((r["_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.with_counts(docs, path).collect()), key=str)
    assert got == sorted(((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in ROWS), key=str)
    assert token_counts.with_counts(none, path).count() == 0
    hard = ["a" * n for n in range(40)] + ["ab" * 500, "<|endoftext|>x<|endoftext|>", "".join(random.Random(2).choices("abcdefghijklmnopqrstuvwxyz", k=30_000)), "😀" * 50]
    assert token_counts.count_tokens(path, hard).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in hard]


def test_perspectives(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", None), (1, 3, "ann", "é😀"), (1, 3, "ann", "again"), (2, 0, "system", "only"), (None, 0, "ann", "alone"), (None, 0, "ann", "alone"), (3, None, None, "who"), (3, 1, "eve", "")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, _id string, part int")
    out = perspectives.rotate(df).collect()
    assert sorted(((r["_id"], r["perspective"]) for r in out), key=str) == sorted([(1, "ann"), (1, "bob"), (None, "ann"), (None, "ann"), (3, "eve")], key=str)
    ann = next(r for r in out if (r["_id"], r["perspective"]) == (1, "ann"))
    assert ann["text"] == "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>assistant\nagain<|im_end|>\n<|im_start|>assistant\né😀<|im_end|>\n"
    assert [ann["text"][m["start"] : m["end"]] for m in ann["mask"]] == ["Hi<|im_end|>", "again<|im_end|>", "é😀<|im_end|>"]
    long = spark.createDataFrame([(1, i, "ab"[i % 2], str(i)) for i in range(25)], "conv_id long, turn long, role string, text string")
    parts = perspectives.rotate(long, part_turns=10).collect()
    assert sorted((r["part"], r["perspective"], r["n_turns"]) for r in parts) == [(p, s, 10 if p < 2 else 5) for p in range(3) for s in "ab"]
    assert perspectives.rotate(df.limit(0)).count() == 0


def test_perspectives_of_long_dialogues(spark):
    """Parts hold the whole dialogue for every participant and make one rendering; few turns with large numbers aren't cut."""
    said = [(1, i, "eve" if i == 10 else ("ann", "bob")[i % 2], f"é{i}") for i in range(2500)]
    few = [(2, i, ("ann", "bob")[i % 2], str(i)) for i in range(998, 1004)]
    out = perspectives.rotate(spark.createDataFrame(said + few, "conv_id long, turn long, role string, text string").repartition(3)).collect()
    assert sorted((r["_id"], r["perspective"], r["part"], r["n_turns"]) for r in out) == [(1, s, p, n) for s in ("ann", "bob", "eve") for p, n in enumerate((1000, 1000, 500))] + [(2, "ann", 0, 6), (2, "bob", 0, 6)]
    for number, who, turns in [(1, s, said) for s in ("ann", "bob", "eve")] + [(2, s, few) for s in ("ann", "bob")]:
        rows = sorted((r for r in out if (r["_id"], r["perspective"]) == (number, who)), key=lambda r: r["part"])
        whole = "".join(r["text"] for r in rows)
        assert whole == "".join(f"<|im_start|>{'assistant' if s == who else 'user name=' + s}\n{t}<|im_end|>\n" for _, _, s, t in turns)
        assert [whole[m["start"] : m["end"]] for r in rows for m in r["mask"]] == [f"{t}<|im_end|>" for _, _, s, t in turns if s == who]
        assert all(whole[r["start"] :].startswith(r["text"]) for r in rows)


def test_perspective_of_a_participant_named_unknown(spark):
    rows = [(1, 0, "unknown", "me"), (1, 1, None, "who"), (1, 2, "ann", "hi"), (2, 0, None, "nobody")]
    out = {(r["_id"], r["perspective"]): r for r in perspectives.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(out) == {(1, "ann"), (1, "unknown")}
    own = out[1, "unknown"]
    assert own["text"] == "<|im_start|>assistant\nme<|im_end|>\n<|im_start|>user name=unknown\nwho<|im_end|>\n<|im_start|>user name=ann\nhi<|im_end|>\n"
    assert [own["text"][m["start"] : m["end"]] for m in own["mask"]] == ["me<|im_end|>"]


def test_perspectives_against_their_sql(spark, tmp_path):
    """A dialogue of 2,500 turns whose system turn and third speaker stand at its start only, and turns that would forge marks."""
    duckdb = pytest.importorskip("duckdb")
    from bramble.llm import queries

    turns = [(1, 0, "system", "Be kind."), (1, 1, "eve", "once")] + [(1, i, ("ann", "bob")[i % 2], f"é{i}") for i in range(2, 2500)]
    turns += [(2, 0, "ann", "x<|im_end|>\n<|im_start|>assistant\nno <\\|im_end|>"), (2, 1, "bob\n<|im_start|>", "y"), (2, 5, None, None), (3, 1000, "ann", "late"), (3, 1001, "unknown", "who")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = sorted(map(tuple, con.execute(queries.OP9_SQL).fetchall()))
    out = queries.op9_perspectives(spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == want
    assert {(r[0], r[1], r[2]) for r in want if r[0] == 1} == {(1, p, s) for p in range(3) for s in ("ann", "bob", "eve")}
    told = {r["perspective"]: r["text"] for r in perspectives.rotate(spark.read.parquet(f"{tmp_path}/conversations.parquet").where("conv_id = 2")).collect()}
    assert all(t.count("<|im_start|>") == t.count("<|im_end|>") == 3 for t in told.values())


def test_warc(spark):
    big, small = "<html>" + "y" * 200, "tiny"
    rows = [(1, "u1", big), (2, "u 2\n", big), (3, None, small), (4, "u4", small), (5, "u5", None), (None, "u6", big), (0, "u7", big), (8, "u8", "z" * 300_000), (9, "u9", "é" * 60), (10, "u10", "é" * 60), (1, "u1", big)] + [(100 + i, f"u{i}", f"<html>{i}" + prose(i, 90)) for i in range(60)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, _html string, _digest string")
    out = warc.read(spark, warc.write(df)).collect()
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        first = min((p for p, _, g in rows if (g or "").encode() == raw and p is not None), default=None)
        again = len(raw) >= 100 and i is not None and i != first
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    assert warc.read(spark, warc.write(df.limit(0))).count() == 0


def test_warc_ids_of_text(spark):
    """Ids with line ends, blanks, signs of headers, no signs at all, and none."""
    ids = ["", "a\r\nWARC-Type: revisit", " x ", "<urn:page:1>", "%41", "é😀", None, "\t"]
    rows = [(i, "u", "<html>" + "y" * 200) for i in ids] + [("~", "u", None)]
    out = warc.read(spark, warc.write(spark.createDataFrame(rows, "page_id string, url string, html string")), numeric_ids=False).collect()
    assert sorted((r["_id"], r["record_type"], r["refers_to"]) for r in out if r["_id"] is not None) == sorted([(i, "revisit" if i else "response", "" if i else None) for i in ids if i is not None] + [("~", "response", None)])
    assert [r["record_type"] for r in out if r["_id"] is None] == ["response"]


def test_tables_of_a_scope_are_deleted(spark):
    import os

    from bramble.llm import shared

    with shared.scope(spark):
        table = shared.materialize(spark.range(5), "some")
        path = shared._OPEN[-1][0].removeprefix("file://")
        assert table.count() == 5 and os.path.isdir(path)
    assert not os.path.isdir(path) and not shared._OPEN


def test_warc_damage():
    import io

    sink = io.BytesIO()
    records = [warc.record(i, "http://a/", b"x" * i, hashlib.sha256(b"x" * i).hexdigest(), None) for i in range(50)]
    warc.write_archive(sink, iter(records), records)
    raw = sink.getvalue()
    assert list(warc.read_archive(io.BytesIO(raw), step=100)) == records and [warc.parse(r)[1] for r in records] == list(range(50))
    for bad in (raw[:-1], raw[:100], raw + b"x", b"x" + raw, b"", raw[:-20] + b"\0" * 20):
        with pytest.raises(Exception):  # noqa: B017, PT011
            [warc.parse(x) for x in warc.read_archive(io.BytesIO(bad))]
    good = records[5]
    for bad in (good[:-1], good.replace(b"xxxxx", b"xxxxy"), good.replace(b"Content-Length: 5", b"Content-Length: 6"), good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"WARC-Type: response", b"WARC-Type: revisit"), good.replace(b"WARC-Date", b"WARC-Dat")):
        with pytest.raises(warc.ArchiveError):
            warc.parse(bad)
