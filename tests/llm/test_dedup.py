from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm import bwt, neardup, substrings, suffixes

SPACED = re.compile("[^\x20\x09-\x0d]+")
EXTRA = ", lang string, grp int, n int, phrase string, removed string"


def table(spark, rows):
    """Documents with clashing extra columns."""
    return spark.createDataFrame([(i, t, "x", 7, 8, "y", "z") for i, t in rows], "doc_id long, text string" + EXTRA)


def corpus(seed, sizes=(0, 1, 4, 30, 90)):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "cc", "é", "Dd", "the"])
    passage = " ".join(word() for _ in range(40))
    texts = [None, "", " \n\t", "word"]
    for _ in range(30):
        text = " ".join(word() for _ in range(rng.choice(sizes)))
        texts.append(text + rng.choice(["", "\n" + passage, " " + passage + " tail"]))
    texts += rng.sample([t for t in texts if t], 5) + ["x " * 300, "x " * 300, "\U0001f600" * 70]
    return list(enumerate(texts, 1))


def near_model(rows, percent=85):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = SPACED.findall((t or "").translate(lower))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    moved = True
    while moved:
        moved = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and label[a] < label[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    label[b], moved = label[a], True
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(1)
    base = [[f"w{rng.randrange(400)}" for _ in range(120)] for _ in range(4)]
    rows = corpus(2)
    for k in range(60):  # a large group of near copies, at every distance
        w = list(base[0] if k < 40 else base[rng.randrange(4)])
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6, 12])):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        rows.append((1000 + k, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(table(spark, rows)).collect()}
    assert got == near_model(rows)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    got = {r.node: r.label for r in neardup.components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 1), 100: 100, 101: 100}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 4000).astype(np.uint64)
    a, b = np.sort(h[:3000]), np.sort(h[1000:])
    sig = neardup.superminhash(np.concatenate([a, b]), np.array([0, 3000, 6000]), 256)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.12 and np.isfinite(sig).all()
    few = neardup.superminhash(a[:3], np.array([0, 3, 3]), 64)
    assert np.isfinite(few[0]).all() and np.isinf(few[1]).all()


def word_model(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        w = SPACED.findall(t or "")
        gone = set()
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            gone.update(range(k, k + 20) if key in seen else ())
            seen.add(key)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.setdefault(i, []).append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return {i: sorted(v) for i, v in out.items()}


@pytest.mark.parametrize(("size", "buckets"), [(4 << 20, 1), (300, 5)])
def test_repeated_words_against_brute_force(spark, size, buckets):
    rows = corpus(3) + [(7, "again " * 30)]
    out = {}
    for r in substrings.repeated_words(table(spark, rows), group_bytes=size, buckets=buckets).collect():
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
        out.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.kept_sha256))
    assert {i: sorted(v) for i, v in out.items()} == word_model(rows)


def byte_model(rows, length):
    count = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raw:
        for k in range(len(b) - length + 1):
            count[b[k : k + length]] = count.get(b[k : k + length], 0) + 1
    out = {}
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.setdefault(i, []).append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return {i: sorted(v) for i, v in out.items()}


@pytest.mark.parametrize(("length", "gram", "size", "buckets", "shard", "hot"), [(200, 50, 2 << 20, 1, 1 << 17, 4096), (30, 8, 400, 4, 200, 4096), (12, 5, 150, 3, 50, 4096), (12, 5, 400, 3, 100, 1), (30, 8, 400, 4, 200, 2)])
def test_repeated_bytes_against_brute_force(spark, length, gram, size, buckets, shard, hot):
    rows = corpus(4) + [(7, "again " * 30)]
    out = {}
    for r in suffixes.repeated_bytes(table(spark, rows), length, gram, size, buckets, shard, hot).collect():
        assert sum(s.end - s.start for s in r.removed) == r.n_removed and len(r.removed) == r.n_spans
        out.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert {i: sorted(v) for i, v in out.items()} == byte_model(rows, length)


def test_merged_transforms_give_the_repeated_intervals():
    """Against sorting all suffixes of all shards."""
    rng = np.random.default_rng(2)
    for _ in range(60):
        depth, letters, texts, codes, shards = int(rng.integers(1, 30)), int(rng.integers(2, 5)), [], [], []
        for _ in range(int(rng.integers(1, 5))):
            own = [rng.integers(0, letters, int(rng.integers(0, 60))).astype(np.uint8) for _ in range(int(rng.integers(1, 8)))]
            own += texts[:1]
            texts += own
            codes.append(bwt.joined(np.concatenate(own), np.array([len(x) for x in own])))
            shards.append(bwt.transform(codes[-1], depth))
            ends = np.flatnonzero(codes[-1] == 0)
            marked = codes[-1].astype(int) + len(codes[-1])
            marked[ends] = np.arange(len(ends))
            keys = [tuple(marked[k : ends[np.searchsorted(ends, k)] + 1]) for k in shards[-1].place]
            assert keys == sorted(keys)
        text = np.concatenate(codes)
        found = {}
        for k in range(len(text) - depth + 1):
            if (text[k : k + depth] > 0).all():
                found.setdefault(tuple(text[k : k + depth].tolist()), []).append(k)
        suffix, interval = bwt.merge(shards, depth)
        assert sorted(suffix.tolist()) == sorted(k for v in found.values() if len(v) > 1 for k in v)
        keys = [tuple(text[k : k + depth].tolist()) for k in suffix]
        assert keys == sorted(keys)
        assert [x == y for x, y in zip(keys, keys[1:], strict=False)] == (interval[1:] == interval[:-1]).tolist()


def test_the_merge_decides_about_edges(spark, monkeypatch):
    """Passages that end at different places: without the merge their rims would stay."""
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(260))
    rows = [(k, f"{rng.random()}{passage[: 205 + 9 * k]}{rng.random()}") for k in range(6)]
    get = lambda: {r.doc_id: r.n_removed for r in suffixes.repeated_bytes(table(spark, rows), group_bytes=400, buckets=3).collect()}
    whole = get()
    assert whole == {i: x[0][1] for i, x in byte_model(rows, 200).items()} and min(whole.values()) >= 205
    monkeypatch.setattr(suffixes, "_merge_edges", _no_merge)
    assert sum(get().values()) < sum(whole.values())


def _no_merge(table, length, shard_bytes):
    return pa.table({"grp": table.column("grp"), "bucket": table.column("bucket"), "windows": pa.array([b""] * len(table), pa.binary())})


def test_rows_sent_grow_with_the_input(spark):
    """Groups send no empty packs: packs grow with the text, not with groups times buckets."""
    counts = []
    for n in (1, 2, 4):
        rows = [(i, t) for k in range(n) for i, t in ((100 * k + i, None if t is None else t.replace("a", f"a{k}")) for i, t in corpus(20 + k))]
        words = sum(len((t or "").split()) for _, t in rows)
        grouped = table(spark, rows).selectExpr("cast(doc_id % 40 as int) as grp", "doc_id", "coalesce(text, '') as text")
        buckets = 200 * n
        blocks = grouped.groupBy("grp").applyInArrow(lambda t: substrings._send_blocks(t, buckets), "bucket int, grp int, probes binary, blocks binary")  # noqa: B023
        pairs = grouped.groupBy("grp").applyInArrow(lambda t: suffixes._send_pairs(t, buckets, 40, 10), "bucket int, grp int, anchors binary, phrases binary")  # noqa: B023
        sent = [blocks.count(), pairs.count()]
        counts.append((words, *sent))
    for words, blocks, pairs in counts:
        assert blocks < words and pairs < words
    assert counts[2][1] < 6 * counts[0][1] and counts[2][2] < 6 * counts[0][2]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(none).count() == substrings.repeated_words(none).count() == suffixes.repeated_bytes(none).count() == 0


def test_null_ids(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (2, None)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(table(spark, rows)).collect()}
    assert got[1] == 1 and got[2] == 2
    assert substrings.repeated_words(table(spark, rows)).count() == suffixes.repeated_bytes(table(spark, rows)).count() == 3
