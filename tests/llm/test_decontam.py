from __future__ import annotations

import random

import pytest

from marlstone.llm import decontam as D


def brute(texts, items, window=10):
    out = []
    for text in texts:
        own = D.words(text)
        hit, who = set(), set()
        for item, words in items:
            w = D.words(words)
            for k in range(max(1, len(w) - window + 1) if w else 0):
                p = w[k : k + window]
                for i in range(len(own) - len(p) + 1):
                    if own[i : i + len(p)] == p:
                        hit.update(range(i, i + len(p)))
                        who.add(item)
        out.append((len(own), sorted(hit), sorted(who)))
    return out


@pytest.mark.parametrize("block", [1 << 18, 200])
def test_against_brute_force(spark, block):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "É", "zz", "A", "x1"])
    items = [(str(i), " ".join(word() for _ in range(rng.choice([0, 1, 4, 10, 14])))) for i in range(12)]
    texts = [None, "", "...", "É, zz"] + ["-".join(word() for _ in range(rng.randint(1, 60))) for _ in range(40)]
    for k in range(6):
        texts.append(f"Some {items[k][1].upper()}; tail a b")
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, items string, n_words int")
    bench = spark.createDataFrame([(int(i), t) for i, t in items] + [(99, None), (None, "a")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, list(r.hit_words), list(r["items"])) for r in D.contamination(docs, bench, block_bytes=block).collect()}
    want = brute(texts, items)
    assert got == {i: w for i, w in enumerate(want)}


def test_spans_are_offsets_of_the_original(spark):
    docs = spark.createDataFrame([(1, "Ünder: the, OLD bridge! x")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "the old bridge")], "item_id long, text string")
    row = D.contamination(docs, bench).first()
    assert [("Ünder: the, OLD bridge! x")[s.start : s.end] for s in row.spans] == ["the, OLD bridge"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(docs, bench).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert D.contamination(one, bench).first().hit_words == []


def test_several_blocks_with_null_and_repeated_ids(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["a", "b", "zz", "x1"])
    items = [(str(i), " ".join(word() for _ in range(rng.choice([3, 10, 14])))) for i in range(12)]
    texts = [f"{word()} {items[k % 12][1]} {items[(k + 5) % 12][1]}" for k in range(24)] + ["a b", "a b", None]
    ids = [None, None, 1, 1, 1, 2] * 4 + [3, 3, 3]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    bench = spark.createDataFrame([(int(i), t) for i, t in items], "item_id long, text string")
    show = lambda r: repr((r.doc_id, r.n_words, list(r.hit_words), list(r["items"]), [tuple(s) for s in r.spans]))
    one, several = (sorted(map(show, D.contamination(docs, bench, block_bytes=b).collect())) for b in (1 << 18, 60))
    assert several == one and len(one) == len(texts)
    hits = sorted(repr((r.doc_id, (r.n_words, list(r.hit_words), list(r["items"])))) for r in D.contamination(docs, bench, block_bytes=60).collect())
    assert hits == sorted(repr(x) for x in zip(ids, brute(texts, items), strict=True))
