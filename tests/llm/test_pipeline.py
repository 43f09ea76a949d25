from __future__ import annotations

import random

import corpus_pipeline as P
from marlstone.llm import neardup, quality, sharding
from marlstone.llm.decontam import words


def test_near_copies_from_080_on_go(spark):
    rng = random.Random(5)
    rows, similarity = [], []
    for k in range(24):
        base = [f"w{rng.randrange(10**6)}" for _ in range(204)]  # 200 shingles
        # each changed word takes 5 shingles; 4 give 180 / 220, 3 or less are above 0.85, 5 are under 0.8
        changes = 4 if k % 3 else 5
        copy = list(base)
        for j in range(changes):
            copy[20 + 35 * j] = f"new{k}x{j}"
        for i, words in ((2 * k, base), (2 * k + 1, copy)):
            rows.append((i, " ".join(words), "en", "s", 1))
        similarity.append((200 - 5 * changes) / (200 + 5 * changes))
    assert all(0.8 <= s < 0.85 for s in similarity[1::3] + similarity[2::3]) and all(s < 0.8 for s in similarity[::3])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in P.near_dedup_stage(spark, docs, "").collect()}
    assert kept == {2 * k for k in range(24)} | {2 * k + 1 for k in range(0, 24, 3)}


def pool(spark):
    """Documents with a group of near copies, repeated rows, null ids and texts, a benchmark passage and clashing columns."""
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    base = text(300)
    rows = [(i, text(rng.randint(5, 200)), rng.choice(["en", "de", None]), rng.choice(["s", "s", "t"]), 1) for i in range(60)]
    rows += [(100 + k, base + f" tail{k}", "en", "s", 1) for k in range(30)]  # a third of all
    rows += [(7, rows[7][1], "en", "s", 1)] * 2 + [(None, "no id here at all friends", "en", "s", 1)] * 2 + [(None, None, None, None, None), (200, None, "en", "s", 1), (201, "", "de", "t", 1)]
    leak = text(14)
    rows.append((300, f"{text(20)} {leak} {text(20)}", "en", "s", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.selectExpr("*", "1 as n", "'x' as component_id", "0.5 as quality_score", "true as sampled", "2 as tokens"), leak


def test_stages_keep_what_they_should(spark, tmp_path):
    docs, leak = pool(spark)
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(P.STAGES)
    row = lambda r: (r.doc_id, r.text)
    everything = sorted(map(row, docs.collect()), key=repr)
    # quality: exactly the rows that score enough
    labels = spark.read.parquet(str(tmp_path / "labels.parquet")).selectExpr("doc_id", "quality as label")
    scored = quality.score(docs, quality.train(docs, labels)).collect()
    kept = stages["quality"](spark, docs, str(tmp_path)).collect()
    assert sorted(map(row, kept), key=repr) == sorted((row(r) for r in scored if r.quality_score >= P.THRESHOLD), key=repr)
    # near duplicates: the least of each group, once
    kept = stages["near_dedup"](spark, docs, str(tmp_path))
    assert kept.columns == P.COLUMNS
    kept = [row(r) for r in kept.collect()]
    want = {x for x in everything if x[0] is None or not 100 < x[0] < 200}
    assert sorted(kept, key=repr) == sorted(want, key=repr)
    # decontamination: all but the leak, repeated rows too
    kept = [row(r) for r in stages["decontaminate"](spark, docs, str(tmp_path)).collect()]
    assert sorted(kept, key=repr) == [x for x in everything if x[0] != 300] and " ".join(w.decode() for w in words(leak)) == leak
    # mix draws among the rows; shard places each one
    mixed = [row(r) for r in stages["mix"](spark, docs, str(tmp_path)).collect()]
    assert 0 < len(mixed) < len(everything) and not [x for x in mixed if mixed.count(x) > everything.count(x)]
    placed = stages["shard"](spark, docs, str(tmp_path)).collect()
    assert sorted(repr(r.doc_id) for r in placed) == sorted(repr(x[0]) for x in everything)
    assert len({(r.shard, r.slot) for r in placed}) == len(everything) == sharding.assign(docs).count()
    # and the whole, on its own tables
    final = P.run(spark, str(tmp_path))
    ids = [r.doc_id for r in final.collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and 300 not in ids and not [i for i in ids if 100 < i < 200]


def test_a_hot_group_is_salted(spark, monkeypatch):
    """One pivot with a third of all rows, under limits so low that buckets and pairs are dealt out: the same groups."""
    docs, _ = pool(spark)
    want = sorted(map(repr, neardup.near_duplicates(docs).collect()))
    monkeypatch.setattr(neardup, "HOT", 4)
    monkeypatch.setattr("marlstone.llm.shared.LEAST_HOT", 3)
    assert sorted(map(repr, neardup.near_duplicates(docs).collect())) == want


def test_long_texts_are_signed_in_parts(spark):
    """A text of many parts has the set and signature of the whole."""
    import numpy as np

    from marlstone.llm import kernel

    rng = random.Random(4)
    text = " ".join(f"w{rng.randrange(3000)}" for _ in range(2000)) + "  " + "x" * 3000 + " end of it all now"
    data, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    whole, at = neardup.shingle_sets(data, offsets)
    before, kernel.CHUNK_BYTES = kernel.CHUNK_BYTES, 700
    try:
        parts, _ = neardup.shingle_sets(data, offsets)
    finally:
        kernel.CHUNK_BYTES = before
    assert np.array_equal(np.sort(whole), np.sort(parts)) and len(parts) == at[1]
