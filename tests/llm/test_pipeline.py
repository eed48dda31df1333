"""The pipeline's stages against brute force."""

import random

import numpy as np

import corpus_pipeline
from tessera.llm import passages, simhash


def _components(texts, k=5, similarity=0.8):
    sets = [set(simhash.shingle_hashes(t, k).tolist()) for t in texts]
    home = list(range(len(texts)))

    def top(i):
        while home[i] != i:
            i = home[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 10 * both >= round(10 * similarity) * (len(a) + len(sets[j]) - both) and both:
                home[top(i)] = top(j)
    return [top(i) for i in range(len(texts))]


def _kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, None).collect()}
    least = {}
    for i, c in enumerate(_components(texts)):
        least.setdefault(c, i)
    return got, set(least.values())


def test_near_duplicates_of_a_large_group_equal_brute_force(spark):
    rng = random.Random(4)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(150):  # all hold the first words, so that many meet under one minimum hash
        words = list(base)
        for at in rng.sample(range(20, 60), rng.randint(1, 2)):
            words[at] = f"new{k}x{at}"
        texts.append(" ".join(words))
    got, want = _kept(spark, texts)
    assert got == want


def test_near_duplicates_of_short_texts_equal_brute_force(spark):
    texts = []
    for p in range(60):  # pairs at exactly 0.8, of 4 and 5 or 16 and 20 shingles
        words = [f"p{p}x{k}" for k in range(9 if p % 2 else 24)]
        texts += [" ".join(words), " ".join(words[: 8 if p % 2 else 20])]
    got, want = _kept(spark, texts)
    assert got == want and len(want) == 60


def test_copies_are_cut_whole_whatever_their_white_space(spark):
    for space in (" ", "　", "\x1c", "\xa0 ", " ", "\x85"):
        text = space + space.join(f"w{k}" for k in range(60))
        docs = spark.createDataFrame([(1, text), (2, text), (3, "other")], "doc_id long, text string")
        found = passages.find(docs).collect()
        assert [(r["doc_id"], r["other_doc_id"], r["start_word"], r["end_word"]) for r in found] == [(2, 1, 0, 60)], repr(space)
        assert {r["doc_id"]: r["text"] for r in passages.cut(docs).collect()} == {1: text, 2: "", 3: "other"}


def test_fingerprints_bring_near_duplicates_together_that_minimum_hashes_miss(spark):
    base = " ".join(["one two three four five"] * 50)
    texts = [base, f"{base} x11017", "some other text of a few words"]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    assert len(sets[0] & sets[1]) / len(sets[0] | sets[1]) > 0.8
    a, b = (simhash.minimum_hashes(np.unique(simhash.shingle_hashes(t, 5))) for t in texts[:2])
    assert not set(a) & set(b)
    got, want = _kept(spark, texts)
    assert got == want == {0, 2}
