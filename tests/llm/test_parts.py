"""The operators' inner parts against plain versions (no Spark)."""

import io
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import embedding_lsh, packing, passages, quality, simhash, suffix_dedup, token_files
from tessera.llm.encoding import PieceEncoder
from tessera.llm.queries import vocabulary


@pytest.mark.parametrize(("name", "split"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_pieces_encode_like_whole_texts(name, split):
    rng = random.Random(3)
    e = PieceEncoder(vocabulary(name), split)
    texts = ["", "  a  b\n\n c", "é́ a ́b", "don't we'LL", "a|b | c", "a\x1cb", "<|endoftext|> x", "日本 語\r\n", "x\x01y"]
    texts += ["".join(rng.choice("ab \n'|s.,é\t1 ") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    for text, raw in zip(texts, e.encode(texts), strict=True):
        assert raw == np.array(e.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes_round_trip(kind):
    rng, sink = np.random.default_rng(1), io.BytesIO()
    docs = [(k if k % 5 else None, rng.integers(0, 60000, rng.integers(0, 300), dtype="u4").tobytes()) for k in range(60)]
    w = token_files.PlaneWriter(sink, kind, block=128)
    for doc, raw in docs:
        w.add(doc, raw)
    w.close()
    got = [(d, ids.tobytes()) for d, _, ids in token_files.PlaneReader(io.BytesIO(sink.getvalue())).documents()]
    assert got == docs
    with pytest.raises(ValueError, match="cut short"):
        token_files.PlaneReader(io.BytesIO(sink.getvalue()[:-3]))


def test_packing_equals_piece_by_piece_best_fit():
    rng = random.Random(5)
    for size in (10, 37, 100):
        lengths = [rng.randint(1, size) for _ in range(400)]
        plan, bins = packing.best_fit_decreasing(dict(Counter(lengths)), size)
        left = []
        for x in sorted(lengths, reverse=True):
            fits = [b for b in range(len(left)) if left[b] >= x]
            if fits:
                left[min(fits, key=lambda b: left[b])] -= x
            else:
                left.append(size - x)
        assert bins == len(left)
        place, runs = {}, sorted(plan)
        for x, c in Counter(lengths).items():
            for rank in range(c):
                _, first_rank, first_bin, offset, fits = max(r for r in runs if r[0] == x and r[1] <= rank)
                k = rank - first_rank
                place.setdefault(first_bin + k // fits, []).append((offset + k % fits * x, x))
        for parts in place.values():
            at = 0
            for offset, x in sorted(parts):
                assert offset == at
                at += x
            assert at <= size


def test_repeated_bytes_equal_brute_force():
    rng = random.Random(2)
    base = bytes(rng.choice(b"abcd ") for _ in range(900))
    texts = [base, base[100:700] + b"!" + base[300:800], b"x" * 1000, bytes(rng.choice(b"ab") for _ in range(500)), base[:399], b""]
    found = {}
    rows = {}
    for t in texts:
        for h, first, n, rel in suffix_dedup.super_strings(t):
            for core, left, right, start in suffix_dedup.pieces(t, first, n, rel):
                rows.setdefault((core, left, right), []).append((t, start))
    keys = list(rows)
    flags = suffix_dedup.repeated([k[0] for k in keys], [k[1] for k in keys], [k[2] for k in keys], np.array([len(rows[k]) for k in keys]))
    for k, f in zip(keys, flags, strict=True):
        for t, start in rows[k]:
            found.setdefault(t, set()).update(start + np.flatnonzero(f))
    count = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    for t in texts:
        assert found.get(t, set()) == {i for i in range(len(t) - 399) if count[t[i : i + 400]] > 1}
        starts = sorted(s for _, f, n, _ in suffix_dedup.super_strings(t) for s in range(f, f + n))
        assert starts == list(range(max(0, len(t) - 399)))


def test_simhash_plan_keeps_the_pigeonhole():
    some = np.random.default_rng(4).integers(0, 2**63, 500, dtype="u8")
    for total in (10, 10**5, 10**8, 10**10):
        parts = simhash.plan(some, total, 3)
        assert sum(t + 1 for _, t in parts) == 4
        bits = [b for g, _ in parts for b in g]
        assert len(bits) == len(set(bits))
    assert simhash.fingerprint(simhash.shingle_hashes("", 3)) == 0
    assert len(simhash.shingle_hashes("a b", 3)) == 1


def test_hadamard_keeps_lengths_and_codes_meet():
    x = np.random.default_rng(0).normal(size=(5, 8))
    assert np.allclose((embedding_lsh.hadamard(x) ** 2).sum(1), 8 * (x**2).sum(1))
    c = embedding_lsh.codes(np.vstack([x, 2 * x]), range(4), 2)
    assert (c[:5] == c[5:]).all()


def test_chaining_finds_a_fuzzy_passage():
    rng = random.Random(9)
    passage = [f"w{rng.randint(0, 10**6)}" for _ in range(90)]
    other = [w for k, w in enumerate(passage) if k not in (33, 71)]
    a = [f"a{k}" for k in range(40)] + passage + [f"b{k}" for k in range(30)]
    b = [f"c{k}" for k in range(10)] + other + [f"d{k}" for k in range(50)]
    ha, hb = passages._hashes(" ".join(a)), passages._hashes(" ".join(b))
    (xa, pa), (xb, pb) = passages.seeds(ha), passages.seeds(hb)
    at = {int(x): int(p) for x, p in zip(xb, pb, strict=True)}
    pairs = [(int(p), at[int(x)]) for x, p in zip(xa, pa, strict=True) if int(x) in at]
    best = passages.chains(passages.segments(*map(np.array, zip(*pairs, strict=True))))[0]
    (p, e, q, f, s), *_ = passages.align(ha, hb, best)
    assert (p, e, q, f) == (40, 130, 10, 98) and s == pytest.approx(2 * 88 / 178)


def test_weak_labels_tell_bad_texts():
    good = "The words of the text go on and on in a plain way, as it was with the other. " * 4 + " ".join(f"item{k}" for k in range(60))
    bad = [" | ".join(f"Cell{k}" for k in range(80)), " ".join(f"w{k}%%%" for k in range(80)), "Der " * 200, " ".join(f"LOUD{k}!!" for k in range(80))]
    counts = Counter(quality.votes(t) for t in [good] * 40 + bad)
    posterior, accuracy = quality.weak_labels(sorted(counts.items()))
    assert posterior[quality.votes(good)] > 0.9 and all(posterior[quality.votes(t)] < 0.5 for t in bad)
    assert accuracy.shape == (2, len(quality.LABELLERS))
    assert quality.votes(None) == quality.votes("  ")


def test_tables_reach_the_recall_for_any_number_of_hashes():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    y = 0.95 * x + math.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    for hashes in range(1, 6):
        tables = range(embedding_lsh.tables_for(32, hashes, 0.95, 0.99))
        a, b = embedding_lsh.codes(x, tables, hashes), embedding_lsh.codes(y, tables, hashes)
        met = (a[:, :, 0] == b[:, :, 0]) | (a[:, :, 1] == b[:, :, 0]) | (a[:, :, 0] == b[:, :, 1])
        assert met.any(1).mean() > 0.98


def test_seeds_find_passages_of_many_single_word_changes():
    rng = random.Random(11)
    for size, every in ((60, 8), (60, 6), (60, 5), (120, 6), (200, 5)):
        passage = [f"w{rng.randint(0, 10**6)}" for _ in range(size)]
        other = [w if k % every else f"x{k}" for k, w in enumerate(passage)]
        ha = passages._hashes(" ".join([f"a{k}" for k in range(40)] + passage + [f"b{k}" for k in range(30)]))
        hb = passages._hashes(" ".join([f"c{k}" for k in range(10)] + other + [f"d{k}" for k in range(50)]))
        (xa, pa), (xb, pb) = passages.seeds(ha), passages.seeds(hb)
        at = {int(x): int(p) for x, p in zip(xb, pb, strict=True)}
        pairs = [(int(p), at[int(x)]) for x, p in zip(xa, pa, strict=True) if int(x) in at]
        assert len(pairs) >= 7
        best = passages.chains(passages.segments(*map(np.array, zip(*pairs, strict=True))))[0]
        assert any(e - p >= size - 6 and s >= 0.8 for p, e, _, _, s in passages.align(ha, hb, best))


@pytest.mark.parametrize("edits", ["di", "d", "i", "s", "dis"])
def test_passages_with_deletions_and_insertions_are_found_whole(edits):
    """Deleted, inserted and changed words in turn: stretches lie on other diagonals; a brute-force alignment says how alike the two are."""
    rng = random.Random(3)
    for size, every in itertools.product((70, 120, 200), (12, 10, 8, 6)):
        words, other = [f"w{rng.randint(0, 10**6)}" for _ in range(size)], []
        for k, w in enumerate(words):
            edit = edits[k // every % len(edits)] if k and k % every == 0 else ""
            other += {"d": [], "i": [f"x{k}", w], "s": [f"y{k}"], "": [w]}[edit]
        ha = passages._hashes(" ".join([f"a{k}" for k in range(40)] + words + [f"b{k}" for k in range(30)]))
        hb = passages._hashes(" ".join([f"c{k}" for k in range(10)] + other + [f"d{k}" for k in range(50)]))
        row = [0] * (len(other) + 1)
        for w in words:
            row = list(itertools.accumulate([0, *(max(row[k + 1], row[k] + (w == y)) for k, y in enumerate(other))], max))
        assert 2 * row[-1] / (len(words) + len(other)) >= 0.8
        (xa, pa), (xb, pb) = passages.seeds(ha), passages.seeds(hb)
        at = {int(x): int(p) for x, p in zip(xb, pb, strict=True)}
        pairs = [(int(p), at[int(x)]) for x, p in zip(xa, pa, strict=True) if int(x) in at]
        found = passages.chains(passages.segments(*map(np.array, zip(*pairs, strict=True))))
        got = [x for b in passages.bundles(found) for x in passages.passages_of(ha, hb, b)]
        assert any(p <= 40 + every and e >= 40 + size - every for p, e, *_ in got), (size, every)


def test_links_of_many_words_fold_where_they_touch():
    p, q, n = np.array([0, 4, 30, 2, 34, 60]), np.array([10, 14, 40, 90, 44, 70]), np.array([4, 4, 4, 50, 4, 4])
    assert passages.segments(p, q, n) == [(0, 10, 8), (2, 90, 50), (30, 40, 8), (60, 70, 4)]
    assert passages.segments(p[[0, 1]], q[[0, 1]]) == [(0, 10, 8)]


def test_star_links_the_first_and_the_previous_holder():
    seed, doc = np.full(4, 7, "u4"), np.array([30, 10, 20, 40], "i8")
    text, at = np.array([3, 1, 2, 1], "i4"), np.array([5, 6, 7, 6], "i4")  # the last is a copy of text 1
    u, v = passages.star(seed, doc, text, at)
    assert {(int(doc[a]), int(doc[b])) for a, b in zip(u, v, strict=True)} == {(20, 10), (30, 10), (30, 20)}


def test_all_holders_of_a_seed_meet_and_frequent_seeds_grow():
    def linked(texts):
        x = [passages.seeds(passages._hashes(t))[0] for t in texts]
        n = [len(k) for k in x]
        seed, doc = np.concatenate(x).astype("u4"), np.repeat(np.arange(len(x)), n)
        text, at = doc.astype("i4"), np.concatenate([np.arange(k) for k in n]).astype("i4")
        u, v, frequent = passages.meetings(seed, doc, text, at)
        out = {(int(doc[a]), int(doc[b])) for a, b in zip(u, v, strict=True)}
        sizes = passages.lengths(50)
        runs = [np.concatenate(r)[frequent] for r in zip(*(passages.longer(k, sizes) for k in x), strict=True)]
        for _, u, v in passages.grown(seed[frequent], doc[frequent], text[frequent], at[frequent], runs):
            out |= {(int(doc[frequent][a]), int(doc[frequent][b])) for a, b in zip(u, v, strict=True)}
        return out

    few = linked([f"a{k} some four words here b{k}" for k in range(6)])
    assert few == {(i, j) for i in range(6) for j in range(i)}
    lines = [" ".join(f"l{k}w{w}" for w in range(9)) for k in range(7)]
    rng = random.Random(5)
    texts = [" x ".join(f"{line} y{k}" for line in rng.sample(lines, 7)) for k in range(60)]
    whole = " ".join(lines)
    assert (61, 30) in linked([*texts[:30], f"one {whole} two", *texts[30:], f"three {whole} four"])
    many = linked([f"a{k} {whole} b{k}" for k in range(40)])
    assert {(i, 0) for i in range(1, 40)} <= many and len(many) < 3 * 40


@pytest.mark.parametrize("holders", [2, 20])
@pytest.mark.parametrize("changed", [False, True])
def test_a_passage_whose_pieces_have_other_holders_is_found(spark, holders, changed):
    """For each piece other texts hold it before each of the two, and no more of the passage."""
    pieces = [[f"p{k}w{w}" for w in range(9)] for k in range(7)]

    def passage(name):
        return [w for j, p in enumerate(pieces) for w in ([*p, f"{name}{j}"] if changed and j < 6 else p)]

    def others(name):
        return [" ".join([f"{name}{k}x{j}", *p, f"{name}{k}y{j}"]) for k in range(holders) for j, p in enumerate(pieces)]

    texts = [*others("a"), " ".join(["one", *passage("b"), "two"]), *others("c"), " ".join(["three", "four", *passage("d"), "five"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [(r["doc_id"], r["other_doc_id"], r["start_word"], r["end_word"], r["other_start"]) for r in passages.find(docs).collect()]
    n = len(passage("b"))
    assert found == [(14 * holders + 1, 7 * holders, 2, 2 + n, 1)]


def test_passages_that_cover_hold_every_word_of_all():
    rng = random.Random(6)
    for _ in range(500):
        spans = [(a, a + rng.randint(1, 9)) for a in (rng.randint(0, 30) for _ in range(rng.randint(0, 9)))]
        words = [w for k in passages.cover(spans) for w in range(*spans[k])]
        assert set(words) == {w for s in spans for w in range(*s)}
        assert all(words.count(w) <= 2 for w in words)


def test_text_that_repeats_itself_makes_few_passages(spark):
    texts = [" ".join([f"t{k}", *["over again"] * (60 if k < 2 else 150 + k), f"u{k}"]) for k in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs, words = {}, {}
    for r in passages.find(docs).collect():
        pairs.setdefault((r["doc_id"], r["other_doc_id"]), []).append(r)
        words.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    assert {i for i, _ in pairs} == set(range(1, 8)) and all((i, 0) in pairs for i in range(1, 8))
    assert all(words[i] == set(range(1, len(texts[i].split()) - 1)) for i in words)
    assert max(len(rows) for rows in pairs.values()) <= 8


def test_equal_words_and_packs():
    rng = np.random.default_rng(9)
    for _ in range(300):
        a, b = (rng.integers(0, 6, rng.integers(0, 49)).astype("u8") for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = list(itertools.accumulate([0, *(max(row[k + 1], row[k] + (x == y)) for k, y in enumerate(b))], max))
        assert passages._equal_words(a, b) == row[-1]
    rows = [tuple(rng.integers(0, 90, n).astype(d) for d in ("i8", "i4")) for n in (0, 5, 700, 3, 0, 40)]
    packs = list(passages._in_packs(rows, {"x": "i8", "y": "i4"}, 100, lambda x, y: x % 7))
    assert len(packs) == 2
    got = sorted(z for p in packs for k in range(len(p)) for z in zip(*(passages._unpack([p.column(c)[k].as_py()], d).tolist() for c, d in ((1, "i8"), (2, "i4"))), [p.column(0)[k].as_py()] * 9999))
    assert got == sorted((int(x), int(y), int(x) % 7) for r in rows for x, y in zip(*r))
