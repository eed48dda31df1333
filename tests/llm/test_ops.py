"""Registered operators on small tables: nulls, empty and long texts, ties,
repeated rows, empty tables, extra columns of clashing names."""

import hashlib
import math
import zlib

import numpy as np
import pytest

from tessera.llm import decontamination, embedding_lsh, packing, passages, quality, simhash, suffix_dedup, token_files, toxicity, url_rules
from tessera.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, source string, n int, first string, print string, value string, u string"
LONG = " ".join(f"word{k % 977}" for k in range(30_000))
PASSAGE = " ".join(f"p{k}" for k in range(80))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, None), (2, ""), (3, "   \n "), (4, LONG), (5, LONG), (6, "same text here"), (6, "same text here"), (None, "no id " + PASSAGE), (7, "other start " + PASSAGE + " and an end"), (8, "tiny")]
    return spark.createDataFrame([(i, t, "src0", 1, "x", "y", "z", "w") for i, t in rows], SCHEMA).repartition(3)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for got in (suffix_dedup.remove_repeats(none), token_files.write_and_read(none, vocabulary("byte_bpe_50k.json")), packing.best_fit_pack(none, vocabulary("word_bpe_49k.json")), passages.find(none), simhash.link(none), simhash.deduplicate(none), quality.scores(none), toxicity.classify(none, labels), decontamination.matches(none, items), url_rules.judge(spark.createDataFrame([], "page_id long, url string")), embedding_lsh.link(spark.createDataFrame([], "vec_id long, embedding array<float>"))):
        assert got.count() == 0


def test_suffix_dedup(docs):
    got = sorted(suffix_dedup.remove_repeats(docs).collect(), key=lambda r: (r["doc_id"] or 0, r["n_bytes"]))
    assert len(got) == 10
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_bytes"] == by[2]["n_bytes"] == 0 and by[1]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[4]["n_removed"] == len(LONG) and by[4]["n_spans"] == 1 and by[8]["n_removed"] == 0


def test_token_files(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = sorted(token_files.write_and_read(docs, vocabulary("byte_bpe_50k.json")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 4, 5, 6, 6, 7, 8]
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    ids = np.array([*t.encode("tiny", add_special_tokens=False).ids, 2], "<u4")
    assert got[-1]["n_tokens"] == len(ids) and got[-1]["ids_crc32"] == zlib.crc32(ids.tobytes())


def test_packing(docs):
    got = packing.best_fit_pack(docs, vocabulary("word_bpe_49k.json"), size=4096).collect()
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(r["piece"] == 0 for r in got) == 10


def test_url_rules(spark):
    urls = ["http://A.Example.com/en/7x?q", "https://net/de/1", "http://b.example.net/de/8", "x", None, "http://shop.org/es/#f", "http://z.com/fr/", "http://z.com/fr/"]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_rules.judge(pages).collect()}
    assert [got[k]["rule"] for k in range(8)] == ["example.com/en/7", "net/de/", "example.net/de/8", None, None, "org/es/", None, None]
    assert [got[k]["verdict"] for k in (0, 1, 2, 3, 4, 5)] == ["allow", "allow", "block", "allow", "allow", "block"]
    assert got[0]["host"] == "a.example.com" and got[0]["path"] == "/en/7x" and got[3]["host"] == got[4]["path"] == ""


def test_decontamination_equals_brute_force(spark, docs):
    items = spark.createDataFrame([(1, PASSAGE), (2, "words that no document has at all in it"), (3, None), (4, "tiny")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.matches(docs, items).collect()}
    assert got == {(None, 1): 1.0, (7, 1): 1.0, (8, 4): 1.0}
    words = PASSAGE.split()
    words[40] = "changed"
    near = spark.createDataFrame([(1, "a b " + " ".join(words) + " c")], "doc_id long, text string")
    (row,) = decontamination.matches(near, items).collect()
    assert row["similarity"] == pytest.approx(71 / 81) and row["start_word"] == 2
    assert decontamination.clean(docs, items).count() == 7


def test_passages(docs):
    got = {(r["doc_id"], r["other_doc_id"]): r for r in passages.find(docs).collect()}
    assert got[7, None]["start_word"] == 2 and got[7, None]["end_word"] == 82 and got[7, None]["similarity"] == 1.0
    assert got[5, 4]["end_word"] == 30_000 and set(got) == {(7, None), (5, 4)}
    kept = {r["doc_id"]: r["text"] for r in passages.cut(docs).collect()}
    assert kept[7] == "other start\nand an end" and kept[5] == "" and kept[4] == LONG and kept[1] is None


def test_simhash(docs):
    got = {r["doc_id"]: r for r in simhash.link(docs).collect()}
    assert got[1]["fingerprint"] == "0" * 16 and got[2]["component_id"] == got[3]["component_id"] == 1 and got[5]["component_id"] == 4
    assert simhash.link(docs).count() == 10
    kept = [r["doc_id"] for r in simhash.deduplicate(docs).collect()]
    assert kept.count(6) == 1 and (4 in kept) and (5 not in kept) and (2 not in kept)
    assert simhash.deduplicate(docs).columns == docs.columns


def test_classifiers(spark, docs):
    assert quality.scores(docs).count() == 10 and quality.keep(docs).columns == docs.columns
    rows = [(k, ("you utter idiot " if k % 3 == 0 else "a calm remark ") + " ".join(f"w{(k * 7 + j) % 50}" for j in range(20))) for k in range(900)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(900)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.classify(d, labels).collect()
    out = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in out) >= 0.99 * len(out)


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    near = base[:10] + 0.05 * rng.normal(size=(10, 16))
    rows = [(k, x.tolist()) for k, x in enumerate([*base, *near, base[3], 2 * base[4]])]
    rows += [(100, None), (101, []), (102, [0.0] * 16), (103, [math.nan] + [1.0] * 15), (104, [None] + [1.0] * 15)]
    got = {r["vec_id"]: r for r in embedding_lsh.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = np.vstack([*base, *near, base[3], 2 * base[4]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.95).sum(1) - 1
    assert [got[k]["n_links"] for k in range(len(x))] == links.tolist()
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(100, 105)) and got[50]["component_id"] == 3
