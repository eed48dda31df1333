"""Each registered query against a plain version on one small corpus."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tessera.llm import queries, url_rules
from tests.compare import differences, sql_rows

RNG = random.Random(21)
WORDS = [f"{a}{b}{k}" for k in range(30) for a in ("Bo", "ta", "Ré") for b in ("na", "lu")]


def some(n):
    return [RNG.choice(WORDS) for _ in range(n)]


def corpus():
    passage, item = some(90), some(40)
    texts = [None, "", " \n", "one", "a b", "A  b", " ".join(some(3000)), "x" * 900, "y" * 900 + " z"]
    base = some(120)
    for k in range(12):  # near copies
        w = list(base)
        for at in RNG.sample(range(120), k % 4):
            w[at] = f"new{k}"
        texts.append(" ".join(w))
    for k in range(10):  # passages, some fuzzy
        w = list(passage)
        if k % 2:
            w[30] = f"odd{k}"
        texts.append(" ".join(some(40 + k) + w + some(35)))
    for k in range(8):  # leaks, some fuzzy
        w = list(item)
        if k % 2:
            w[20] = "changed"
        texts.append(" ".join(some(25 + k) + w + some(30)))
    texts += [" ".join(some(RNG.randint(1, 300))) for _ in range(60)]
    texts += [texts[6], texts[20], texts[20], texts[30]]
    ids = list(range(len(texts)))
    RNG.shuffle(ids)
    rows = [*zip(ids, texts, strict=True), (None, "no id " + " ".join(passage)), (ids[5], texts[5])]
    items = [(1, " ".join(item)), (2, None), (3, "one"), (4, " ".join(some(30)))]
    return rows, items


ROWS, ITEMS = corpus()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rng = random.Random(3)
    urls = [f"http://{rng.choice(['a', 'blog', 'm'])}.{rng.choice(['x', 'win'])}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randint(1, 99)}" for _ in range(400)] + [None, "nothing"]
    spark.createDataFrame([(k, u, "") for k, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    x = np.random.default_rng(2).normal(size=(200, 12))
    x = np.vstack([x, x[:60] + 0.08 * np.random.default_rng(4).normal(size=(60, 12)), x[:5]])
    vectors = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [0.0] * 12), (902, [float("nan")] * 12)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def groups(n, near):
    home = list(range(n))

    def top(i):
        while home[i] != i:
            i = home[i]
        return i

    for i, j in itertools.combinations(range(n), 2):
        if near(i, j):
            home[top(j)] = top(i)
    return [top(i) for i in range(n)]


def test_op1(spark, sf):
    raw = [(i, (t or "").encode()) for i, t in ROWS]
    count = Counter(b[k : k + 400] for _, b in raw for k in range(len(b) - 399))
    want = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - 399):
            if count[b[k : k + 400]] > 1:
                gone[k : k + 400] = b"\x01" * 400
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((i, len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in queries.op1_suffix_dedup(spark, sf).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and any(w[2] for w in want)


def test_op2(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    encoded = [(i, np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")) for i, x in ROWS]
    got = sorted(queries.op2_token_output(spark, sf).collect(), key=lambda r: r["start"])
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=repr) == sorted(((i, len(x), zlib.crc32(x.tobytes())) for i, x in encoded), key=repr)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert ids == sorted(ids)


def test_op3(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    want, lengths = [], []
    for i, x in ROWS:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want.append((i, k // 4096, k, len(part), zlib.crc32(part.tobytes())))
            lengths.append(len(part))
    got = queries.op3_best_fit_packing(spark, sf).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got), key=repr) == sorted(want, key=repr)
    left = []
    for x in sorted(lengths, reverse=True):
        fits = [b for b in range(len(left)) if left[b] >= x]
        if fits:
            left[min(fits, key=lambda b: left[b])] -= x
        else:
            left.append(4096 - x)
    place = {}
    for r in got:
        place.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(place) == len(left)
    for parts in place.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096


def test_op4(spark, sf):
    def tokens(host, path):
        return list(dict.fromkeys(k + ("#" if w[0].isdigit() else w) for k, x in (("h:", host), ("p:", path)) for w in re.findall("[a-z]+|[0-9]+", x.lower())))

    pages = []
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        host, path = "", ""
        if r["url"] and "://" in r["url"]:
            host, path = re.match("([^/?#]*)([^?#]*)", r["url"].split("://", 1)[1]).groups()
        fits = [(len(h + p), h + p, v) for h, p, v in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        pages.append((r["page_id"], host, path, max(fits, default=None), tokens(host, path)))
    labelled = [(set(t), f[2]) for *_, f, t in pages if f]
    n = len(labelled)
    seen = Counter(t for s, _ in labelled for t in s)
    known = sorted(t for t, c in seen.items() if 0.01 * n <= c <= 0.99 * n)
    rules = {}
    for size in range(1, 7):
        for need in itertools.combinations(known, size):
            hit = [v for s, v in labelled if s.issuperset(need)]
            for v in ("allow", "block"):
                if hit and hit.count(v) >= 0.01 * n and hit.count(v) >= 0.8 * len(hit):
                    rules[need, v] = (hit.count(v) / len(hit), hit.count(v) / n)
    kept = {k: x for k, x in rules.items() if not any(rules.get((k[0][:j] + k[0][j + 1 :], k[1]), (0,))[0] >= x[0] for j in range(len(k[0])))}
    want, mined = {}, Counter()
    for i, host, path, fit, own in pages:
        best = max(((*x, v) for (need, v), x in kept.items() if set(own).issuperset(need)), default=None)
        want[i] = (host, path, fit[1] if fit else None, fit[2] if fit else best[2] if best else "allow")
        mined[want[i][3]] += fit is None
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in queries.op4_url_filter(spark, sf).collect()}
    assert got == want and mined["block"] and mined["allow"]


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []


def leaks(rows, items):
    out = {}
    for i, text in rows:
        s = shingles(text)
        for item, x in items:
            b = shingles(x)
            if not s or not b:
                continue
            best = None
            for start in range(max(1, len(s) - len(b) + 1)):
                a, c = Counter(s[start : start + len(b)]), Counter(b)
                both = (a & c).total()
                value = both / (a.total() + c.total() - both)
                if value >= 0.8 and (best is None or value > best[0]):
                    best = (value, start)
            if best:
                out[i, item] = max(best, out.get((i, item), best), key=lambda b: (b[0], -b[1]))
    return out


def test_op5(spark, sf):
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"]) for r in queries.op5_decontamination(spark, sf).collect()}
    want = leaks(ROWS, ITEMS)
    assert {k: (got.get(k), want.get(k)) for k in got.keys() | want.keys() if got.get(k) != want.get(k)} == {} and len(want) > 4


def test_op5_and_op10_equal_their_sql(spark, sf):
    for name in queries.oracle_sql():
        got = queries.queries()[name](spark, "/root/testdata/sf0.001").toPandas()
        assert (d := differences(got, sql_rows("/root/testdata/sf0.001", queries.oracle_sql()[name]))) is None, d


def common_words(a, b):
    row = np.zeros(len(b) + 1, int)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + np.array([x == y for y in b])))
    return int(row[-1])


def test_op6(spark, sf):
    got = queries.op6_substring_dedup(spark, sf).collect()
    texts = {}
    for i, t in ROWS:
        texts.setdefault(i, (t or "").lower().split())
    for r in got:  # what is reported holds
        a, b = texts[r["doc_id"]][r["start_word"] : r["end_word"]], texts[r["other_doc_id"]][r["other_start"] : r["other_end"]]
        assert len(a) >= 50 and 2 * common_words(a, b) / (len(a) + len(b)) >= 0.8 - 1e-9
    hit = {}
    for r in got:
        hit.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    order = sorted(texts, key=lambda i: (i is not None, i))
    first = {}
    for i in order:  # every run of 50 words that an earlier document holds is covered
        w = texts[i]
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) != i:
                assert set(range(k, k + 50)) <= hit.get(i, set()), (i, k)
    assert len(hit) > 20


def test_op7(spark, sf):
    prints = []
    for _, text in ROWS:
        w = (text or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    home = groups(len(ROWS), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    least = {}
    for g, (i, _) in zip(home, ROWS, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = [(i, f"{p:016x}", least.get(g)) for (i, _), p, g in zip(ROWS, prints, home, strict=True)]
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries.op7_simhash(spark, sf).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_op8_tells_planted_junk(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r["doc_id"]: r["kept"] for r in queries.op8_quality(spark, sf).collect()}
    bad, good = [i for i, q in labels.items() if q == 0], [i for i, q in labels.items() if q == 1]
    assert sum(not kept[i] for i in bad) >= 0.9 * len(bad) and sum(kept[i] for i in good) >= 0.99 * len(good)


def test_op10(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.array([np.array(r["embedding"] if r["vec_id"] < 900 else [1.0] * 12, float) for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    for k, r in enumerate(rows):
        if r["vec_id"] >= 900:
            linked[k], linked[:, k] = False, False
    home = groups(len(rows), lambda i, j: linked[i, j])
    least = {}
    for g, r in zip(home, rows, strict=True):
        least[g] = min(least.get(g, r["vec_id"]), r["vec_id"])
    want = sorted((r["vec_id"], int(linked[k].sum()), least[home[k]], r["vec_id"] == least[home[k]]) for k, r in enumerate(rows))
    assert sorted(tuple(r) for r in queries.op10_embedding_near_dedup(spark, sf).collect()) == want


def test_pipeline_stage_by_stage(spark, sf):
    """Each stage's rows against a plain version on the stage's own input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        docs = spark.createDataFrame(out := stage(spark, docs, sf).collect(), docs.schema) if name != "best_fit_packing" else stage(spark, docs, sf)
        if name == "quality_classifier":
            kept = {r["doc_id"] for r in queries.op8_quality(spark, sf).filter("kept").collect()}
            assert {r["doc_id"] for r in out} == kept
        elif name == "simhash_near_dedup":
            sets = [set(zip(*((r["text"] or "").lower().split()[k:] for k in range(5)), strict=False)) or {tuple((r["text"] or "").lower().split())} for r in before]
            home = groups(len(before), lambda i, j: (before[i]["text"] or "") == (before[j]["text"] or "") or ((s := len(sets[i] & sets[j])) and {()} not in (sets[i], sets[j]) and 5 * s >= 4 * len(sets[i] | sets[j])))
            least = {}
            for g, r in zip(home, before, strict=True):
                key = (r["doc_id"] is None, r["doc_id"])
                least[g] = min(least.get(g, key), key)
            assert sorted((r["doc_id"] is None, r["doc_id"]) for r in out) == sorted(least.values())
        elif name == "substring_dedup":
            assert len(out) == len(before)
            seen = {}
            for r in sorted(out, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
                for line in (r["text"] or "").split("\n"):  # cuts leave line ends
                    w = line.lower().split()
                    for k in range(len(w) - 49):
                        assert seen.setdefault(tuple(w[k : k + 50]), r["doc_id"]) == r["doc_id"]
        elif name == "benchmark_decontamination":
            dirty = {i for i, _ in leaks([(r["doc_id"], r["text"]) for r in before], ITEMS)}
            assert sorted((r["doc_id"] for r in out), key=repr) == sorted((r["doc_id"] for r in before if r["doc_id"] not in dirty), key=repr) and dirty
        else:
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before}


def test_clashing_columns_come_through(spark):
    from tessera.llm import decontamination, passages, simhash

    names = ("dirty", "own", "row", "spans", "id", "d", "i", "digest", "first_id", "_own", "_spans", "_digest", "_id")
    text = " ".join(f"w{k}" for k in range(80))
    docs = spark.createDataFrame([(k, t, *[f"{k}{n}" for n in names]) for k, t in enumerate([text, text, "other " + text, None])], f"doc_id long, text string, {', '.join(f'{n} string' for n in names)}")
    items = spark.createDataFrame([(1, "nothing like it")], "item_id long, text string")
    for got, ids in ((decontamination.clean(docs, items), {0, 1, 2, 3}), (simhash.deduplicate(docs), {0, 3}), (passages.cut(docs), {0, 1, 2, 3})):
        rows = got.collect()
        assert got.columns == docs.columns and {r["doc_id"] for r in rows} == ids
        assert all(r[n] == f"{r['doc_id']}{n}" for r in rows for n in names)
