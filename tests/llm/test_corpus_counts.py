"""Source divergence, collocations and the mix against plain versions, with the
odd rows that their docstrings name."""

import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from tessera.llm import collocations, common, divergence, mixing, queries
from tests.compare import differences, sql_rows

RNG = random.Random(11)
WORDS = ["the", "of", "Über", "naïve", "Ω", "x1y", "a_b", "don't", "ÀB", "cat", "CAT", "dog", "io", "zz"]
NAMES = ("op11_source_divergence", "op12_phrase_collocations", "op13_source_mix")


def sentence(n):
    return "".join(RNG.choice(WORDS) + RNG.choice([" ", " ", " ", "  ", "\t", ", ", ".", "!?", "\n", "\x0b", " \r\n"]) for _ in range(n))


ROWS = [(k, sentence(RNG.randint(0, 120)), RNG.choice(["en", "de", None]), RNG.choice(["s1", "s2", "S3", "é", None, "", "a"])) for k in range(150)]
ROWS += [(500 + k, t, "xx", s) for k, (t, s) in enumerate([(None, "p"), ("", "q"), ("1 2 3", "r"), ("lone", "p")])]
ROWS += [(600, "the of " * 400, "en", "s1"), (600, "the of " * 400, "en", "s1"), (None, "no id", None, "s1"), (601, "the cat of the cat " * 9000, "en", "hot")]
ROWS += [(700 + k, "same words here", "en", "hot") for k in range(60)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("counts")
    schema = "doc_id long, text string, lang string, source string, n long, term string, size int, place string"
    spark.createDataFrame([(*r, 7, "clash", 1, "x") for r in ROWS], schema).repartition(5).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def results(spark, sf):
    return {name: queries.queries()[name](spark, sf).toPandas() for name in NAMES}


@pytest.mark.parametrize("name", NAMES[:2])
def test_equals_sql(sf, results, name):
    # duckdb reads one file for a table here
    assert (d := differences(results[name], sql_rows_of(sf, queries.oracle_sql()[name]))) is None, d


def sql_rows_of(sf, sql):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet/*.parquet')")
    return con.execute(sql).df()


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def test_divergence_equals_brute_force(results):
    docs, out = defaultdict(Counter), []
    n = defaultdict(Counter)
    for _, text, lang, source in ROWS:
        found = terms_of(text)
        docs[lang or ""].update(set(found))
        n[lang or "", source or ""].update(found)
    for lang in docs:
        kept = [t for t, k in docs[lang].items() if k >= 3]
        sources = [s for la, s in n if la == lang]

        def shares(count):
            size = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (count[t] + 1) // size for t in kept}

        p = {s: shares(n[lang, s]) for s in sources}
        q = shares(sum((n[lang, s] for s in sources), Counter()))
        far = lambda x, y: (x - y) ** 2 // y
        for s in sources:
            pair = sorted((-sum(far(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            term = sorted((-far(p[s][t], q[t]), t.encode(), t) for t in kept if n[lang, s][t] and p[s][t] > q[t])[:200]
            out += [(lang, s, part, x[2], -x[0], k) for part, xs in (("pair", pair), ("term", term)) for k, x in enumerate(xs, 1)]
    got = [tuple(r) for r in results[NAMES[0]][["lang", "source", "part", "item", "value", "rank"]].itertuples(index=False)]
    assert sorted(got) == sorted(out)


def test_divergence_of_very_many_sources(spark, monkeypatch):
    """More sources than a task works out at once."""
    monkeypatch.setattr(divergence, "CELLS", 64)
    posting = [(k, 10 + 7 * k % 50, 5 + k % 3) for k in range(1, 41)]
    rows = spark.createDataFrame([("en", posting)], "lang string, posting array<struct<id:bigint,p:bigint,zero:bigint>>").toArrow().to_batches()
    got = {(a, b): v for batch in divergence.both(rows) for _, a, b, v in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
    f = lambda p, q: (p - q) ** 2 // q
    for (a, p, z), (b, q, y) in itertools.permutations(posting, 2):
        assert got.get((a, b), 0) == f(p, q) - f(p, y) - f(z, q) + f(z, y)


def test_collocations_equal_brute_force(results):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang, _ in ROWS:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for n in (1, 2, 3):
                f[lang or "und"].update(zip(*(w[k:] for k in range(n)), strict=False))
    out = []
    for lang, count in f.items():
        cand = {g: a for g, a in count.items() if len(g) > 1 and a >= 10}
        rows = []
        for g, a in cand.items():
            if any(len(o) > len(g) and any(o[i : i + len(g)] == g for i in range(len(o))) and 100 * b >= 50 * a for o, b in cand.items()):
                continue
            score, _, left, right = min((10**6 * a * a // (count[g[:k]] * count[g[k:]]), k, count[g[:k]], count[g[k:]]) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, total[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(rows)[:2000], 1)]
    got = [tuple(r) for r in results[NAMES[1]][["lang", "rank", "phrase", "a", "l", "r", "n", "score"]].itertuples(index=False)]
    assert got and sorted(got) == sorted(out)


def test_long_pieces_keep_their_counts():
    words = [f"w{k % 7}" for k in range(3 * collocations.LONG + 5)]
    got, want = Counter(), Counter()
    for piece, ahead in collocations.pieces_of(" ".join(words).encode()):
        w = piece.decode().split(" ")
        for k in range(len(w) - ahead):
            for n in (1, 2, 3):
                if k + n <= len(w):
                    got[tuple(w[k : k + n])] += 1
    for n in (1, 2, 3):
        want.update(zip(*(words[k:] for k in range(n)), strict=False))
    assert got == want


def test_words_of_long_texts_in_slices(monkeypatch):
    monkeypatch.setattr(common, "SLICE", 16)
    for text in (b"", b" ", b"a" * 50, b"a" * 50 + b" b\n" + b"c" * 40, b"the cat  sat \n on" * 20, b" " * 100 + b"x"):
        assert [w for part in common.word_slices(text) for w in part] == text.split()


def water(sizes, total=1.5):
    """Targets by the contract's words: share, stop at twice, share the rest again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s)
    names += [None] if None in sizes else []
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), total * sum(sizes.values())
    while free and left > 1e-9:
        unit = left / sum(w[s] for s in free)
        left = 0.0
        for s in list(free):
            target[s] += unit * w[s]
        for s in list(free):
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                free.remove(s)
    return target


def test_mix_meets_its_targets(spark, sf, results):
    sizes = Counter()
    for _, text, _, source in ROWS:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = water(sizes)
    rows = mixing.mix(common.read(spark, sf, "documents")).toPandas()
    assert len(rows) == len(ROWS)
    rows["source"] = rows["source"].astype(object).where(rows["source"].notna(), None)
    for source, some in rows.groupby("source", dropna=False):
        source = None if source != source or source is None else source
        assert set(some["source_size"]) == {sizes[source]}
        assert abs(some["target"].iloc[0] - want[source]) < 1e-6
        sums = 1  # a bit for each sum that documents make, each used up to twice
        for n in [*some["size"], *some["size"]]:
            sums |= sums << int(n)
        nearest = min(abs(k - want[source]) for k, bit in enumerate(reversed(bin(sums)[2:])) if bit == "1")
        assert abs(some["taken"].sum() - want[source]) <= nearest + 1
    assert (rows["taken"] == rows["size"] * rows["uses"]).all() and rows["uses"].between(0, 2).all()
    keys = ["doc_id", "size", "source_size", "target", "taken"]
    assert differences(rows[keys], results[NAMES[2]][keys]) is None  # reruns agree


def test_fit_is_the_nearest_sum():
    rng = random.Random(5)
    for _ in range(300):
        lengths = sorted(rng.sample(range(1, 40), rng.randint(1, 5)))
        counts = [rng.randint(1, 4) for _ in lengths]
        budget = rng.randint(0, sum(a * b for a, b in zip(lengths, counts, strict=True)))
        take = mixing.fit(lengths, counts, budget)
        assert all(0 <= t <= n for t, n in zip(take, counts, strict=True))
        best = min(abs(budget - sum(a * b for a, b in zip(lengths, t, strict=True))) for t in itertools.product(*(range(n + 1) for n in counts)))
        assert abs(budget - sum(a * b for a, b in zip(lengths, take, strict=True))) == best


def test_fit_of_large_budgets_is_exact():
    take = mixing.fit([3, 50, 401, 20_000], [10**7, 10**6, 10**5, 10**4], 123_456_789)
    assert sum(a * b for a, b in zip((3, 50, 401, 20_000), take, strict=True)) == 123_456_789
    assert mixing.fit([500_000], [3], 700_000) == [1] and mixing.fit([500_000], [3], 800_000) == [2]


def test_hot_size_is_selected_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 50)
    docs = spark.range(3000).selectExpr("id AS doc_id", "'a b c' AS text", "CASE WHEN id % 3 = 0 THEN 'x' ELSE 'y' END AS source")
    rows = mixing.mix(docs).toPandas()
    got = rows.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((got["target"] - got["taken"]).abs() <= 3).all()
    out = mixing.write_out(docs, mixing.mix(docs))
    assert out.columns == docs.columns and out.count() * 3 == rows["taken"].sum()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    for f in (divergence.audit, collocations.mine, mixing.mix):
        assert f(none).count() == 0
