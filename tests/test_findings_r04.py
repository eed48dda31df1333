"""What the findings of the fourth round named, on small rows."""

import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera import parsers
from tessera.functions import text as tx
from tessera.operators import fulltext, indexing, layers, postings, profiles, ranking, symbols, vectors
from tessera.parsers import documents
from tessera.plans import fixture


def test_f15_equal_sums_stay_equal_in_any_order(spark):
    rows = [(1, x) for x in (0.1, 0.2, 0.3)] + [(2, x) for x in (0.3, 0.2, 0.1)]
    sums = spark.createDataFrame(rows, "id int, x double").coalesce(1).groupBy("id").agg(ranking.exact_sum(F.col("x")).alias("s"), F.sum("x").alias("plain"))
    got = {r["id"]: (r["s"], r["plain"]) for r in sums.collect()}
    assert got[1][1] != got[2][1] and got[1][0] == got[2][0] == 0.6
    odd = spark.createDataFrame([(float("inf"),), (1.5,), (None,)], "x double").agg(ranking.exact_sum(F.col("x"))).first()[0]
    assert odd == float("inf") and spark.createDataFrame([(None,)], "x double").agg(ranking.exact_sum(F.col("x"))).first()[0] is None


def test_f16_rounds_halves_as_the_sql_does(spark):
    values = [k / 100 / 1e5 for k in range(5, 60_000, 10)] + [-0.0000005, 0.0]
    df = spark.createDataFrame([(x,) for x in values], "x double").select("x", tx.rounded(F.col("x")).alias("a"), F.round("x", 6).alias("b"))
    got = df.toPandas()
    want = duckdb.sql("SELECT round(x, 6) AS w FROM got").df()["w"]
    assert (got["a"] == want).all() and not (got["b"] == want).all()


def test_f1_loops_leave_small_plans(spark):
    """Many short loops and a long one with a tail: equal to a walk, and no estimate of size that doubles its digits."""
    to = {k: k ^ 1 for k in range(600)} | {1000 + k: 1000 + (k + 1) % 37 for k in range(37)} | {2000 + k: 2001 + k if k < 20 else 1005 for k in range(21)}
    want = {}
    for start in to:
        at, seen = start, {start}
        while to[at] not in seen:
            at = to[at]
            seen.add(at)
        want[start] = (at, len(seen) - 1)
    got = layers.resolve(spark.createDataFrame(list(to.items()), "old_id long, new_id long"))
    assert {r["old_id"]: (r["final_id"], r["hops"]) for r in got.collect()} == want
    assert int(got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 10**80


def test_f4_views_have_the_size_of_their_rows(spark):
    """Views and tombstones are tables: their estimates don't multiply, and another scope shares what doesn't depend on it."""
    s = fixture.store(spark, "/root/testdata/sf0.001")
    for df in (s.logical("entity"), s._gone, s._ends("entity")):
        assert int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 10**6
    other = s.within(profile_id="en")
    assert other._gone is s._gone and other._ends("entity") is s._ends("entity")


def test_f7_best_rows_equal_all_matches_ranked(spark):
    """Phrases of one frequent word, queries alike, ties and filtered rows, over several blocks."""
    said = [(k, f"part {k % 40} bolt" if k % 3 else f"part x {k % 40} bolt part {k % 40}", k % 5 > 0) for k in range(300)]
    docs = spark.createDataFrame([*said, (900, None, True), (901, "", True)], "id long, text string, may boolean").withColumn("id", F.concat(F.lit("d"), "id"))
    asked = spark.createDataFrame([(k, f"part_{k % 45} bolt") for k in range(90)] + [(100, "bolt"), (101, "bolt bolt part"), (102, "none bolt"), (103, "part_1_bolt"), (104, "...")], "q long, t string")
    every = fulltext.match(docs, "id", F.array("text"), asked, "q", "t").toPandas()
    want = every.merge(docs.filter("may").select("id").toPandas(), on="id").sort_values(["q", "bm25", "id"]).groupby("q").head(7)
    got = fulltext.best(docs, "id", F.array("text"), asked, "q", "t", 7, F.col("may"), block=64).toPandas().sort_values(["q", "bm25", "id"])
    assert got[["q", "id", "bm25"]].values.tolist() == want[["q", "id", "bm25"]].values.tolist()
    held = {q: {f"d{k}" for k, t, _ in said if f" part {q % 45} " in f" {t} "} for q in range(90)}
    assert {q: set(x["id"]) for q, x in every[every["q"] < 90].groupby("q")} == {q: x for q, x in held.items() if x}


def test_f8_phrases_meet_a_range_at_once(spark, tmp_path):
    """Phrases with repeated and frequent words, over several ranges and with documents gone, equal ``match``;
    no row is made for each place of a phrase's word."""
    text = lambda k: f"a a b {k % 7} a" if k % 2 else f"b a a a {k % 5} c{k % 3} b"
    rows = spark.createDataFrame([(k, [text(k), "b"]) for k in range(120)], "id long, columns array<string>")
    index = postings.TextIndex(spark, f"file://{tmp_path}/i", "id", size=16, folders=4)
    index.write(rows)
    index.delete(rows.filter("id % 10 = 3"))
    asked = spark.createDataFrame(list(enumerate(["a_a", "a_a_a", "a_a b", "b_a", "b_b", "a_3_a", "c1_b a_a", "a", "zz_a"])), "q long, t string")
    every = fulltext.match(rows.filter("id % 10 <> 3"), "id", F.col("columns"), asked, "q", "t").toPandas()
    want = every.sort_values(["q", "bm25", "id"]).groupby("q").head(4)[["q", "id", "bm25"]].values.tolist()
    assert index.search(asked, "q", "t", 4).toPandas().sort_values(["q", "bm25", "id"])[["q", "id", "bm25"]].values.tolist() == want
    state, words = index.log.state(), fulltext.units(asked, "q", "t")
    plan = index._phrases(words, index.blocks(state, words.select(F.explode("words").alias("word"))))._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "places" not in "".join(x for x in plan.splitlines() if "Generate" in x)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_f13_f27_f29_parsed_rows_are_tables(spark):
    """What is read many times is worked out once: no parser stands in the plans of tables or relations."""
    files = spark.createDataFrame([("a/x.c", "int go(void) {\n  xQueueSend(&q, 0);\n}\n", "c"), ("a/m.mk", "NAME := m\nifdef CONFIG_X\nSRCS += x.c\nendif\n", "makefile")], "path string, text string, language string")
    got = indexing.index_code(files, "s1")
    assert "MapInArrow" not in plan(got["entity"]) and "MapInArrow" not in plan(got["relation"])
    settings = spark.createDataFrame([("on", "CONFIG_X", "y", True)], "profile_id string, macro string, value string, enabled boolean")
    rows = profiles.conditioned_relations(got["entity"], got["relation"], settings)
    assert plan(rows).count("Join") < 5 and {r["relation_type"] for r in rows.collect()} == {"enabled_by"}
    calls = indexing.runtime_relations(files.filter("language = 'c'"))
    assert plan(calls).count("MapInArrow") <= 1 and [r["dst"] for r in calls.collect()] == ["a/x.c#Queue#q"]


class Rows:
    """Stands for a DataFrame: gives the function of ``mapInArrow``."""

    schema = StructType([StructField("k", LongType())])

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_f26_parsers_hold_the_rows_of_few_texts():
    run = parsers.parse(Rows(), "k", "k", "k", lambda path, text: [(text, n) for n in range(30)], "t string, n int")
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["p"] * 1000), pa.array([f"t{k}" for k in range(999)] + [None])], ["k", "path", "text"])
    out = list(run([batch]))
    assert max(b.num_rows for b in out) <= 30 * parsers.SLICE
    assert pa.Table.from_batches(out).to_pydict() == {"k": [k for k in range(1000) for _ in range(30)], "t": [f"t{k}" if k < 999 else "" for k in range(1000) for _ in range(30)], "n": list(range(30)) * 1000}


def test_f24_documents_are_read_once(spark):
    files = spark.createDataFrame([("knowledge-sources/api/a.md", "---\ntitle: T\ncode_symbols: [go, 'x y']\nmodule: m\n---\nlead\n# Go\nsaid\n# X y\n"), ("b.html", "<title>P</title><h1>H</h1><p>x</p>"), ("c.md", "plain"), ("d.md", None), ("e.md", "---\nopen")], "path string, text string")
    read = documents.outlines(files, "path", "path", "text")
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(read.select("path", F.inline("sections"))) == rows(documents.sections(files, "path", "path", "text"))
    assert rows(read.select("path", "title", "category")) == rows(documents.titles(files, "path", "path", "text"))
    assert rows(read.select("path", "known")) == rows(documents.front_matters(files, "path", "path", "text").select("path", "known"))
    got = indexing.index_documents(files, "s1")
    assert "MapInArrow" not in plan(got["entity"]) and "MapInArrow" not in plan(got["chunk"])
    assert {(r["name"], r["ordinal"]) for r in got["entity"].filter("entity_type = 'API'").collect()} == {("go", 1), ("x y", 2)}


def test_f19_top_k_holds_a_slice_of_scores(spark):
    """Many equal scores, over several slices of rows and of queries: equal to all scores ranked, in little memory."""
    x = np.random.default_rng(1).integers(-1, 2, (2500, 3)).astype("f8")
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    asked = rows.filter("vec_id < 1100").withColumnRenamed("vec_id", "query_id")
    norm = np.sqrt((x * x).sum(1))
    unit = x / np.where(norm > 0, norm, 1)[:, None]
    want = {}
    for q in np.flatnonzero(norm[:1100] > 0).tolist():
        score = np.round(unit @ unit[q], 6)
        score[(norm == 0) | (np.arange(len(x)) == q)] = -np.inf
        want[q] = np.lexsort((np.arange(len(x)), -score))[:4].tolist()
    got = vectors.top_k(rows, asked, 4).toPandas().sort_values(["query_id", "rank"])
    assert {q: some["vec_id"].tolist() for q, some in got.groupby("query_id")} == want
    run = vectors.top_k(Held(rows), asked, 4)
    ids = np.tile(np.arange(2500), 4)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(x[ids].tolist(), pa.list_(pa.float64()))], ["vec_id", "embedding"])
    tracemalloc.start()
    assert sum(b.num_rows for b in run([batch])) > 0
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20  # 10,000 x 1,100 scores would be 88 MB


class Held(Rows):
    def __init__(self, df):
        self.sparkSession = df.sparkSession

    def mapInArrow(self, run, schema):
        return Given(run)


class Given:
    def __init__(self, run):
        self.run = run

    def withColumn(self, *_):
        return self

    def filter(self, *_):
        return self.run


def test_f5_pairs_are_scored_once(spark):
    """No pair without a score goes through a shuffle, and none is scored twice."""
    s = fixture.store(spark, "/root/testdata/sf0.001")
    asked = spark.createDataFrame([(1, "part_3"), (2, "Part 12"), (3, "nothing like it")], "query_id long, query string")
    got = symbols.candidates(s, asked, 3, mentions=False)
    assert "ArrowEvalPython" not in plan(got)
    best = {(r["query_id"], r["rank"]): (r["name"], r["score"]) for r in got.collect()}
    assert best[1, 1][1] == 1.0 and best[1, 1][0] == "part_3" and best[2, 1] == ("part_12", 0.94) and not any(q == 3 for q, _ in best)


def test_f18_f20_scopes_meet_replacements_without_a_product(spark, monkeypatch):
    """Also where nothing is small enough for Spark to choose a broadcast by itself."""
    from tessera.operators import store

    plans, keep = [], store.settled
    monkeypatch.setattr(store, "settled", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or keep(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        s = fixture._store(spark, "/root/testdata/sf0.001")
        assert s._ends("chunk").count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plans and not any("CartesianProduct" in p for p in plans)


def test_f20_views_move_no_texts(spark):
    """Texts stay out of a view's joins, and come back from each row's own layer."""
    s = fixture.store(spark, "/root/testdata/sf0.001")
    rows = s.logical("chunk")
    assert "text" not in rows.columns
    whole = s.with_texts(rows, "chunk")
    assert whole.count() == rows.count() and not whole.filter("text is null or content_hash <> md5(text)").count()


def test_f2_f6_queries_go_where_their_rarest_unit_is(spark):
    """A query of a rare word meets that word's blocks, and all its units do, whatever the others' blocks."""
    asked = spark.createDataFrame([(1, "rare", 1.0), (1, "common", 50.0), (2, "common", 50.0)], "query int, unit string, df double")
    held = spark.createDataFrame([("common", b) for b in range(8)] * 3 + [("rare", 5)], "unit string, _b int")
    got = {(r["query"], r["_at"], r["unit"]) for r in fulltext._routed(asked, held).collect()}
    assert got == {(1, 5, "rare"), (1, 5, "common")} | {(2, b, "common") for b in range(8)}


def test_f22_relations_are_grouped_once(spark):
    s = fixture._store(spark, "/root/testdata/sf0.001")
    for rows in (s.overlay["relation"], s.baseline["relation"], s.overlay["tombstone"], s.overlay["replacement"]):
        assert "l_partkey" not in plan(rows)
    other = fixture._store(spark, "/root/testdata/sf0.01")
    late = fixture._store(spark, "/root/testdata/sf0.001").overlay["file"]
    assert other.overlay["file"].count() > late.count() == s.overlay["file"].count()


def test_op2_odd_texts_are_those_of_the_pattern():
    import re

    from tessera.llm import encoding

    pattern = re.compile(r"\s\s|[^\S \n]|^\s|\s$|\x01")
    texts = [f(chr(c)) for c in range(0x11000) if not 0xD800 <= c < 0xE000 for f in (lambda x: x, lambda x: f"a{x}b", lambda x: f"ä{x}b", lambda x: f"{x}b", lambda x: f"a{x}", lambda x: f"a {x}b")]
    assert all(encoding.odd(t) == bool(pattern.search(t)) for t in texts)


def test_f21_no_vector_of_the_model_starts_no_search(spark, monkeypatch):
    """Full text answers at once; where a layer has the model, vectors are searched."""
    s = fixture.store(spark, "/root/testdata/sf0.001")
    rows = fixture.vectors(spark, "/root/testdata/sf0.001")
    asked = spark.createDataFrame([(0, [1.0] * 64, "health notes")], "query_id long, embedding array<float>, query string")
    searched = []
    monkeypatch.setattr(vectors, "search_vectors", lambda *a, **k: searched.append(a) or asked)
    monkeypatch.setattr(vectors, "retrieve", lambda *a, **k: None)
    assert vectors.search_or_fall_back(s, rows, asked, 5, "m2")[1:] == ("fts_fallback", ["embedding.version_mismatch", "retrieval.vector_fallback"]) and not searched
    assert vectors.search_or_fall_back(s, rows, asked, 5, "m1")[1:] == ("vector", []) and len(searched) == 1
    mixed = {"overlay": rows["overlay"], "baseline": rows["baseline"].withColumn("embedding_model_version", F.lit("m3"))}
    assert vectors.search_or_fall_back(s, mixed, asked, 5, "m1")[1:] == ("vector", ["embedding.version_mismatch"]) and len(searched) == 2


def test_f21_words_not_asked_for_are_not_shuffled(spark, monkeypatch):
    """Also where Spark would choose no broadcast by itself; too many words meet by a shuffle, with the same rows."""
    docs = spark.createDataFrame([(k, f"a b{k % 3} c d{k}") for k in range(40)], "id long, text string")
    asked = spark.createDataFrame([(1, "a b1"), (2, "d7"), (3, "zz")], "q long, t string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = {}
        for most in (fulltext.SENT_WORDS, 0):
            plans, keep = [], fulltext.settled
            with monkeypatch.context() as m:
                m.setattr(fulltext, "SENT_WORDS", most)
                m.setattr(fulltext, "settled", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or keep(df))
                rows[most] = sorted(map(tuple, fulltext.best(docs, "id", F.array("text"), asked, "q", "t", 5).collect()))
            counted = [p for p in plans if "MapInArrow" in p]
            assert counted and all(("BroadcastHashJoin" in p) == bool(most) for p in counted)
        assert rows[0] == rows[fulltext.SENT_WORDS] and len(rows[0]) == 6
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
