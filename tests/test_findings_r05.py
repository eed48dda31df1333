"""What the findings of the fifth round named, on small rows."""

from pyspark.sql import functions as F

from tessera.operators import fulltext
from tessera.operators.lineage import settled
from tessera.operators.postings import TextIndex


def plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_f1_a_table_of_many_rows_in_small_files_is_not_sent(spark):
    """A million rows of two values fill a few kilobytes of files; the driver must not gather them."""
    many = settled(spark.range(1_000_000).select((F.col("id") % 2).alias("k"), F.lit("word").alias("unit")))
    other = settled(spark.range(1_000_000).select((F.col("id") % 2 + 5).alias("k"), F.lit(1).alias("x")))
    few = settled(spark.range(10).select(F.col("id").alias("k")))
    assert "Broadcast" not in plan(other.join(many.filter("unit <> ''"), "k")) and "Broadcast" not in plan(other.join(many, "k", "left_semi"))
    assert "BroadcastHashJoin" in plan(many.join(F.broadcast(few), "k")) and "BroadcastHashJoin" in plan(few.join(settled(few), "k"))
    assert many.join(F.broadcast(few), "k").count() == 1_000_000 and other.join(many, "k").count() == 0


def test_f1_search_is_the_same_whether_units_are_sent_or_not(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"a b{k % 3} c d{k}") for k in range(40)], "id long, text string")
    asked = spark.createDataFrame([(1, "a b1"), (2, "d7"), (3, "zz"), (4, "a c b2")], "q long, t string")
    rows = []
    for most in (fulltext.SENT_UNITS, 0):
        monkeypatch.setattr(fulltext, "SENT_UNITS", most)
        rows.append(sorted(map(tuple, fulltext.search(docs, "id", "text", asked, "q", "t", 5).collect())))
    assert rows[0] == rows[1] and len(rows[0]) == 11


def test_f3_blocks_are_made_whole_and_no_posting_moves(spark, tmp_path, monkeypatch):
    """Only texts meet by range; blocks equal a count by hand, with nulls, columns, repeats and a document without words."""
    index = TextIndex(spark, f"file://{tmp_path}/i", "id", size=4, folders=2)
    texts = {k: [f"a b{k % 3} a", None, "c_d a" if k % 2 else ""] for k in range(11)} | {20: [""], 21: [], 22: [None]}
    plans, keep = {}, index.log._write
    monkeypatch.setattr(index.log, "_write", lambda df, table, *a, **k: plans.setdefault(table, plan(df)) and keep(df, table, *a, **k))
    index.write(spark.createDataFrame(list(texts.items()), "id int, columns array<string>"))
    assert "Generate" not in plans["blocks"] and "HashAggregate" not in plans["blocks"].split("FlatMapGroupsInArrow")[0]
    state = index.log.state()
    at = {(r["range"], r["slot"]): (r["id"], r["length"]) for r in index.log._scan(state, state.of("docs"), "docs").collect()}
    assert sorted(x for x, _ in at.values()) == sorted(texts) and max(s for _, s in at) < 4
    got, n = {}, 0
    for r in index.log._scan(state, state.of("blocks"), "blocks").collect():
        places = iter(r["places"])
        entries = [(at[r["range"], s], tf, length, [next(places) for _ in range(tf)]) for s, tf, length in zip(r["slots"], r["tfs"], r["lengths"], strict=True)]
        assert r["n"] == len(entries) and r["top_tf"] == max(r["tfs"]) and r["short"] == min(r["lengths"]) and r["slots"] == sorted(r["slots"]) and not list(places)
        got |= {(r["term"], key): (tf, length, own, spots) for (key, own), tf, length, spots in entries}
        n += len(entries)
    want = {}
    for key, columns in texts.items():
        line = [w for c in columns for w in [*(c or "").replace("_", " ").split(), ""]]
        length = sum(w != "" for w in line)
        for w in {*line} - {""}:
            spots = [i for i, x in enumerate(line) if x == w]
            want[w, key] = (len(spots), length, length, spots)
    assert got == want and n == len(want)
