"""Tables as logs of commits: several writers, crashes, merges; the stored full-text index."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import fulltext
from tessera.operators.postings import TextIndex
from tessera.sources.commits import Conflict, Log


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k int, v string")


def held(log):
    return sorted(map(tuple, log.read().collect()))


def meanwhile(log, monkeypatch, act):
    """Has ``act`` happen after the log's next part was written and before it is committed."""
    put, done = log._put, []

    def first(version, text):
        if not done:
            done.append(1)
            act(Log(log.spark, log.root))
        return put(version, text)

    monkeypatch.setattr(log, "_put", first)


@pytest.fixture
def log(spark, tmp_path):
    out = Log(spark, f"file://{tmp_path}/t")
    out.append(rows(spark, (1, "old"), (2, "b")))
    out.append(rows(spark, (3, "c")))
    return out


def test_compaction_keeps_what_others_write_meanwhile(spark, log, monkeypatch):
    meanwhile(log, monkeypatch, lambda other: other.upsert(rows(spark, (1, "new")), ["k"]))
    assert log.compact(force=True)
    assert held(log) == [(1, "new"), (2, "b"), (3, "c")]


def test_delete_and_upsert_see_what_others_add_meanwhile(spark, log, monkeypatch):
    meanwhile(log, monkeypatch, lambda other: other.append(rows(spark, (2, "late"), (4, "d"))))
    assert log.delete(rows(spark, (2, ""), (9, "")), ["k"]) == 2
    assert held(log) == [(1, "old"), (3, "c"), (4, "d")]
    assert sorted(map(tuple, log.read(version=2).collect())) == [(1, "old"), (2, "b"), (3, "c")]


def test_a_crash_before_the_commit_leaves_the_old_version(spark, log, monkeypatch):
    before, version = held(log), log.state().version

    def crash(*_):
        raise OSError("gone")

    for step in ("_put", "_write", "_mark"):
        with monkeypatch.context() as m:
            m.setattr(log, step, crash)
            for change in (lambda: log.upsert(rows(spark, (1, "x")), ["k"]), lambda: log.delete(rows(spark, (1, "")), ["k"]), lambda: log.compact(force=True)):
                try:
                    change()
                except OSError:
                    pass
                else:  # steps that a change doesn't take
                    assert step != "_put"
        if log.state().version != version:
            version, before = log.state().version, held(log)
        assert held(log) == before
    with monkeypatch.context() as m:
        m.setattr(log, "_put", lambda *_: False)
        with pytest.raises(Conflict):
            log.append(rows(spark, (7, "z")))


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    log, order = Log(spark, f"file://{tmp_path}/m"), F.col("n")
    log.merge(spark.range(200).select("id", F.lit(5).alias("n")), ["id"], order, 16)
    before = {p.bucket: p.name for p in log.state().parts}
    _, touched = log.merge(spark.createDataFrame([(3, 9), (4, 1)], "id long, n int"), ["id"], order, 16)
    after = {p.bucket: p.name for p in log.state().parts}
    assert len(touched) <= 2 and {b for b in after if after[b] != before[b]} == touched
    assert {r["id"]: r["n"] for r in log.read().collect()} == {k: 9 if k == 3 else 5 for k in range(200)}


def test_stored_index_equals_a_search_of_all_rows(spark, tmp_path):
    text = lambda k, r=0: " ".join(f"w{(k * p + r) % 17}" for p in range(1, 4 + k % 9)) + (" état_x" if k % 5 == 0 else "")
    make = lambda some, r=0: spark.createDataFrame([(k, [text(k, r), None if k % 2 else "w1 w2"]) for k in some], "id int, columns array<string>")
    index = TextIndex(spark, f"file://{tmp_path}/i", "id", size=8, folders=4)
    index.write(make(range(120)))
    index.write(make(range(0, 120, 7), 3))
    index.delete(make(range(5, 120, 11)))
    gone = set(range(5, 120, 11))
    now = make([k for k in range(120) if k % 7 and k not in gone]).unionByName(make([k for k in range(0, 120, 7) if k not in gone], 3))
    asked = spark.createDataFrame([(1, "w1 w2"), (2, "w1_w2"), (3, "etat_x w5"), (4, "w3"), (5, "none w1"), (6, "w2.w4 w1 w1"), (7, "--")], "q int, t string")
    want = fulltext.match(now, "id", F.col("columns"), asked, "q", "t").collect()
    got = {(r["q"], r["rank"]): (r["bm25"], r["id"]) for r in index.search(asked, "q", "t", 3).collect()}
    for q in range(1, 8):
        best = sorted((r["bm25"], r["id"]) for r in want if r["q"] == q)[:3]
        assert [got[q, k + 1] for k in range(len(best))] == best and (q, len(best) + 1) not in got
    state = index.log.state()
    words = spark.createDataFrame([("w1",)], "word string")
    read = {f.rsplit("_bucket=", 1)[1].split("/")[0] for f in index.blocks(state, words).inputFiles()}
    assert len(read) == 1 and state.sums["docs"] == now.count()
