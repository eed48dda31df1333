"""Scans, segments, configuration, publishing and incremental ingestion."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import indexing
from tessera.parsers import build, cfamily, documents
from tessera.sources import files, publish, workspace
from tessera.sources.commits import Log
from tessera.streaming import jobs
from tessera.streaming.ingest import ingest


def test_scan(spark, tmp_path):
    for name in ("a/main.c", "a/.git/x.c", "docs/r.md", "top.py"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(name)
    got = {r["relative_path"]: (r["language"], r["area"]) for r in files.scan(spark, str(tmp_path), exclude=["*.py"]).collect()}
    assert got == {"a/main.c": ("c", "a"), "docs/r.md": ("markdown", "docs")}


def test_config(spark):
    lines = ["CONFIG_A=y", "# CONFIG_B is not set", 'CONFIG_C="x y"', "CONFIG_D=0X1F", "CONFIG_E=12", "# other", "", "CONFIG_A=m", "CONFIG_F=0x0", 'CONFIG_G="y"', 'CONFIG_H=""', "BARE=n", "CONFIG_I=0"]
    df = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    got = {r["macro"]: (r["value"], r["value_type"], r["enabled"]) for r in files.effective_config(files.config_assignments(df), "n").collect()}
    assert got == {"CONFIG_A": ("m", "tristate", True), "CONFIG_B": ("n", "bool", False), "CONFIG_C": ("x y", "string", True), "CONFIG_D": ("0x1f", "hex", True), "CONFIG_E": ("12", "int", True), "CONFIG_F": ("0x0", "hex", False), "CONFIG_G": ("y", "string", True), "CONFIG_H": ("", "string", True), "BARE": ("n", "bool", False), "CONFIG_I": ("0", "int", False)}


def test_segments(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z")], "k int, v string")
    assert sorted(map(tuple, files.segments([a, b], "k").collect())) == [(1, "x"), (2, "z")]


def test_publish_and_ingest(spark, tmp_path):
    source, root = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    one = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, n int")
    one.write.parquet(source)
    assert ingest(spark, source, one.schema, root, "k", "n", f"{tmp_path}/ck") >= 1
    spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "k int, v string, n int").write.mode("append").parquet(source)
    ingest(spark, source, one.schema, root, "k", "n", f"{tmp_path}/ck")
    assert sorted(tuple(r)[:2] for r in Log(spark, root).read().collect()) == [(1, "a"), (2, "c"), (3, "d")]
    spark.createDataFrame([(2, "older", 1)], "k int, v string, n int").write.mode("append").parquet(source)
    ingest(spark, source, one.schema, root, "k", "n", f"{tmp_path}/ck")
    assert (2, "c", 2) in set(map(tuple, Log(spark, root).read().collect()))
    assert ingest(spark, source, one.schema, root, "k", "n", f"{tmp_path}/ck") == 0


def test_a_lost_pointer_is_no_first_run(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    one = spark.createDataFrame([(1, "a")], "k int, v string")
    for _ in range(4):
        publish.publish(one, root)
    assert publish.current(spark, root).count() == 1 and len([n for n in os.listdir(f"{tmp_path}/t") if n.startswith("v=")]) == 2
    for n in os.listdir(f"{tmp_path}/t"):
        if n.startswith("CURRENT"):
            os.unlink(f"{tmp_path}/t/{n}")
    with pytest.raises(RuntimeError, match="no pointer"):
        publish.published(spark, root)
    assert not publish.published(spark, f"file://{tmp_path}/none")


def test_segments_on_disk(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/s")
    for k in range(9):
        log.upsert(spark.createDataFrame([(k % 3, k)], "k int, v int"), ["k"])
    assert {(r["k"], r["v"]) for r in log.read().collect()} == {(0, 6), (1, 7), (2, 8)}
    assert log.compact() and len(log.state().parts) == 1 and not log.compact()
    assert log.delete(spark.createDataFrame([(1,)], "k int"), ["k"]) == 1
    assert {r["k"] for r in log.read().collect()} == {0, 2}


def test_scan_cuts_the_root_once(spark, tmp_path):
    top = tmp_path / "r"
    inner = top / str(top).strip("/")
    inner.mkdir(parents=True)
    (inner / "foo.c").write_text("x")
    (top / "foo.c").write_text("y")
    got = {r["relative_path"] for r in files.scan(spark, f"file://{top}").collect()}
    assert got == {"foo.c", f"{str(top).strip('/')}/foo.c"}


def test_path_guard(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    os.symlink(tmp_path / "out", tmp_path / "in" / "link")
    guard = workspace.PathGuard({"workspace": str(tmp_path / "in")})
    assert guard.guard(str(tmp_path / "in" / "a" / ".." / "b")).display == "workspace:b"
    for path, reason in ((str(tmp_path / "in" / ".." / "out"), "path_outside_allowlist"), (str(tmp_path / "in" / "link"), "symlink_outside_allowlist")):
        with pytest.raises(workspace.PathBlocked) as e:
            guard.guard(path)
        assert e.value.reason == reason and str(tmp_path) not in str(e.value)


def test_jobs(tmp_path):
    now = [100.0]
    store = jobs.JobStore(str(tmp_path), clock=lambda: now[0])
    for status in ("discovering", "parsing", "failed", "pending"):
        store.move("j", status)
    with pytest.raises(jobs.Conflict):
        store.move("j", "ready")
    store.start("j", {"a": 1})
    store.record("j", "t1", "applied", "h1")
    assert store.left("j", {"t1": "h1", "t2": "h2"}) == ["t2"] and store.left("j", {"t1": "other"}) == ["t1"]
    store.start("j", {"a": 2})
    assert store.left("j", {"t1": "h1"}) == ["t1"]
    store.acquire("overlay", "a", 10)
    with pytest.raises(jobs.Conflict):
        store.acquire("overlay", "b", 10)
    now[0] = 111.0
    assert store.acquire("overlay", "b", 10)["owner"] == "b" and not store.release("overlay", "a") and store.release("overlay", "b")
    assert list(jobs.batches([("a", 1), ("b", 5), ("c", 9), ("d", 1)], 2, 10)) == [["a", "b"], ["c", "d"]]

    def apply(keys):
        if "bad" in keys:
            raise ValueError("no")

    assert jobs.apply_or_degrade(["x", "bad", "y"], apply) == {"bad": "ValueError: no"}
    p = jobs.plan({"code": {"a": "1", "b": "1"}}, {"code": {"a": "2"}, "docs": {"d": "1"}})
    assert p["code_changed"] == ["a"] and p["code_deleted"] == ["b"] and p["vectors"] == ["d"]


MARKDOWN = "---\ntitle: X\ntags: [a, b]\n---\nlead\n# A\ntext\n```\n# no\n```\nB\n---\nmore\n## C\n# A\n"
MAKE = "NAME := health\nifdef CONFIG_X\nSRCS += main.c bt.c \\\n  z.S\nelse ifeq ($(CONFIG_Y),y)\nobj-$(CONFIG_Q) += q.o\nendif\nCOMPONENTS = a b # c\nendif\n"
CODE = "/* hdr */\n#include <stdio.h>\n#define X 1\n\nstruct foo { int a; } foo_t;\nint f(int a);\n/* doc */\nstatic void g(void) {\n  xQueueSend(&q1, &m, 0);\n  t = xTimerCreate(\"t\", 1, 0, 0, cb);\n}\nvoid cb(void) { panic(); }\n"


def test_parsers():
    assert [(t, p, a) for _, _, t, p, a, _ in documents._headings("", MARKDOWN)] == [("A", ["A"], "a"), ("B", ["A", "B"], "b"), ("C", ["A", "C"], "c"), ("A", ["A"], "a-2")]
    assert [(r[1], r[5], r[6]) for r in documents._markdown("", MARKDOWN)] == [("markdown.lead", 5, 5), ("markdown.section", 6, 10), ("markdown.section", 11, 13), ("markdown.section", 14, 14), ("markdown.section", 15, 15)]
    assert documents.typed_fields({"title": 3, "tags": "x", "z": 1, "profiles": [{}]}, None) == ({"title": "3", "tags": ["x"], "profiles": []}, {"z": 1}, ["doc.front_matter_invalid_type"])
    html = "<h1>One</h1><p>a b</p><table><tr><td>x</td><th>y</th></tr></table>"
    assert [r[7] for r in documents._html("x.html", html)] == ["One\na b\nx | y"]
    assert [(r[0], r[1], r[3], r[5]) for r in cfamily.symbols("", CODE)] == [("X", "macro", True, 3), ("foo", "type", True, 4), ("foo_t", "type", True, 4), ("f", "function", False, 6), ("g", "function", True, 8), ("cb", "function", True, 12)]


def test_makefile(spark):
    texts = {"c/health/module.mk": MAKE, "b/x.mk": "include Config.in\nobj-$(CONFIG_A) += a.o\nelse\nSRCS = -O2 $(LOST)\nifndef B\nMODULE = 'bee'\nelse\nbee-y := sub/ \\# c.c\nNAME = one\nNAME = two\nCSRCS += /t.c\n", "z.mk": "NAME = $(X)\nSRCS = r.c", "n.mk": None}
    df = spark.createDataFrame(list(texts.items()), "path string, text string")
    rows = build.makefile(df, "path", "path", "text").collect()
    of = lambda path, relation: {(r["module"], r["target"], r["condition"]) for r in rows if r["path"] == path and r["relation"] == relation}
    assert of("c/health/module.mk", "contains_file") == {("health", "c/health/main.c", "CONFIG_X"), ("health", "c/health/bt.c", "CONFIG_X"), ("health", "c/health/z.S", "CONFIG_X"), ("obj", "c/health/q.o", "not (CONFIG_X) && ifeq($(CONFIG_Y),y) && $(CONFIG_Q)")}
    assert of("c/health/module.mk", "depends_on_component") == {("health", "a", None), ("health", "b", None)}
    assert of("b/x.mk", "contains_file") == {("obj", "b/a.o", "$(CONFIG_A)"), ("bee", "b/sub", "not (not (B))"), ("bee", "b/c.c", "not (not (B))"), ("two", "/t.c", "not (not (B))")}
    assert of("b/x.mk", "configured_by") == {(m, "b/Config.in", None) for m in ("obj", "bee", "one", "two")} and of("b/x.mk", "aliases_module") == {("obj", "bee", None), ("one", "bee", None), ("two", "bee", None)}
    assert of("z.mk", "contains_file") == {("z", "r.c", None)}
    warned = sorted((r["path"], r["line"], r["warning"].split(".")[1]) for r in rows if r["module"] is None)
    assert warned == [("b/x.mk", 3, "orphan_else"), ("b/x.mk", 4, "no_file_tokens"), ("b/x.mk", 7, "unclosed_if"), ("b/x.mk", 9, "multiple_module_names"), ("b/x.mk", 10, "multiple_module_names"), ("c/health/module.mk", 9, "unmatched_endif"), ("z.mk", 1, "module_name_unresolved")]
    one = next(r for r in rows if r["module"] == "health")
    assert (one["definition_kind"], one["start_line"], one["end_line"]) == ("explicit_variable", 1, 8)


def test_kconfig(spark):
    text = 'endif\nif A\nconfig FOO\n\tbool "x \\"y\\""\n\tdepends on B\n\tselect Z if W\n# c\nif C\nmenuconfig BAR\nmenu "m"\n\tint "no"\nendif\nendif\nconfig LAST\n\tprompt "p" \\\n  if Q\nif D\n'
    df = spark.createDataFrame([("k", text), ("n", None)], "path string, text string")
    rows = build.kconfig(df, "path", "path", "text").collect()
    got = {r["name"]: (r["kind"], r["value_type"], r["prompt"], r["depends_on"], [tuple(x) for x in r["selects"]], r["start_line"], r["end_line"]) for r in rows if r["name"]}
    assert got == {"FOO": ("config", "bool", 'x "y"', ["A", "B"], [("Z", "W", 6)], 3, 6), "BAR": ("menuconfig", None, None, ["A", "C"], [], 9, 9), "LAST": ("config", None, "p", [], [], 14, 15)}
    assert sorted((r["warning"], r["start_line"]) for r in rows if not r["name"]) == [("kconfig.unclosed_if", None), ("kconfig.unmatched_endif", 1)]


def test_code_index(spark):
    rows = [("c/h/main.c", CODE, "c"), ("c/h/module.mk", "NAME = h\nSRCS = main.c gone.c\n", "makefile")]
    df = spark.createDataFrame(rows, "path string, text string, language string")
    got = indexing.index_code(df, "s1")
    kinds = {(r["entity_type"], r["name"]) for r in got["entity"].collect()}
    assert {("Directory", "h"), ("File", "main.c"), ("Function", "g"), ("Macro", "X"), ("Module", "h")} <= kinds
    assert {r["relation_type"] for r in got["relation"].collect()} == {"contains", "defines", "belongs_to_module"}
    assert [r["code"] for r in got["problem"].collect()] == ["code.module_file_missing"]
    chunk = {r["name"]: r for r in got["chunk"].collect()}
    assert chunk["g"]["text"].startswith("/* doc */") and chunk[None]["chunk_type"] == "code.file_header"
    edges = {(r["relation_type"], r["dst"]) for r in indexing.runtime_relations(df.filter("language = 'c'")).collect()}
    assert {("posts_to_queue", "c/h/main.c#Queue#q1"), ("creates_timer", "c/h/main.c#Timer#t"), ("triggers", "c/h/main.c#cb")} <= edges
