"""Registered queries of parsers, indexers, profiles and the router over whole tables;
unit tests hold the results of those without SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indexing, profiles, router
from ..parsers import build, cfamily, documents
from ..sources import files
from .registry import n, query, read


def docs(spark, sf_dir):
    """Documents as Markdown with front matter: the first line a heading."""
    d = read(spark, sf_dir, "documents").filter("text is not null")
    head = F.concat(F.lit("---\ntitle: Doc "), "doc_id", F.lit("\ntags: [x, y]\ncode_symbols: [sym_"), "doc_id", F.lit("]\n---\n# Sym "), "doc_id", F.lit("\n"))
    return d.select(F.concat(F.lit("knowledge-sources/api/d"), "doc_id", F.lit(".md")).alias("path"), F.concat(head, "text").alias("text"))


def code(spark, sf_dir):
    """A C file and a Makefile for each part."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    c = F.concat(F.lit("/* "), "p_name", F.lit(" */\n#include \"p.h\"\n#define SIZE "), "p_size", F.lit("\nint spare;\n\nstatic int part_"), k, F.lit("(void) {\n  xQueueSend(&q"), k % 9, F.lit(", 0, 0);\n  return SIZE;\n}\n"))
    make = F.concat(F.lit("NAME := m"), k, F.lit("\nifdef CONFIG_P"), k % 5, F.lit("\nSRCS += main.c lost.c\nendif\n"))
    at = F.concat(F.lit("components/p"), k)
    rows = p.select(F.concat(at, F.lit("/main.c")).alias("path"), c.alias("text"), F.lit("c").alias("language"))
    return rows.unionByName(p.select(F.concat(at, F.lit("/module.mk")).alias("path"), make.alias("text"), F.lit("makefile").alias("language")))


@query()
def i1_front_matter(spark, sf_dir):
    return documents.front_matters(docs(spark, sf_dir), "path", "path", "text").select("path", "known", "others", n("body_line"))


@query()
def i2_i3_headings(spark, sf_dir):
    return documents.headings(docs(spark, sf_dir), "path", "path", "text").select("path", n("ordinal"), "title", "anchor", n("start_line"))


@query()
def i4_markdown_sections(spark, sf_dir):
    return documents.sections(docs(spark, sf_dir), "path", "path", "text").select("path", n("ordinal"), "chunk_type", "anchor", n("start_line"), n("end_line"))


@query()
def i5_html_blocks(spark, sf_dir):
    return documents.html_blocks(read(spark, sf_dir, "pages"), "page_id", "url", "html").select("page_id", n("ordinal"), "kind", "text")


@query()
def i6_i7_code_parse(spark, sf_dir):
    c = code(spark, sf_dir).filter("language = 'c'")
    return cfamily.code_symbols(c, "path", "path", "text").select("path", "name", "kind", n("start_line")).join(cfamily.file_headers(c, "path", "path", "text").select("path", n("end_line")), "path")


@query("SELECT 'k' || p_partkey AS path, 'P' || p_partkey AS name, 'bool' AS value_type, 'part' AS prompt, 'BASE,X' || p_partkey % 3 AS depends_on FROM part")
def i10_kconfig(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.concat(F.lit("if BASE\nconfig P"), k, F.lit("\n\tbool \"part\"\n\tdepends on X"), k % 3, F.lit("\nendif\n"))
    rows = read(spark, sf_dir, "part").select(F.concat(F.lit("k"), k).alias("path"), text.alias("text"))
    return build.kconfig(rows, "path", "path", "text").select("path", "name", "value_type", "prompt", F.array_join("depends_on", ",").alias("depends_on"))


@query("SELECT DISTINCT 'boards/b' || p_partkey % 20 || '_defconfig' AS path, NULL AS app, 'b' || p_partkey % 20 AS board FROM part")
def i11_i21_profile_clues(spark, sf_dir):
    k = F.col("p_partkey")
    line = F.concat(F.lit("CONFIG_BOARD_"), "p_brand", F.lit("=y"))
    lines = read(spark, sf_dir, "part").select(F.concat(F.lit("boards/b"), k % 20, F.lit("_defconfig")).alias("path"), F.regexp_replace(line, "#", "").alias("line"))
    return profiles.profile_clues(files.config_assignments(lines)).select("path", "app", "board")


@query("""WITH p AS (SELECT 'components/p' || p_partkey AS folder, 'm' || p_partkey AS module, 'CONFIG_P' || p_partkey % 5 AS guard FROM part)
 SELECT folder || '/module.mk' AS path, module, r.relation, CASE r.relation WHEN 'contained_in_directory' THEN folder WHEN 'guarded_by_macro' THEN guard ELSE folder || '/' || r.target END AS target, CASE WHEN r.relation = 'contains_file' THEN guard END AS condition
 FROM p, (VALUES ('contained_in_directory', ''), ('guarded_by_macro', ''), ('contains_file', 'main.c'), ('contains_file', 'lost.c')) r(relation, target)""")
def i12_makefile(spark, sf_dir):
    c = code(spark, sf_dir).filter("language = 'makefile'")
    return build.makefile(c, "path", "path", "text").select("path", "module", "relation", "target", "condition")


@query()
def i13_i14_code_index(spark, sf_dir):
    got = indexing.index_code(code(spark, sf_dir), "s1")
    return got["entity"].groupBy("entity_type").agg(F.count("*").alias("rows")).unionByName(got["relation"].groupBy(F.col("relation_type").alias("entity_type")).agg(F.count("*").alias("rows")))


@query()
def i15_i16_runtime_relations(spark, sf_dir):
    return indexing.runtime_relations(code(spark, sf_dir).filter("language = 'c'")).select("relation_type", "src", "dst", "confidence")


@query()
def i17_i18_document_index(spark, sf_dir):
    return indexing.index_documents(docs(spark, sf_dir), "s1")["entity"].select("entity_id", "entity_type", "name", "qualified_name", "path", n("ordinal"))


@query()
def i22_i24_conditioned_states(spark, sf_dir):
    got = indexing.index_code(code(spark, sf_dir), "s1")
    settings = spark.createDataFrame([("on", "CONFIG_P1", "y", True), ("off", "CONFIG_P1", "n", False), ("off", "CONFIG_P2", "0x1", True)], "profile_id string, macro string, value string, enabled boolean")
    rows = profiles.conditioned_relations(got["entity"], got["relation"], settings)
    return rows.groupBy("profile_id", "relation_type").agg(F.count("*").alias("rows"), F.min("confidence").alias("confidence"))


@query()
def h8_h9_h10_h11_h12_route(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn", "role").alias("query_id"), F.col("text").alias("query"))
    got = router.route(c.filter("query is not null"))
    return got.select("query_id", "intent", "confidence", "view", "granularity", "tool", "route_mode", F.array_join("warnings", ",").alias("warnings"))
