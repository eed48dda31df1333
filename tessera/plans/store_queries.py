"""Registered queries over a two-layer store, each with its SQL.

The SQL follows chains by recursion and asks for tombstones with EXISTS, row by
row, as the semantics read; the plans use joins.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fulltext, fusion, graph, symbols, validation, vectors
from . import fixture
from .registry import n, query, read


def gone(kind: str, key: str, r: str = "r", p: str = "all", s: str = "all", snapshot: str | None = None) -> str:
    """SQL: whether a tombstone names a row's object."""
    ep, es = (f"'{p}'" if p != "all" else f"{r}.profile_id"), (f"'{s}'" if s != "all" else f"{r}.source_scope")
    return f"EXISTS (SELECT 1 FROM o_tombstone t WHERE t.active AND t.object_type = {kind} AND t.snapshot_id = {snapshot or r + '.snapshot_id'} AND t.profile_id IN ({ep}, 'all') AND t.source_scope IN ({es}, 'all') AND (t.object_id = {key} OR t.baseline_id = {key}))"


def in_scope(p: str, s: str, r: str = "r") -> str:
    return " AND ".join([f"({r}.profile_id IN ('{p}', 'all'))" if p != "all" else "true", f"({r}.source_scope IN ('{s}', 'all'))" if s != "all" else "true"])


def sql(body: str, p: str = "all", s: str = "all") -> str:
    """The store's CTEs, chains and views under a scope, then ``body``."""
    ep, es = (f"'{p}'" if p != "all" else "profile_id"), (f"'{s}'" if s != "all" else "source_scope")
    eff = lambda r: (f"'{p}'" if p != "all" else f"{r}.profile_id", f"'{s}'" if s != "all" else f"{r}.source_scope")
    rp, rs = eff("r")
    hidden = {k: f"({gone(repr(k), f'r.{k}_id', p=p, s=s)} OR {gone(repr('file'), 'r.file_id', p=p, s=s)})" for k in ("chunk", "entity")}
    end = lambda kind, key, a: f"LEFT JOIN ends {a} ON {a}.object_type = '{kind}' AND {a}.start = r.{key} AND {a}.p = {rp} AND {a}.s = {rs}"
    parts = [
        f"scopes AS (SELECT DISTINCT {ep} AS p, {es} AS s FROM (SELECT profile_id, source_scope FROM files UNION SELECT profile_id, source_scope FROM entities UNION SELECT profile_id, source_scope FROM relations))",
        "best AS (SELECT p, s, object_type, old_object_id, new_object_id FROM (SELECT sc.p, sc.s, r.*, row_number() OVER (PARTITION BY sc.p, sc.s, object_type, old_object_id ORDER BY (profile_id = sc.p) DESC, (source_scope = sc.s) DESC, created_at DESC NULLS LAST, replacement_id DESC) AS k FROM scopes sc JOIN o_replacement r ON r.active AND r.snapshot_id = 's1' AND r.profile_id IN (sc.p, 'all') AND r.source_scope IN (sc.s, 'all')) WHERE k = 1)",
        "ch(p, s, object_type, start, cur, path) AS (SELECT p, s, object_type, old_object_id, new_object_id, [old_object_id, new_object_id] FROM best WHERE old_object_id <> new_object_id UNION ALL SELECT ch.p, ch.s, ch.object_type, start, b.new_object_id, list_append(path, b.new_object_id) FROM ch JOIN best b ON b.p = ch.p AND b.s = ch.s AND b.object_type = ch.object_type AND b.old_object_id = ch.cur WHERE NOT list_contains(path, b.new_object_id))",
        "ends AS (SELECT p, s, object_type, start, arg_max(cur, len(path)) AS cur FROM ch GROUP BY 1, 2, 3, 4)",
    ]
    for k in ("chunk", "entity"):
        parts.append(f"phys_{k} AS (SELECT *, 'overlay' AS layer FROM o_{k} UNION ALL SELECT *, 'baseline' FROM b_{k} WHERE {k}_id NOT IN (SELECT {k}_id FROM o_{k}))")
        parts.append(f"live_{k} AS (SELECT r.{k}_id AS id FROM phys_{k} r WHERE snapshot_id = 's1' AND {in_scope(p, s)} AND NOT {hidden[k]})")
        parts.append(f"over_{k} AS (SELECT r.{k}_id AS logical_id, 'overlay' AS source_index, r.* FROM o_{k} r WHERE {in_scope(p, s)} AND NOT {hidden[k]})")
        parts.append(f"base_{k} AS (SELECT coalesce(e.cur, r.{k}_id) AS logical_id, CASE WHEN e.cur IS NULL THEN 'baseline' ELSE 'merged' END AS source_index, r.* FROM b_{k} r {end(k, f'{k}_id', 'e')} WHERE {in_scope(p, s)} AND CASE WHEN e.cur IS NULL THEN NOT {hidden[k]} ELSE e.cur IN (SELECT id FROM live_{k}) END)")
        parts.append(f"logical_{k} AS (SELECT * FROM over_{k} UNION ALL SELECT * FROM base_{k} WHERE logical_id NOT IN (SELECT logical_id FROM over_{k}) QUALIFY row_number() OVER (PARTITION BY logical_id ORDER BY {k}_id) = 1)")
    dead_r = gone("'relation'", "r.relation_id", p=p, s=s)
    parts.append(f"phys_relation AS (SELECT * FROM o_relation UNION ALL SELECT * FROM b_relation WHERE relation_id NOT IN (SELECT relation_id FROM o_relation))")
    parts.append(f"live_relation AS (SELECT r.relation_id AS id FROM phys_relation r WHERE {in_scope(p, s)} AND NOT {dead_r})")
    for layer in ("o", "b"):
        parts.append(f"{layer}_kept AS (SELECT r.* FROM {layer}_relation r {end('relation', 'relation_id', 'x')} WHERE {in_scope(p, s)} AND NOT {dead_r} AND (x.cur IS NULL OR x.cur NOT IN (SELECT id FROM live_relation)))")
        parts.append(f"{layer}_ends AS (SELECT r.*, coalesce(a.cur, r.src_entity_id) AS src, coalesce(b.cur, r.dst_entity_id) AS dst, (a.cur IS NOT NULL OR b.cur IS NOT NULL) AS moved FROM {layer}_kept r {end('entity', 'src_entity_id', 'a')} {end('entity', 'dst_entity_id', 'b')})")
    alive = "src IN (SELECT id FROM live_entity) AND dst IN (SELECT id FROM live_entity)"
    fresh = "(SELECT logical_id FROM over_entity)"
    parts.append(f"logical_relation AS (SELECT relation_id, relation_type, src, dst, CASE WHEN moved THEN 'merged' ELSE 'overlay' END AS source_index FROM o_ends WHERE {alive} UNION ALL SELECT relation_id, relation_type, src, dst, CASE WHEN moved OR src IN {fresh} OR dst IN {fresh} THEN 'merged' ELSE 'baseline' END FROM b_ends WHERE {alive} AND relation_id NOT IN (SELECT relation_id FROM o_ends WHERE {alive}))")
    dead_v = " OR ".join([gone("'evidence'", "r.evidence_id", p=p, s=s), gone("'file'", "r.file_id", p=p, s=s), gone("'chunk'", "r.chunk_id", p=p, s=s), f"(r.object_type IN ('chunk', 'entity', 'relation') AND {gone('r.object_type', 'r.object_id', p=p, s=s)})"])
    for layer, name in (("o", "overlay"), ("b", "baseline")):
        parts.append(f"{layer}_seen AS (SELECT r.evidence_id, r.object_type, coalesce(e.cur, r.object_id) AS object_id, CASE WHEN e.cur IS NOT NULL AND r.chunk_id = r.object_id THEN e.cur ELSE r.chunk_id END AS chunk_id, CASE WHEN e.cur IS NULL THEN '{name}' ELSE 'merged' END AS source_index, r.file_id, r.citation_label, r.start_line, r.end_line, r.excerpt FROM {layer}_evidence r LEFT JOIN ends e ON e.object_type = r.object_type AND e.start = r.object_id AND e.p = {rp} AND e.s = {rs} WHERE {in_scope(p, s)} AND NOT ({dead_v}) AND (e.cur IS NULL OR (r.object_type = 'chunk' AND e.cur IN (SELECT id FROM live_chunk)) OR (r.object_type = 'entity' AND e.cur IN (SELECT id FROM live_entity))))")
    parts.append("logical_evidence AS (SELECT * FROM o_seen UNION ALL SELECT * FROM b_seen WHERE evidence_id NOT IN (SELECT evidence_id FROM o_seen))")
    parts.append("phys_vector_ref AS (SELECT * FROM o_vector_ref UNION ALL SELECT * FROM b_vector_ref WHERE vector_ref_id NOT IN (SELECT vector_ref_id FROM o_vector_ref))")
    dead_w = gone("'vector_ref'", "r.vector_ref_id", p=p, s=s, snapshot="'s1'")
    parts.append(f"live_ref AS (SELECT r.* FROM phys_vector_ref r WHERE {in_scope(p, s)} AND NOT {dead_w} AND r.object_id IN (SELECT id FROM live_chunk))")
    return f"WITH RECURSIVE {fixture.prelude()}, " + ", ".join(parts) + " " + body


# --- logical views (C) -----------------------------------------------------------------------------


@query(sql("SELECT logical_id, chunk_id, source_index FROM logical_chunk"))
def c5_logical_chunks(spark, sf_dir):
    """Scope ``all``: each row's own scope decides what hides or replaces it (C4)."""
    return fixture.store(spark, sf_dir).logical("chunk").select("logical_id", "chunk_id", "source_index")


@query(sql("SELECT logical_id, chunk_id, source_index FROM logical_chunk", "en", "src1"))
def c4_effective_scope(spark, sf_dir):
    return fixture.store(spark, sf_dir, profile_id="en", source_scope="src1").logical("chunk").select("logical_id", "chunk_id", "source_index")


@query(sql("SELECT logical_id, entity_id, source_index FROM logical_entity"))
def c6_logical_entities(spark, sf_dir):
    return fixture.store(spark, sf_dir).logical("entity").select("logical_id", "entity_id", "source_index")


@query(sql("SELECT relation_id, relation_type, src, dst, source_index FROM logical_relation", "en"))
def c7_logical_relations(spark, sf_dir):
    rows = fixture.store(spark, sf_dir, profile_id="en").relations()
    return rows.select("relation_id", "relation_type", F.col("src_entity_id").alias("src"), F.col("dst_entity_id").alias("dst"), "source_index")


@query(sql("SELECT evidence_id, object_type, object_id, chunk_id, source_index FROM logical_evidence"))
def c8_c9_logical_evidence(spark, sf_dir):
    return fixture.store(spark, sf_dir).evidence().select("evidence_id", "object_type", "object_id", "chunk_id", "source_index")


@query(sql(f"SELECT r.chunk_id FROM b_chunk r WHERE {gone(repr('chunk'), 'r.chunk_id')} OR {gone(repr('file'), 'r.file_id')}"))
def c10_hidden_chunks(spark, sf_dir):
    s = fixture.store(spark, sf_dir)
    rows = s.in_scope(s.baseline["chunk"])
    return rows.join(s.visible(rows, "chunk").select("chunk_id"), "chunk_id", "left_anti").select("chunk_id")


@query(sql("SELECT id AS existing_id FROM live_entity JOIN phys_entity ON entity_id = id JOIN (SELECT file_id, relative_path FROM o_file UNION ALL SELECT file_id, relative_path FROM b_file WHERE file_id NOT IN (SELECT file_id FROM o_file)) USING (file_id) WHERE relative_path = 'src1' OR starts_with(relative_path, 'src1/')", "en"))
def c11_existing_under_path(spark, sf_dir):
    return fixture.store(spark, sf_dir, profile_id="en", path_scope="src1").existing("entity")


@query(sql("SELECT vector_ref_id FROM live_ref"))
def c12_visible_vector_refs(spark, sf_dir):
    return fixture.store(spark, sf_dir).vector_refs().select("vector_ref_id")


@query(sql(f"SELECT r.chunk_id AS live_id FROM o_chunk r WHERE r.profile_id = 'all' AND r.source_scope = 'all' AND NOT EXISTS (SELECT 1 FROM o_tombstone t WHERE t.active AND t.object_type = 'chunk' AND t.snapshot_id = 's1' AND t.profile_id = 'all' AND t.source_scope = 'all' AND (t.object_id = r.chunk_id OR t.baseline_id = r.chunk_id))"))
def c13_overlay_live(spark, sf_dir):
    return fixture.store(spark, sf_dir).overlay_live("chunk")


_TS = "'ts:' || sha1('{\"baseline_id\": ' || CASE WHEN baseline_id IS NULL THEN 'null' ELSE '\"' || baseline_id || '\"' END || ', \"object_id\": \"' || object_id || '\", \"object_type\": \"' || object_type || '\", \"profile_id\": \"' || profile_id || '\", \"reason\": \"gone\", \"snapshot_id\": \"s1\", \"source_scope\": \"' || source_scope || '\"}')"


def _cascade_sql() -> str:
    roots = "roots AS (SELECT DISTINCT file_id FROM files WHERE doc_id % 10 = 4)"
    one = []
    for layer, prefix, base in (("baseline", "b", True), ("overlay", "o", False)):
        for kind in ("file", "chunk", "entity", "evidence"):
            one.append(f"SELECT '{kind}' AS object_type, {kind}_id AS object_id, {f'{kind}_id' if base else 'NULL'} AS baseline_id, profile_id, source_scope FROM {prefix}_{kind} WHERE file_id IN (SELECT file_id FROM roots)")
        held = "('b')" if base else "('b', 'o')"
        ids = lambda kind: " UNION ALL ".join(f"SELECT {kind}_id AS id, '{x}' AS l FROM {x}_{kind} WHERE file_id IN (SELECT file_id FROM roots)" for x in ("b", "o"))  # noqa: E731, B023
        named = lambda kind: f"(SELECT id FROM ({ids(kind)}) WHERE l IN {held})"  # noqa: E731, B023
        one.append(f"SELECT 'relation', relation_id, {'relation_id' if base else 'NULL'}, profile_id, source_scope FROM {prefix}_relation WHERE src_entity_id IN {named('entity')} OR dst_entity_id IN {named('entity')}")
        one.append(f"SELECT 'vector_ref', vector_ref_id, {'vector_ref_id' if base else 'NULL'}, profile_id, source_scope FROM {prefix}_vector_ref WHERE object_type = 'chunk' AND object_id IN {named('chunk')}")
    return f"WITH {fixture.prelude()}, {roots}, every AS ({' UNION ALL '.join(one)}) SELECT DISTINCT object_type, object_id, baseline_id, {_TS} AS tombstone_id FROM every"


@query(_cascade_sql())
def b8_file_cascade(spark, sf_dir):
    s = fixture.store(spark, sf_dir)
    roots = read(spark, sf_dir, "documents").filter("doc_id % 10 = 4").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file_id"))
    return s.file_tombstones(roots, "gone").select("object_type", "object_id", "baseline_id", "tombstone_id")


def _chunk_cascade_sql() -> str:
    one = []
    for prefix, base in (("b", True), ("o", False)):
        roots = "(SELECT 'c' || doc_id FROM documents WHERE doc_id % 10 = 6)"
        one.append(f"SELECT 'chunk' AS object_type, chunk_id AS object_id, {'chunk_id' if base else 'NULL'} AS baseline_id, profile_id, source_scope FROM {prefix}_chunk WHERE chunk_id IN {roots}")
        one.append(f"SELECT 'evidence', evidence_id, {'evidence_id' if base else 'NULL'}, profile_id, source_scope FROM {prefix}_evidence WHERE chunk_id IN {roots} OR (object_type = 'chunk' AND object_id IN {roots})")
        held = "SELECT chunk_id FROM b_chunk" if base else "SELECT chunk_id FROM b_chunk UNION SELECT chunk_id FROM o_chunk"
        one.append(f"SELECT 'vector_ref', vector_ref_id, {'vector_ref_id' if base else 'NULL'}, profile_id, source_scope FROM {prefix}_vector_ref WHERE object_type = 'chunk' AND object_id IN {roots} AND object_id IN ({held})")
    return f"WITH {fixture.prelude()}, every AS ({' UNION ALL '.join(one)}) SELECT DISTINCT object_type, object_id, baseline_id, {_TS} AS tombstone_id FROM every"


@query(_chunk_cascade_sql())
def b9_chunk_cascade(spark, sf_dir):
    s = fixture.store(spark, sf_dir)
    roots = read(spark, sf_dir, "documents").filter("doc_id % 10 = 6").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"))
    return s.chunk_tombstones(roots, "gone").select("object_type", "object_id", "baseline_id", "tombstone_id")


@query(sql("SELECT c.chunk_id, v.vector_ref_id AS embedding_ref, v.embedding_model_version FROM phys_chunk c LEFT JOIN phys_vector_ref v ON v.object_id = c.chunk_id"))
def b4_chunk_embedding_refs(spark, sf_dir):
    return fixture.store(spark, sf_dir).chunks_with_vectors().select("chunk_id", "embedding_ref", "embedding_model_version")


# --- full text (F) -------------------------------------------------------------------------------------

#: The four indexes' rows of the overlay, with their columns as one list.
INDEX = """idx AS (SELECT 'chunk_fts' AS index_name, chunk_id AS object_id, c.snapshot_id, c.profile_id, c.source_scope, c.file_id, relative_path AS rel_path, [title, c.text, symbols, tags] AS columns, title, LAYER AS layer, json_extract_string(f.metadata, '$.domain') AS domain FROM meta c JOIN ffile f USING (file_id)
 UNION ALL SELECT 'doc_fts', chunk_id, c.snapshot_id, c.profile_id, c.source_scope, c.file_id, relative_path, [title, c.text], title, LAYER, json_extract_string(f.metadata, '$.domain') FROM meta c JOIN ffile f USING (file_id) WHERE doc_type IS NOT NULL OR starts_with(chunk_type, 'doc') OR f.language = 'markdown'
 UNION ALL SELECT 'code_fts', chunk_id, c.snapshot_id, c.profile_id, c.source_scope, c.file_id, relative_path, [symbols, NULL, c.text], coalesce(symbols, relative_path, chunk_type), LAYER, json_extract_string(f.metadata, '$.domain') FROM meta c JOIN ffile f USING (file_id) WHERE starts_with(chunk_type, 'code') OR c.doc_id % 10 = 0 OR f.language = 'c'
 UNION ALL SELECT 'entity_fts', entity_id, e.snapshot_id, e.profile_id, e.source_scope, e.file_id, relative_path, [name, qualified_name, regexp_extract(e.metadata, '"aliases": \\["([^"]*)", "([^"]*)"\\]', 1) || ' ' || regexp_extract(e.metadata, '"aliases": \\["([^"]*)", "([^"]*)"\\]', 2), path], name, LAYER, json_extract_string(f.metadata, '$.domain') FROM xentity e LEFT JOIN ffile f USING (file_id))"""
META = """meta AS (SELECT c.*, CASE WHEN doc_id % 10 = 0 THEN 'Health notes' ELSE (SELECT relative_path FROM ffile f WHERE f.file_id = c.file_id) END AS title, CASE WHEN doc_id % 10 = 0 THEN 'part_1 Part 2' WHEN doc_id % 10 = 5 THEN 'part_3' END AS symbols, CASE WHEN doc_id % 10 = 5 THEN 'a b' END AS tags, CASE WHEN doc_id % 10 = 5 THEN 'api' END AS doc_type FROM xchunk c)"""


def index_sql(x: str, layer: str) -> str:
    text = f"{META}, {INDEX}".replace("LAYER", f"'{layer}'")
    for name in ("ffile", "xchunk", "xentity", "meta", "idx"):
        text = text.replace(f"{name} ", f"{x}_{name} ").replace(f"{name})", f"{x}_{name})")
    return f"{x}_ffile AS (SELECT * FROM {x}_file), {x}_xchunk AS (SELECT * FROM {x}_chunk), {x}_xentity AS (SELECT * FROM {x}_entity), {text}"


@query(f"WITH {fixture.prelude()}, {index_sql('o', 'overlay')} SELECT index_name, object_id, title, domain, sha256(array_to_string(list_transform(columns, lambda c: coalesce(c, '-')), '|')) AS body FROM o_idx")
def b3_f6_f7_f8_index_rows(spark, sf_dir):
    rows = fixture.store(spark, sf_dir).index_rows("overlay")
    body = F.sha2(F.array_join(F.transform("columns", lambda c: F.coalesce(c, F.lit("-"))), "|"), 256)
    return rows.select("index_name", "object_id", "title", "domain", body.alias("body"))


_Q = "q AS (SELECT doc_id AS query_id, array_to_string(regexp_extract_all(text, '[A-Za-z]+')[1:2], ' ') AS query FROM documents WHERE doc_id % 40 = 7 AND text IS NOT NULL UNION ALL SELECT 100000 + doc_id, 'part_' || doc_id || ' d' || doc_id FROM documents WHERE doc_id % 100 = 5 UNION ALL SELECT 200001, 'health notes' UNION ALL SELECT 200002, 'Part_1')"


def some_queries(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), 1, 2), " ")
    a = d.filter("doc_id % 40 = 7 and text is not null").select(F.col("doc_id").alias("query_id"), first.alias("query"))
    b = d.filter("doc_id % 100 = 5").select((F.col("doc_id") + 100000).alias("query_id"), F.concat(F.lit("part_"), "doc_id", F.lit(" d"), "doc_id").alias("query"))
    return a.unionByName(b).unionByName(spark.createDataFrame([(200001, "health notes"), (200002, "Part_1")], "query_id long, query string"))


def match_sql(x: str, index: str) -> str:
    """BM25 of every query's units (words and phrases) over one layer's index."""
    tok = lambda c: f"regexp_extract_all(lower(strip_accents({c})), '[\\p{{L}}\\p{{N}}]+')"
    return f"""{x}_line AS (SELECT *, flatten(list_transform(columns, lambda c: list_append({tok("coalesce(c, '')")}, ''))) AS line FROM {x}_idx WHERE index_name = '{index}'),
 {x}_st AS (SELECT count(*)::DOUBLE AS docs, avg(len(list_filter(line, lambda w: w <> ''))) AS mean FROM {x}_line),
 {x}_tf AS (SELECT object_id, unit, words, len(list_filter(line, lambda w: w <> '')) AS length, len(list_filter(range(1, len(line) - len(words) + 2), lambda i: line[i : i + len(words) - 1] = words)) AS tf FROM {x}_line JOIN (SELECT DISTINCT unit, words FROM units) u ON list_has_all(line, words)),
 {x}_hit AS (SELECT * FROM {x}_tf WHERE tf > 0), {x}_df AS (SELECT unit, count(*)::DOUBLE AS df FROM {x}_hit GROUP BY 1),
 {x}_sc AS (SELECT query_id, object_id, round(-sum(times * CASE WHEN ln((docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS bm25, count(*) AS hit FROM units JOIN {x}_hit USING (unit) JOIN {x}_df USING (unit), {x}_st GROUP BY 1, 2),
 {x}_match AS (SELECT query_id, s.object_id, bm25, l.* EXCLUDE (object_id) FROM {x}_sc s JOIN {x}_line l USING (object_id) WHERE hit = (SELECT count(*) FROM units u WHERE u.query_id = s.query_id))"""


def units_sql() -> str:
    return f"{_Q}, runs AS (SELECT query_id, regexp_extract_all(lower(strip_accents(run)), '[\\p{{L}}\\p{{N}}]+') AS words FROM (SELECT query_id, unnest(regexp_extract_all(query, '[A-Za-z0-9_./:-]+')) AS run FROM q)), units AS (SELECT query_id, array_to_string(words, ' ') AS unit, words, count(*) AS times FROM runs WHERE len(words) > 0 GROUP BY 1, 2, 3)"


def search_sql(index: str, top: int, p: str = "all", extra: str = "true", tag: str = "") -> str:
    """Rank, keep 4 x top, then hide, redirect and fuse."""
    kind = "entity" if index == "entity_fts" else "chunk"
    rp = f"'{p}'" if p != "all" else "r.profile_id"
    parts = []
    for x, layer in (("o", "overlay"), ("b", "baseline")):
        asked = f"EXISTS (SELECT 1 FROM o_tombstone t WHERE t.active AND t.object_type = '{kind}' AND t.snapshot_id = 's1' AND t.profile_id IN ('{p}', 'all') AND t.source_scope = 'all' AND (t.object_id = e.cur OR t.baseline_id = e.cur))"
        fresh = f"r.object_id IN (SELECT r.{kind}_id FROM o_{kind} r WHERE r.profile_id IN ('{p}', 'all') AND r.source_scope = 'all' AND NOT EXISTS (SELECT 1 FROM o_tombstone t WHERE t.active AND t.object_type = '{kind}' AND t.snapshot_id = 's1' AND t.profile_id IN ('{p}', 'all') AND t.source_scope = 'all' AND (t.object_id = r.{kind}_id OR t.baseline_id = r.{kind}_id)))"
        parts.append(f"{x}_rank{tag} AS (SELECT r.*, row_number() OVER (PARTITION BY query_id ORDER BY bm25, object_id) AS rank FROM {x}_match{tag} r WHERE {in_scope(p, 'all')} AND {extra} QUALIFY rank <= {4 * top})")
        own = f"NOT {gone(repr(kind), 'r.object_id', p=p)}" + (f" AND NOT {fresh}" if x == "b" else "")
        parts.append(f"{x}_cand{tag} AS (SELECT query_id, coalesce(e.cur, r.object_id) AS logical_id, r.object_id, CASE WHEN e.cur IS NULL THEN '{layer}' ELSE 'merged' END AS source_index, bm25, rank FROM {x}_rank{tag} r LEFT JOIN ends e ON e.object_type = '{kind}' AND e.start = r.object_id AND e.p = {rp} AND e.s = r.source_scope WHERE NOT {gone(repr('file'), 'r.file_id', p=p)} AND CASE WHEN e.cur IS NULL THEN {own} ELSE e.cur IN (SELECT id FROM live_{kind}) AND NOT {asked} END)")
    pr = "CASE source_index WHEN 'overlay' THEN 3 WHEN 'merged' THEN 2 ELSE 1 END"
    parts.append(f"fused{tag} AS (SELECT query_id, logical_id, sum(1.0 / (60 + rank)) AS score, first(object_id ORDER BY {pr} DESC, bm25, l) AS object_id, first(source_index ORDER BY {pr} DESC, bm25, l) AS source_index, first(bm25 ORDER BY {pr} DESC, bm25, l) AS bm25 FROM (SELECT *, 0 AS l FROM o_cand{tag} UNION ALL SELECT *, 1 FROM b_cand{tag}) GROUP BY 1, 2)")
    parts.append(f"found{tag} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {pr} DESC, logical_id) AS rank FROM fused{tag} QUALIFY rank <= {top})")
    return ", ".join(parts)


def with_search(index: str, top: int, p: str = "all", extra: str = "true", body: str = "SELECT query_id, logical_id, object_id, source_index, bm25, round(score, 6) AS score, rank FROM found") -> str:
    base = sql("", p).rstrip()
    return f"{base}, {index_sql('o', 'overlay')}, {index_sql('b', 'baseline')}, {units_sql()}, {match_sql('o', index)}, {match_sql('b', index)}, {search_sql(index, top, p, extra)} {body}"


SHOWN = ["query_id", "logical_id", "object_id", "source_index", "bm25"]


@query(with_search("chunk_fts", 5))
def f3_f4_f5_store_search(spark, sf_dir):
    got = fulltext.search_store(fixture.store(spark, sf_dir), "chunk_fts", some_queries(spark, sf_dir), 5)
    return got.select(*SHOWN, F.round("score", 6).alias("score"), n("rank"))


@query(with_search("entity_fts", 3, "en", "rel_path ILIKE 'src1%' AND domain = 'en'"))
def f3_scoped_filters(spark, sf_dir):
    """Profile, path prefix and domain are filtered after matching, before ranks."""
    s = fixture.store(spark, sf_dir, profile_id="en")
    got = fulltext.search_store(s.within(path_scope="src1"), "entity_fts", some_queries(spark, sf_dir), 3, domain="en")
    return got.select(*SHOWN, F.round("score", 6).alias("score"), n("rank"))


MODULES = """mods AS (SELECT f.file_id, coalesce(nullif(m.qualified_name, ''), m.name) AS module, min(CASE WHEN r.source_index = 'overlay' THEN '0' ELSE '1' END || r.relation_id) AS pos FROM logical_relation r JOIN logical_entity f ON f.logical_id = r.src AND f.entity_type = 'File' JOIN logical_entity m ON m.logical_id = r.dst AND m.entity_type = 'Module' WHERE relation_type = 'belongs_to_module' GROUP BY 1, 2)"""


@query(sql("", "all").rstrip() + f", {MODULES} SELECT file_id, array_to_string(list(module ORDER BY pos), '|') AS modules FROM mods GROUP BY 1")
def f10_module_names(spark, sf_dir):
    return fulltext.module_names(fixture.store(spark, sf_dir)).select("file_id", F.array_join("modules", "|").alias("modules"))


@query(with_search("entity_fts", 5, body=f", {MODULES}, ml AS (SELECT file_id, list(module ORDER BY pos) AS m FROM mods GROUP BY 1) SELECT query_id, logical_id, array_to_string(list_filter(list_distinct_ordered, lambda x: x <> ''), '|') AS modules FROM (SELECT query_id, logical_id, list_reduce(list_transform(list_concat(coalesce(m, []), [regexp_extract(e.metadata, '\"module\": \"([^\"]*)\"', 1)], CASE WHEN entity_type = 'Module' THEN [name, qualified_name, regexp_extract(e.metadata, '\"aliases\": \\[\"([^\"]*)\", \"([^\"]*)\"\\]', 1), regexp_extract(e.metadata, '\"aliases\": \\[\"([^\"]*)\", \"([^\"]*)\"\\]', 2)] ELSE [] END), lambda x: [trim(x)]), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END) AS list_distinct_ordered FROM found JOIN phys_entity e ON e.entity_id = object_id LEFT JOIN ml ON ml.file_id = e.file_id) WHERE len(list_filter(list_distinct_ordered, lambda x: contains(lower(x), 'brand#1') OR contains(array_to_string(regexp_extract_all(lower(x), '[a-z0-9]+'), ' '), 'brand 1'))) > 0"))
def f11_f12_match_modules(spark, sf_dir):
    s = fixture.store(spark, sf_dir)
    got = fulltext.match_modules(s, fulltext.search_store(s, "entity_fts", some_queries(spark, sf_dir), 5))
    return got.filter(fulltext.in_module(F.col("module_names"), "Brand#1")).select("query_id", "logical_id", F.array_join("module_names", "|").alias("modules"))


# --- vectors (E) ------------------------------------------------------------------------------------------


_COS = "list_dot_product(v.embedding::DOUBLE[], a.embedding::DOUBLE[]) / (sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])))"
_LIVE_VECTORS = f"""rows AS (SELECT v.*, 'overlay' AS source_index, 3 AS pr FROM vectors v WHERE vec_id % 7 = 0 OR vec_id % 9 = 4 UNION ALL SELECT v.*, 'baseline', 1 FROM vectors v WHERE vec_id % 7 <> 0),
 okv AS (SELECT r.* FROM rows r JOIN live_ref f ON f.vector_ref_id = r.vector_ref_id AND f.object_id = r.object_id AND f.content_hash = r.content_hash JOIN logical_chunk c ON c.logical_id = r.object_id AND c.content_hash = r.content_hash
 WHERE r.embedding_model_version = 'm1' AND NOT {gone("'chunk'", "r.object_id", snapshot="'s1'")} AND NOT {gone("'vector_ref'", "r.vector_ref_id", snapshot="'s1'")} AND NOT EXISTS (SELECT 1 FROM ends e WHERE e.object_type = 'chunk' AND e.start = r.object_id AND e.p = r.profile_id AND e.s = r.source_scope))"""


@query(sql("").rstrip() + f""", {_LIVE_VECTORS}, pairs AS (SELECT a.vec_id AS query_id, v.object_id AS logical_id, v.source_index, v.pr, v.vector_ref_id, round({_COS}, 6) AS score, f.lang AS domain FROM okv v JOIN embeddings a ON a.vec_id % 20 = 0 JOIN files f ON f.file_id = 'f' || v.vec_id),
 one AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id, logical_id ORDER BY pr DESC, score DESC, vector_ref_id) = 1), few AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pr DESC, logical_id) <= 24)
 SELECT query_id, logical_id, source_index, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pr DESC, logical_id) AS rank FROM few QUALIFY rank <= 5""")
def e3_e4_e6_vector_store(spark, sf_dir):
    """Live vectors of the expected model, the higher layer's first, over-fetched and cut."""
    asked = read(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = vectors.search_vectors(fixture.store(spark, sf_dir), fixture.vectors(spark, sf_dir), asked, 5, "m1")
    return got.select("query_id", "logical_id", "source_index", "score", n("rank"))


@query(f"WITH {fixture.prelude()} SELECT 'overlay' AS source_index, array_to_string(list_sort(list(DISTINCT embedding_model_version)), ',') AS versions, bool_and(embedding_model_version <> 'm2') AS skipped FROM vectors WHERE vec_id % 7 = 0 OR vec_id % 9 = 4 UNION ALL SELECT 'baseline', array_to_string(list_sort(list(DISTINCT embedding_model_version)), ','), bool_and(embedding_model_version <> 'm2') FROM vectors WHERE vec_id % 7 <> 0")
def e5_version_gate(spark, sf_dir):
    return vectors.version_gate(fixture.vectors(spark, sf_dir), "m2").select("source_index", F.array_join("versions", ",").alias("versions"), "skipped")


@query(sql("SELECT c.chunk_id AS object_id, coalesce(json_extract_string(c.metadata, '$.title'), c.chunk_type) AS title, trim(regexp_replace(c.text, '\\s+', ' ', 'g'))[1:240] AS snippet, f.relative_path AS rel_path FROM phys_chunk c JOIN (SELECT file_id, relative_path FROM files) f USING (file_id)"))
def e8_hydration(spark, sf_dir):
    s = fixture.store(spark, sf_dir)
    m = s.physical("chunk").select(F.lit("chunk").alias("object_type"), F.col("chunk_id").alias("object_id"))
    return vectors.hydrate(s, m).select("object_id", "title", "snippet", "rel_path")


@query("SELECT 'fts_fallback' AS mode, 'embedding.version_mismatch,retrieval.vector_fallback' AS warnings")
def e7_fallback_to_text(spark, sf_dir):
    """Vectors of another model only: full text answers, with both warnings."""
    asked = read(spark, sf_dir, "embeddings").filter("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.lit("health notes").alias("query"))
    _, mode, warnings = vectors.search_or_fall_back(fixture.store(spark, sf_dir), fixture.vectors(spark, sf_dir), asked, 5, "m2")
    return spark.createDataFrame([(mode, ",".join(warnings))], "mode string, warnings string")


# --- symbols (Y) ---------------------------------------------------------------------------------------------


_NAMES = "asked AS (SELECT p_partkey AS query_id, CASE p_partkey % 4 WHEN 0 THEN 'Part_' || (p_partkey + 1) WHEN 1 THEN p_brand || '::' || p_name WHEN 2 THEN p_type ELSE ' part   ' || p_partkey END AS query FROM part WHERE p_partkey % 25 IN (1, 2, 3, 4) AND p_partkey < 120)"


def some_names(spark, sf_dir):
    p = read(spark, sf_dir, "part").filter("p_partkey % 25 in (1, 2, 3, 4) and p_partkey < 120")
    k = F.col("p_partkey")
    return p.select(k.alias("query_id"), F.when(k % 4 == 0, F.concat(F.lit("Part_"), k + 1)).when(k % 4 == 1, F.concat_ws("::", "p_brand", "p_name")).when(k % 4 == 2, F.col("p_type")).otherwise(F.concat(F.lit(" part   "), k)).alias("query"))


_X = lambda c: f"trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"
_L = lambda c: f"array_to_string(regexp_extract_all(lower({c}), '[a-z0-9]+'), ' ')"
_LADDER = f"CASE {_X('query')} WHEN {_X('name')} THEN 1.0 WHEN {_X('qualified_name')} THEN 0.99 WHEN {_X('relative_path')} THEN 0.98 WHEN {_X('split_part(relative_path, chr(47), -1)')} THEN 0.97 WHEN {_X('path')} THEN 0.96 END"
_ALIASES = "[regexp_extract(metadata, '\"aliases\": \\[\"([^\"]*)\", \"([^\"]*)\"\\]', 1), regexp_extract(metadata, '\"aliases\": \\[\"([^\"]*)\", \"([^\"]*)\"\\]', 2)]"


@query(sql("").rstrip() + f""", {_NAMES}, pf AS (SELECT file_id, relative_path FROM o_file UNION ALL SELECT file_id, relative_path FROM b_file WHERE file_id NOT IN (SELECT file_id FROM o_file)),
 c AS (SELECT query_id, logical_id, {_LADDER} AS exact, CASE WHEN len(list_filter({_ALIASES}, lambda a: {_X('a')} = {_X('query')} OR {_L('a')} = {_L('query')})) > 0 THEN 0.94 END AS alias FROM logical_entity LEFT JOIN pf USING (file_id), asked WHERE entity_type IN ('Function', 'Macro', 'Type'))
 SELECT query_id, logical_id, exact::DOUBLE AS exact, alias::DOUBLE AS alias FROM c WHERE exact IS NOT NULL OR alias IS NOT NULL""")
def y1_y2_y3_exact_and_alias(spark, sf_dir):
    """Type group ``symbol``, the ladder of exact scores, aliases in either form."""
    from ..functions import text as tx

    s = fixture.store(spark, sf_dir)
    e = s.logical("entity").filter(F.col("entity_type").isin(*symbols.types_of("symbol"))).join(s.scoped("file").select("file_id", "relative_path"), "file_id", "left")
    e = e.withColumn("aliases", tx.metadata_list(F.col("metadata"), "aliases")).withColumn("one", F.lit(1))
    pairs = e.join(F.broadcast(some_names(spark, sf_dir).withColumn("one", F.lit(1))), "one")
    x, lk = tx.exact_form(F.col("query")), tx.lookup_form(F.col("query"))
    return pairs.select("query_id", "logical_id", symbols.exact_score(x).alias("exact"), symbols.alias_score(x, lk).alias("alias")).filter("exact is not null or alias is not null")


@query()
def y4_y5_y6_candidates(spark, sf_dir):
    """Whole candidates; the matching ratio has no SQL, so unit tests hold it."""
    got = symbols.candidates(fixture.store(spark, sf_dir), some_names(spark, sf_dir).filter("query_id < 60"), 5)
    return got.select("query_id", n("rank"), "logical_id", "entity_type", "score", F.array_join("match_kinds", ",").alias("match_kinds"), "total", "disambiguation")


@query(sql("SELECT object_id AS logical_id, array_to_string(list_sort(list(evidence_id)), ',') AS evidence_ids FROM logical_evidence WHERE object_type = 'entity' GROUP BY 1"))
def y7_entity_evidence(spark, sf_dir):
    return symbols.evidence_ids(fixture.store(spark, sf_dir)).select("logical_id", F.array_join("evidence_ids", ",").alias("evidence_ids"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Function' ELSE 'Macro' END || ' | ' || CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE 'src/' || p_brand END || CASE WHEN p_size > 20 THEN ' | module=' || p_type ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ' | profile=en' END AS disambiguation FROM part")
def y8_disambiguation(spark, sf_dir):
    k = F.col("p_partkey")
    p = read(spark, sf_dir, "part").select("p_partkey", F.when(k % 2 == 0, "Function").otherwise("Macro").alias("entity_type"), F.when(k % 3 != 0, F.concat(F.lit("src/"), "p_brand")).alias("relative_path"), F.col("p_name").alias("qualified_name"), F.when(k % 5 == 0, "all").otherwise("en").alias("profile_id"), F.when(F.col("p_size") > 20, F.array("p_type", "p_brand")).otherwise(F.array().cast("array<string>")).alias("modules"))
    return p.select("p_partkey", symbols.disambiguation(F.col("modules")).alias("disambiguation"))


@query("""WITH c AS (SELECT p_brand AS key, p_partkey AS id, round(p_size / 50, 2) AS score, p_size > 47 AS exact FROM part WHERE p_partkey % 9 < 4), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, exact DESC, id DESC) AS k FROM c),
 g AS (SELECT key, count(*) AS n, count(*) FILTER (WHERE exact) AS x, max(score) FILTER (WHERE k = 1) AS a, bool_or(exact) FILTER (WHERE k = 1) AS e, max(score) FILTER (WHERE k = 2) AS b FROM r GROUP BY key)
 SELECT k.key, CASE WHEN n IS NULL THEN 'zero_result' WHEN n = 1 OR x = 1 OR (e AND round(a - b, 9) >= 0.15) THEN 'resolved' ELSE 'multi_result' END AS status FROM (SELECT DISTINCT p_brand AS key FROM part UNION ALL SELECT 'none') k LEFT JOIN g ON g.key = k.key""")
def y9_resolve_status(spark, sf_dir):
    """One candidate, one exact match, or an exact one clearly ahead."""
    p = read(spark, sf_dir, "part")
    found = p.filter("p_partkey % 9 < 4").select(F.col("p_brand").alias("key"), F.col("p_partkey").alias("id"), F.round(F.col("p_size") / 50, 2).alias("score"), (F.col("p_size") > 47).alias("exact"))
    keys = p.select(F.col("p_brand").alias("key")).distinct().union(spark.createDataFrame([("none",)], "key string"))
    return symbols.resolve_status(keys, found).select("key", "status")


# --- graph (G) -------------------------------------------------------------------------------------------------

_EDGE = "ed AS (SELECT src, dst, relation_type FROM logical_relation WHERE relation_type IN ('contains', 'defines', 'belongs_to_module') AND src IN (SELECT logical_id FROM logical_entity) AND dst IN (SELECT logical_id FROM logical_entity)), un AS (SELECT src AS a, dst AS b FROM ed UNION SELECT dst, src FROM ed)"
_REACH = f"{_EDGE}, n0 AS (SELECT logical_id AS node FROM logical_entity WHERE logical_id IN ('e3', 'e10', 'e40')), n1 AS (SELECT DISTINCT b AS node FROM un JOIN n0 ON a = node), n2 AS (SELECT DISTINCT b AS node FROM un JOIN n1 ON a = node), reach_ AS (SELECT node, min(d)::BIGINT AS depth FROM (SELECT node, 0 AS d FROM n0 UNION ALL SELECT node, 1 FROM n1 UNION ALL SELECT node, 2 FROM n2) GROUP BY 1)"


def _graph(spark, sf_dir):
    s = fixture.store(spark, sf_dir)
    edges = s.relations().select(F.col("src_entity_id").alias("src"), F.col("dst_entity_id").alias("dst"), "relation_type")
    live = s.logical("entity").select(F.col("logical_id").alias("node"))
    seeds = spark.createDataFrame([("e3",), ("e10",), ("e40",), ("gone",)], "node string")
    types = tuple(t for t in graph.relation_types("code_exact") if t not in graph.SYNTHETIC)
    return edges, live, seeds, types


@query(sql("").rstrip() + f", {_REACH} SELECT node, depth FROM reach_")
def g1_g5_live_search(spark, sf_dir):
    """Two hops over the relations of an intent, between live entities."""
    edges, live, seeds, types = _graph(spark, sf_dir)
    return graph.expand(edges, seeds, graph.depth_of("call_trace"), types, live).select("node", n("depth"))


@query(sql("").rstrip() + f", {_REACH}, m AS (SELECT entity_id AS node, 'layer:' || split_part(qualified_name, '::', 1) AS item FROM entities WHERE p_partkey % 2 = 1) SELECT item AS node, (min(depth) + 1)::BIGINT AS depth, count(DISTINCT reach_.node) AS members FROM m JOIN reach_ ON m.node = reach_.node WHERE depth + 1 <= 2 GROUP BY 1")
def g3_synthetic_layers(spark, sf_dir):
    edges, live, seeds, types = _graph(spark, sf_dir)
    reached = graph.expand(edges, seeds, 2, types, live)
    p = read(spark, sf_dir, "part").filter("p_partkey % 2 = 1").select(F.concat(F.lit("e"), "p_partkey").alias("node"), F.concat(F.lit("layer:"), "p_brand").alias("item"))
    nodes, _ = graph.projected(p, reached, 2, "belongs_to_layer")
    return nodes.select("node", n("depth"), F.size("members").cast("long").alias("members"))


@query(sql("SELECT relation_id, 'overlay' AS source_index, src NOT IN (SELECT logical_id FROM logical_entity) AS missing_src, dst NOT IN (SELECT logical_id FROM logical_entity) AS missing_dst FROM o_ends WHERE src NOT IN (SELECT logical_id FROM logical_entity) OR dst NOT IN (SELECT logical_id FROM logical_entity) UNION ALL SELECT relation_id, 'baseline', src NOT IN (SELECT logical_id FROM logical_entity), dst NOT IN (SELECT logical_id FROM logical_entity) FROM b_ends WHERE (src NOT IN (SELECT logical_id FROM logical_entity) OR dst NOT IN (SELECT logical_id FROM logical_entity)) AND relation_id NOT IN (SELECT relation_id FROM o_ends)"))
def g6_q4_orphan_relations(spark, sf_dir):
    return fixture.store(spark, sf_dir).orphan_relations()


# --- evidence (H) -----------------------------------------------------------------------------------------------


_REFS = """pfile AS (SELECT file_id, relative_path FROM o_file UNION ALL SELECT file_id, relative_path FROM b_file WHERE file_id NOT IN (SELECT file_id FROM o_file)),
 refs AS (SELECT r.*, coalesce(f.relative_path, r.citation_label) AS path, CASE WHEN false THEN '' ELSE 'code' END AS type, coalesce(r.start_line, c.start_line, e.start_line) AS a, coalesce(r.end_line, c.end_line, e.end_line) AS b FROM logical_evidence r LEFT JOIN phys_chunk c ON c.chunk_id = r.chunk_id LEFT JOIN pfile f ON f.file_id = r.file_id LEFT JOIN phys_entity e ON r.object_type = 'entity' AND e.entity_id = r.object_id)"""


@query(sql("").rstrip() + f""", {_REFS}, cand AS (SELECT doc_id % 5 AS query_id, 'k' || doc_id AS candidate_id, row_number() OVER (PARTITION BY doc_id % 5 ORDER BY doc_id) AS rank, round(1.0 / (doc_id + 2), 6) AS score, ['v' || doc_id, 'c' || (doc_id + 1), 'e' || doc_id, 'f' || (doc_id + 2)] AS keys FROM documents WHERE doc_id < 60),
 ks AS (SELECT query_id, candidate_id, rank, score, unnest(keys) AS key, unnest(range(4)) AS k FROM cand), hit AS (SELECT ks.*, refs.evidence_id, type, path, a, b, CASE WHEN key = refs.evidence_id THEN 0 WHEN key = refs.chunk_id THEN 1 WHEN key = refs.object_id THEN 2 ELSE 3 END AS bucket FROM ks JOIN refs ON key IN (refs.evidence_id, refs.chunk_id, refs.object_id, refs.file_id)),
 g AS (SELECT query_id, type, path, a, b, min((rank, k, bucket, evidence_id)) AS o, max(score) AS score, list_sort(list(DISTINCT candidate_id)) AS c FROM hit GROUP BY 1, 2, 3, 4, 5)
 SELECT query_id, path, a::BIGINT AS start_line, score, array_to_string(c, ',') AS candidates, row_number() OVER (PARTITION BY query_id ORDER BY o) AS place FROM g QUALIFY place <= 20""")
def h13_evidence_bundle(spark, sf_dir):
    d = read(spark, sf_dir, "documents").filter("doc_id < 60")
    from pyspark.sql import Window

    name = lambda p, k: F.concat(F.lit(p), (F.col("doc_id") + k).cast("string"))
    ranked = d.select((F.col("doc_id") % 5).alias("query_id"), name("k", 0).alias("candidate_id"), F.row_number().over(Window.partitionBy(F.col("doc_id") % 5).orderBy("doc_id")).alias("rank"), F.round(1 / (F.col("doc_id") + 2), 6).alias("score"), F.array(name("v", 0), name("c", 1), name("e", 0), name("f", 2)).alias("evidence_keys"), F.array(F.struct(F.lit("fts").alias("retriever"))).alias("signals"))
    got = fusion.bundle(fixture.store(spark, sf_dir), ranked)
    return got.select("query_id", "path", n("start_line"), "score", F.array_join("candidates", ",").alias("candidates"), n("place"))


@query(sql("").rstrip() + f", {_REFS}, own AS (SELECT object_id AS entity_id, type, path, a, b, min(evidence_id) AS evidence_id FROM refs WHERE object_type = 'entity' GROUP BY 1, 2, 3, 4, 5), every AS (SELECT entity_id, evidence_id, path FROM own WHERE entity_id IN (SELECT entity_id FROM entities WHERE p_partkey < 80) UNION ALL SELECT entity_id, 'entity:' || entity_id, path FROM phys_entity WHERE p_partkey < 80 AND entity_id NOT IN (SELECT entity_id FROM own)) SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY evidence_id) AS place FROM every QUALIFY place <= 20")
def h14_entity_evidence(spark, sf_dir):
    s = fixture.store(spark, sf_dir)
    ids = s.physical("entity").filter("p_partkey < 80").select("entity_id")
    return fusion.entity_evidence(s, ids).select("entity_id", "evidence_id", "path", n("place"))


# --- validation (Q) -----------------------------------------------------------------------------------------------


@query(sql("SELECT 'storage.fts_metadata_mismatch' AS check_code, 'entity:' || entity_id AS object FROM logical_entity WHERE source_index <> 'merged' AND p_partkey % 10 = 3 UNION ALL SELECT 'storage.fts_metadata_mismatch', 'chunk:' || chunk_id FROM logical_chunk WHERE source_index <> 'merged' AND doc_id % 10 = 3"))
def q1_index_consistency(spark, sf_dir):
    """Against an index from which every tenth row was lost."""
    s = fixture.store(spark, sf_dir)
    index = {layer: s.index_rows(layer).filter(~F.col("object_id").rlike("3$")) for layer in ("overlay", "baseline")}
    return validation.missing_index_rows(s, index).select("check_code", "object")


@query(f"WITH {fixture.prelude()}, a AS (SELECT * FROM b_vector_ref), b AS (SELECT * FROM vectors WHERE vec_id % 7 <> 0 AND vec_id % 5 <> 1) SELECT CASE WHEN b.vector_ref_id IS NULL THEN 'storage.vector_ref_missing' WHEN a.vector_ref_id IS NULL THEN 'storage.vector_payload_orphan' ELSE 'storage.vector_ref_payload_mismatch' END AS check_code, 'vector_ref:' || coalesce(a.vector_ref_id, b.vector_ref_id) AS object, CASE WHEN a.content_hash IS DISTINCT FROM b.content_hash AND a.vector_ref_id IS NOT NULL AND b.vector_ref_id IS NOT NULL THEN 'content_hash' ELSE '' END AS fields FROM a FULL JOIN b ON a.vector_ref_id = b.vector_ref_id WHERE a.vector_ref_id IS NULL OR b.vector_ref_id IS NULL OR a.content_hash IS DISTINCT FROM b.content_hash")
def q2_vector_mismatches(spark, sf_dir):
    rows = fixture.vectors(spark, sf_dir)["baseline"].filter("vec_id % 5 <> 1")
    return validation.vector_mismatches(fixture.store(spark, sf_dir).baseline["vector_ref"], rows).select("check_code", "object", F.array_join("fields", ",").alias("fields"))


@query(sql("SELECT 'evidence:' || evidence_id AS object, 'chunk:' || chunk_id AS target FROM logical_evidence WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT logical_id FROM logical_chunk) UNION ALL SELECT 'evidence:' || evidence_id, 'entity:' || object_id FROM logical_evidence WHERE object_type = 'entity' AND object_id NOT IN (SELECT logical_id FROM logical_entity)"))
def q3_dangling_evidence(spark, sf_dir):
    return validation.dangling_evidence(fixture.store(spark, sf_dir)).select("object", "target")


@query(sql("SELECT DISTINCT t.object_type || ':' || t.object_id AS object FROM o_tombstone t WHERE t.active AND t.snapshot_id = 's1' AND ((t.object_type = 'chunk' AND t.object_id IN (SELECT logical_id FROM logical_chunk)) OR (t.object_type = 'entity' AND t.object_id IN (SELECT logical_id FROM logical_entity)) OR (t.object_type = 'relation' AND t.object_id IN (SELECT relation_id FROM logical_relation)) OR (t.object_type = 'evidence' AND t.object_id IN (SELECT evidence_id FROM logical_evidence)) OR (t.object_type = 'vector_ref' AND t.object_id IN (SELECT vector_ref_id FROM live_ref)))"))
def q5_tombstone_leaks(spark, sf_dir):
    """Tombstones of narrower scopes leave their object visible to others, which is a leak by this check."""
    return validation.tombstone_leaks(fixture.store(spark, sf_dir)).select("object")


@query(f"WITH RECURSIVE {fixture.prelude()}, e AS (SELECT object_type, old_object_id AS a, arg_max(new_object_id, replacement_id) AS b FROM o_replacement WHERE active GROUP BY 1, 2), w(object_type, start, cur, path, looped) AS (SELECT object_type, a, b, [a, b], a = b FROM e UNION ALL SELECT w.object_type, start, e.b, list_append(path, e.b), list_contains(path, e.b) FROM w JOIN e ON e.object_type = w.object_type AND e.a = w.cur WHERE NOT looped) SELECT DISTINCT object_type, start AS old_id FROM w WHERE looped")
def q6_replacement_loops(spark, sf_dir):
    return validation.replacement_loops(fixture.store(spark, sf_dir).overlay["replacement"]).select("object_type", "old_id")
