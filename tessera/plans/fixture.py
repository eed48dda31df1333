"""A two-layer store made of the shared tables, for the registered queries.

The CTEs are plain SQL that both engines read, so the queries and their SQL see
the same rows: files, chunks and evidence come from documents, entities from
parts, relations from order lines, vectors from embeddings. The overlay holds
every seventh document anew and some others revised; tombstones and
replacements are a few residues, with chains, a loop, and narrower scopes.
"""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import DataFrame

from ..operators.lineage import settled
from ..operators.store import Scope, Store

FILES = """files AS (SELECT doc_id, concat('f', CAST(doc_id AS VARCHAR(20))) AS file_id, 's1' AS snapshot_id, CASE WHEN doc_id % 3 = 0 THEN 'docs' ELSE 'workspace' END AS source_id,
 concat(source, '/', lang, '/d', CAST(doc_id AS VARCHAR(20)), '.md') AS relative_path, md5(text) AS content_hash, CASE WHEN doc_id % 5 = 0 THEN 'all' ELSE source END AS source_scope, CASE WHEN doc_id % 4 = 0 THEN 'all' ELSE lang END AS profile_id,
 CASE WHEN doc_id % 3 = 0 THEN 'markdown' ELSE 'c' END AS language, concat('{"domain": "', lang, '"}') AS metadata, text, lang FROM documents WHERE text IS NOT NULL)"""
CTES = {
    "files": FILES,
    "b_file": "b_file AS (SELECT * FROM files WHERE doc_id % 7 <> 0)",
    "o_file": "o_file AS (SELECT * FROM files WHERE doc_id % 7 = 0 OR doc_id % 9 = 4)",
    "chunks": """chunks AS (SELECT doc_id, concat('c', CAST(doc_id AS VARCHAR(20))) AS chunk_id, snapshot_id, file_id, content_hash, CASE WHEN doc_id % 2 = 0 THEN 'doc_section' ELSE 'code.function' END AS chunk_type, CAST(0 AS INT) AS ordinal, text, source_scope, profile_id, CAST(1 AS INT) AS start_line, CAST(doc_id % 50 + 1 AS INT) AS end_line,
 CASE WHEN doc_id % 10 = 0 THEN '{"symbol_names": [], "title": "Health notes", "code_symbols": ["part_1", "Part 2"]}' WHEN doc_id % 10 = 5 THEN '{"tags": ["a", "b"], "doc_type": "api", "symbols": ["part_3"]}' ELSE '{}' END AS metadata FROM files)""",
    "b_chunk": "b_chunk AS (SELECT * FROM chunks WHERE doc_id % 7 <> 0)",
    "o_chunk": "o_chunk AS (SELECT * FROM chunks WHERE doc_id % 7 = 0 OR doc_id % 9 = 4)",
    "entities": """entities AS (SELECT p_partkey, concat('e', CAST(p_partkey AS VARCHAR(20))) AS entity_id, 's1' AS snapshot_id, concat('f', CAST(p_partkey % 150 AS VARCHAR(20))) AS file_id, CASE p_partkey % 6 WHEN 0 THEN 'Function' WHEN 1 THEN 'Macro' WHEN 2 THEN 'Type' WHEN 3 THEN 'File' WHEN 4 THEN 'Module' ELSE 'Directory' END AS entity_type,
 concat('part_', CAST(p_partkey AS VARCHAR(20))) AS name, concat(p_brand, '::', p_name) AS qualified_name, concat('src/', p_name) AS path, CASE WHEN p_partkey % 5 = 1 THEN 'src1' ELSE 'all' END AS source_scope, CASE WHEN p_partkey % 8 = 3 THEN 'en' ELSE 'all' END AS profile_id, CAST(p_partkey % 40 + 1 AS INT) AS start_line, CAST(p_partkey % 40 + 3 AS INT) AS end_line,
 concat('{"aliases": ["', p_type, '", "part ', CAST(p_partkey AS VARCHAR(20)), '"], "module": "', p_brand, '"}') AS metadata FROM part)""",
    "b_entity": "b_entity AS (SELECT * FROM entities WHERE p_partkey % 6 <> 5 OR p_partkey % 4 = 0)",
    "o_entity": "o_entity AS (SELECT * FROM entities WHERE p_partkey % 6 = 5 OR p_partkey % 11 = 7)",
    "relations": """relations AS (SELECT l_orderkey, l_linenumber, concat('r', CAST(l_orderkey AS VARCHAR(20)), '_', CAST(l_linenumber AS VARCHAR(20))) AS relation_id, 's1' AS snapshot_id, CASE l_returnflag WHEN 'A' THEN 'contains' WHEN 'N' THEN 'belongs_to_module' ELSE 'defines' END AS relation_type, concat('e', CAST(min(l_partkey) AS VARCHAR(20))) AS src_entity_id, concat('e', CAST(min(l_partkey) + min(l_suppkey) AS VARCHAR(20))) AS dst_entity_id,
 CASE WHEN l_linenumber = 2 THEN 'src1' ELSE 'all' END AS source_scope, CASE WHEN l_orderkey % 3 = 0 THEN 'en' ELSE 'all' END AS profile_id, '{}' AS metadata FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey % 4 = 1 GROUP BY l_orderkey, l_linenumber, l_returnflag)""",
    "b_relation": "b_relation AS (SELECT relation_id, snapshot_id, min(relation_type) AS relation_type, min(src_entity_id) AS src_entity_id, min(dst_entity_id) AS dst_entity_id, source_scope, profile_id, metadata FROM relations WHERE l_orderkey % 5 <> 0 GROUP BY relation_id, snapshot_id, source_scope, profile_id, metadata)",
    "o_relation": "o_relation AS (SELECT relation_id, snapshot_id, min(relation_type) AS relation_type, min(src_entity_id) AS src_entity_id, min(dst_entity_id) AS dst_entity_id, source_scope, profile_id, metadata FROM relations WHERE l_orderkey % 5 = 0 OR l_orderkey % 13 = 2 GROUP BY relation_id, snapshot_id, source_scope, profile_id, metadata)",
    "evidences": """evidences AS (SELECT doc_id, concat('v', CAST(doc_id AS VARCHAR(20))) AS evidence_id, snapshot_id, CASE WHEN doc_id % 2 = 0 THEN 'chunk' ELSE 'entity' END AS object_type, CASE WHEN doc_id % 2 = 0 THEN concat('c', CAST(doc_id AS VARCHAR(20))) ELSE concat('e', CAST(doc_id AS VARCHAR(20))) END AS object_id, file_id, CASE WHEN doc_id % 3 = 0 THEN concat('c', CAST(doc_id AS VARCHAR(20))) END AS chunk_id,
 CASE WHEN doc_id % 4 = 1 THEN substring(text, 1, 300) END AS excerpt, relative_path AS citation_label, CASE WHEN doc_id % 6 = 0 THEN CAST(5 AS INT) END AS start_line, CASE WHEN doc_id % 6 = 0 THEN CAST(9 AS INT) END AS end_line, source_scope, profile_id, '{}' AS metadata FROM files)""",
    "b_evidence": "b_evidence AS (SELECT * FROM evidences WHERE doc_id % 7 <> 0)",
    "o_evidence": "o_evidence AS (SELECT * FROM evidences WHERE doc_id % 7 = 0 OR doc_id % 9 = 5)",
    "vectors": """vectors AS (SELECT vec_id, concat('w', CAST(vec_id AS VARCHAR(20))) AS vector_ref_id, 'chunk' AS object_type, concat('c', CAST(vec_id AS VARCHAR(20))) AS object_id, concat('c', CAST(vec_id AS VARCHAR(20))) AS chunk_id, CASE WHEN vec_id % 12 = 5 THEN 'old' ELSE 'm1' END AS embedding_model_version, CASE WHEN vec_id % 10 = 3 THEN 'stale' ELSE content_hash END AS content_hash, source_scope, profile_id, '{}' AS metadata, embedding FROM embeddings JOIN files ON doc_id = vec_id)""",
    "b_vector_ref": "b_vector_ref AS (SELECT vec_id, vector_ref_id, object_type, object_id, chunk_id, embedding_model_version, CASE WHEN vec_id % 15 = 4 THEN 'other' ELSE content_hash END AS content_hash, source_scope, profile_id, metadata FROM vectors WHERE vec_id % 7 <> 0 AND vec_id % 16 <> 9)",
    "o_vector_ref": "o_vector_ref AS (SELECT vec_id, vector_ref_id, object_type, object_id, chunk_id, embedding_model_version, content_hash, source_scope, profile_id, metadata FROM vectors WHERE vec_id % 7 = 0 OR vec_id % 9 = 4)",
    "o_tombstone": """o_tombstone AS (SELECT concat('t1_', CAST(doc_id AS VARCHAR(20))) AS tombstone_id, 'chunk' AS object_type, concat('c', CAST(doc_id AS VARCHAR(20))) AS object_id, CAST(NULL AS VARCHAR(20)) AS baseline_id, 's1' AS snapshot_id, CASE WHEN doc_id % 2 = 0 THEN 'all' ELSE lang END AS profile_id, 'all' AS source_scope, doc_id % 33 <> 3 AS active FROM documents WHERE doc_id % 11 = 3
 UNION ALL SELECT concat('t2_', CAST(doc_id AS VARCHAR(20))), 'file', concat('x', CAST(doc_id AS VARCHAR(20))), concat('f', CAST(doc_id AS VARCHAR(20))), 's1', 'all', CASE WHEN doc_id % 2 = 0 THEN 'all' ELSE source END, true FROM documents WHERE doc_id % 23 = 5
 UNION ALL SELECT concat('t3_', CAST(p_partkey AS VARCHAR(20))), 'entity', concat('e', CAST(p_partkey AS VARCHAR(20))), NULL, CASE WHEN p_partkey % 3 = 0 THEN 's0' ELSE 's1' END, 'all', 'all', true FROM part WHERE p_partkey % 13 = 2
 UNION ALL SELECT concat('t4_', relation_id), 'relation', relation_id, NULL, 's1', 'all', 'all', true FROM relations WHERE l_orderkey % 9 = 1
 UNION ALL SELECT concat('t5_', CAST(doc_id AS VARCHAR(20))), 'evidence', concat('v', CAST(doc_id AS VARCHAR(20))), NULL, 's1', 'all', 'all', true FROM documents WHERE doc_id % 19 = 6
 UNION ALL SELECT concat('t6_', CAST(doc_id AS VARCHAR(20))), 'vector_ref', concat('w', CAST(doc_id AS VARCHAR(20))), NULL, 's1', 'all', 'all', true FROM documents WHERE doc_id % 29 = 8)""",
    "o_replacement": """o_replacement AS (SELECT concat('p1_', CAST(doc_id AS VARCHAR(20))) AS replacement_id, 'chunk' AS object_type, concat('c', CAST(doc_id AS VARCHAR(20))) AS old_object_id, concat('c', CAST(doc_id + 1 AS VARCHAR(20))) AS new_object_id, 's1' AS snapshot_id, 'all' AS profile_id, 'all' AS source_scope, '2026-01-01T00:00:00Z' AS created_at, true AS active FROM documents WHERE doc_id % 17 IN (1, 2)
 UNION ALL SELECT concat('p2_', CAST(doc_id AS VARCHAR(20))), 'chunk', concat('c', CAST(doc_id AS VARCHAR(20))), concat('c', CAST(doc_id + 5 AS VARCHAR(20))), 's1', lang, 'all', '2025-01-01T00:00:00Z', true FROM documents WHERE doc_id % 34 = 1
 UNION ALL SELECT concat('p3_', CAST(p_partkey AS VARCHAR(20))), 'entity', concat('e', CAST(p_partkey AS VARCHAR(20))), concat('e', CAST(p_partkey + 1 AS VARCHAR(20))), 's1', 'all', 'all', CASE WHEN p_partkey % 2 = 0 THEN '2026-02-01T00:00:00Z' END, p_partkey % 38 <> 4 FROM part WHERE p_partkey % 19 IN (4, 5)
 UNION ALL SELECT concat('p4_', CAST(p_partkey AS VARCHAR(20))), 'entity', concat('e', CAST(p_partkey AS VARCHAR(20))), CASE WHEN p_partkey % 31 = 7 THEN concat('e', CAST(p_partkey + 2 AS VARCHAR(20))) ELSE concat('e', CAST(p_partkey - 2 AS VARCHAR(20))) END, 's1', 'all', 'all', '2026-03-01T00:00:00Z', true FROM part WHERE p_partkey % 31 IN (7, 9)
 UNION ALL SELECT concat('p5_', relation_id), 'relation', relation_id, concat('r', CAST(l_orderkey AS VARCHAR(20)), '_1'), 's1', 'all', 'all', NULL, true FROM relations WHERE l_orderkey % 21 = 1 AND l_linenumber = 2)""",
}
NEEDS = {
    "file": ("files",), "chunk": ("files", "chunks"), "entity": ("entities",), "relation": ("relations",), "evidence": ("files", "evidences"), "vector_ref": ("files", "vectors"), "tombstone": ("relations",), "replacement": ("relations",),
}
TABLES = ("file", "chunk", "entity", "relation", "evidence", "vector_ref")
SOURCES = ("documents", "part", "lineitem", "embeddings")


def prelude() -> str:
    """All of the store's CTEs, for the SQL side."""
    return ", ".join(CTES.values())


class _Tables(dict):
    """The CTEs' tables, each planned when it is first asked for."""

    def __init__(self, spark, sf_dir: str, prefix: str):
        self.spark, self.sf_dir, self.prefix = spark, sf_dir, prefix
        # Tables are planned later, when another folder's may have been named: each has views of its own.
        self.mine = f"fixture_{crc32(sf_dir.encode()):08x}"
        for t in SOURCES:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"{self.mine}_{t}")
        self.views = ", ".join(f"{t} AS (SELECT * FROM {self.mine}_{t})" for t in SOURCES)

    def __missing__(self, kind: str):
        name = self.prefix + kind
        if "relations" in NEEDS[kind]:
            self.relations()
        ctes = ", ".join(f"{c} AS (SELECT * FROM {self.mine}_{c})" if c == "relations" else CTES[c] for c in (*NEEDS[kind], name))
        self[kind] = self.spark.sql(f"WITH {self.views}, {ctes} SELECT * FROM {name}")
        return self[kind]

    def relations(self) -> None:
        """Order lines grouped as relations: both layers, tombstones and replacements read them, so they are grouped once."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _RELATIONS:
            _RELATIONS[key] = settled(self.spark.sql(f"WITH {self.views}, {CTES['relations']} SELECT * FROM relations"))
        _RELATIONS[key].createOrReplaceTempView(f"{self.mine}_relations")


_RELATIONS: dict[tuple, DataFrame] = {}
_STORES: dict[tuple, Store] = {}


def store(spark, sf_dir: str, **scope) -> Store:
    """The store under a scope; queries of one session share its views."""
    key = (spark.sparkContext.applicationId, sf_dir, *sorted(scope.items()))
    if key not in _STORES:
        _STORES[key] = _store(spark, sf_dir, **scope)
    return _STORES[key]


def _store(spark, sf_dir: str, **scope) -> Store:
    return Store(_Tables(spark, sf_dir, "b_"), _Tables(spark, sf_dir, "o_"), Scope("s1", **scope))


def vectors(spark, sf_dir: str):
    """Vector rows of both layers."""
    t = _Tables(spark, sf_dir, "b_")
    rows = spark.sql(f"WITH {t.views}, {CTES['files']}, {CTES['vectors']} SELECT * FROM vectors")
    return {"overlay": rows.filter("vec_id % 7 = 0 or vec_id % 9 = 4"), "baseline": rows.filter("vec_id % 7 <> 0")}
