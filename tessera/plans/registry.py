"""The registered queries of the engine's own operators, each with its SQL.

Paths come from page URLs, chunks from documents (lang is the profile, source
the source scope), entities and relations from the order tables; the baseline
layer is what is still open (line status O), the overlay what is finished (F).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import fulltext, layers, ranking, vectors
from ..sources import files, workspace

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def paths(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1).alias("path"))


PATHS = "paths AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS path FROM pages)"


def n(c):
    return F.col(c).cast("long").alias(c)


# --- scans and paths (A) ------------------------------------------------------------------


@query(f"""WITH {PATHS} SELECT page_id, path FROM paths WHERE (list_bool_or(list_transform(string_split(path, '/'), lambda c: c GLOB '*.html')) OR path GLOB '*/en/*' OR path GLOB '*[ab]*/d?/*')
 AND NOT list_bool_or(list_transform(string_split(path, '/'), lambda c: c GLOB 'm.*')) AND NOT starts_with(path || '/', 'blog.example.com/')""")
def a2_a3_glob_filter(spark, sf_dir):
    """``*`` crosses slashes in a pattern that has one; else it names a component."""
    p = paths(spark, sf_dir)
    wanted = tx.matches_any(F.col("path"), ["*.html", "*/en/*", "*[ab]*/d?/*"])
    return p.filter(wanted & ~tx.matches_any(F.col("path"), ["m.*", "blog.example.com/**"]))


_LANGUAGES = {"Kconfig": "kconfig", "Makefile": "makefile", "CMakeLists.txt": "cmake", ".c": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".h": "c-header", ".hpp": "cpp-header", ".hh": "cpp-header", ".py": "python", ".rs": "rust", ".go": "go", ".java": "java", ".js": "javascript", ".ts": "typescript", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".md": "markdown", ".rst": "restructuredtext", ".sh": "shell", ".cmake": "cmake", ".mk": "makefile", ".S": "assembly", ".s": "assembly", ".html": None, "defconfig": None}


@query(f"""WITH m(k, language) AS (VALUES {', '.join(f"('{k}', {repr(v) if v else 'NULL'})" for k, v in _LANGUAGES.items())}), f AS (SELECT page_id, k, CASE WHEN starts_with(k, '.') THEN 'src' || page_id || '/x' || k ELSE 'lib/' || k END AS path, language FROM pages CROSS JOIN m WHERE page_id % 10 = 1)
 SELECT page_id, path, language, split_part(path, '/', 1) AS area FROM f""")
def a4_a5_language_area(spark, sf_dir):
    """Every name and suffix, and two that name no language."""
    names = spark.createDataFrame([(k,) for k in _LANGUAGES], "k string").withColumn("one", F.lit(1))
    p = read(spark, sf_dir, "pages").filter("page_id % 10 = 1").select("page_id", F.lit(1).alias("one")).join(names, "one")
    path = F.when(F.startswith("k", F.lit(".")), F.concat(F.lit("src"), "page_id", F.lit("/x"), "k")).otherwise(F.concat(F.lit("lib/"), "k"))
    return p.select("page_id", path.alias("path")).select("page_id", "path", tx.language_of(F.col("path")).alias("language"), tx.area_of(F.col("path")).alias("area"))


@query(f"WITH {PATHS} SELECT split_part(path, '/', 2) AS area, count(*) AS files, count(DISTINCT split_part(path, '/', 1)) AS hosts, sum(length(path))::BIGINT AS size FROM paths GROUP BY 1")
def a6_area_counts(spark, sf_dir):
    return paths(spark, sf_dir).groupBy(F.split_part("path", F.lit("/"), F.lit(2)).alias("area")).agg(F.count("*").alias("files"), F.countDistinct(F.split_part("path", F.lit("/"), F.lit(1))).alias("hosts"), F.sum(F.length("path")).alias("size"))


@query(f"""WITH {PATHS}, up AS (SELECT page_id, path, unnest(list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS prefix FROM paths),
 repos AS (SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS repo FROM paths UNION SELECT DISTINCT split_part(path, '/', 1) FROM paths)
 SELECT page_id, max(repo) AS repo FROM (SELECT page_id, repo, row_number() OVER (PARTITION BY page_id ORDER BY length(repo) DESC) AS r FROM up JOIN repos ON prefix = repo) WHERE r = 1 GROUP BY page_id""")
def a9_nearest_repository(spark, sf_dir):
    p = paths(spark, sf_dir).withColumnRenamed("path", "relative_path")
    cutp = lambda i: F.split_part("relative_path", F.lit("/"), F.lit(i))
    repos = p.select(F.explode(F.array(F.concat_ws("/", cutp(1), cutp(2)), cutp(1))).alias("relative_path")).distinct()
    return workspace.nearest_repository(p, repos).select("page_id", "repo")


@query("""WITH h AS (SELECT source, md5(doc_id || ':' || md5(coalesce(text, ''))) AS h FROM documents), b AS (SELECT source, substr(h, 1, 3) AS b, md5(string_agg(h, '' ORDER BY h)) AS d FROM h GROUP BY 1, 2)
 SELECT source, sha256(string_agg(d, '' ORDER BY b)) AS inventory FROM b GROUP BY source""")
def a10_inventory_hash(spark, sf_dir):
    return layers.inventory_hash(read(spark, sf_dir, "documents"), ["source"], F.concat_ws(":", "doc_id", F.md5(F.coalesce("text", F.lit("")))))


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'all') AND source IN ('src0', 'all')")
def a13_scoped_scan(spark, sf_dir):
    return read(spark, sf_dir, "documents").filter(layers.in_scope("en", "src0", "lang", "source")).select("doc_id", "lang", "source")


LINES = """base AS (SELECT * FROM lineitem WHERE l_linestatus = 'O'), over AS (SELECT * FROM lineitem WHERE l_linestatus = 'F')"""


def line_layers(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    return rows.filter("l_linestatus = 'F'"), rows.filter("l_linestatus = 'O'")


@query(f"""WITH {LINES}, every AS (SELECT *, 0 AS layer FROM over UNION ALL SELECT *, 1 FROM base),
 first AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY layer, l_orderkey, l_linenumber) AS r FROM every)
 SELECT l_partkey, l_orderkey, l_linenumber, layer::BIGINT AS layer FROM first WHERE r = 1""")
def a14_two_layer_merge(spark, sf_dir):
    over, base = line_layers(spark, sf_dir)
    got = layers.merge([over, base], ["l_partkey"], ["l_orderkey", "l_linenumber"])
    return got.select("l_partkey", "l_orderkey", "l_linenumber", F.col("layer_rank").cast("long").alias("layer"))


@query("""SELECT l_orderkey, l_linenumber, l_linestatus, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_linestatus, l_partkey, l_suppkey) AS r FROM lineitem WHERE l_orderkey = 7) WHERE r = 1""")
def a15_point_lookup(spark, sf_dir):
    over, base = line_layers(spark, sf_dir)
    at = F.col("l_orderkey") == 7
    return layers.merge([over.filter(at), base.filter(at)], ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_linestatus", "l_quantity")


@query("SELECT conv_id, max_by(text, turn) AS text, max(turn) AS turn, count(*) AS versions FROM conversations GROUP BY conv_id")
def a17_last_segment_wins(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    turns = [r[0] for r in rows.select("turn").distinct().orderBy("turn").collect()]  # a turn is a segment
    last = files.segments([rows.filter(F.col("turn") == t) for t in turns], "conv_id")
    return last.join(rows.groupBy("conv_id").agg(F.count("*").alias("versions")), "conv_id").select("conv_id", "text", "turn", "versions")


# --- sinks and maintenance (B) --------------------------------------------------------------


@query("""SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
 UNION ALL SELECT o_custkey, round(sum(o_totalprice), 2), max(o_orderpriority) FROM orders GROUP BY o_custkey""")
def b1_keyed_upsert(spark, sf_dir):
    base = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    new = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("c_acctbal"), F.max("o_orderpriority").alias("c_mktsegment"))
    return layers.upsert(base, new, ["c_custkey"])


@query("""WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
 SELECT 'file' AS object_type, o_orderkey::VARCHAR AS object_id FROM gone UNION SELECT 'chunk', l_orderkey || '/' || l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT * FROM gone)
 UNION SELECT 'relation', l_partkey || '-' || l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT * FROM gone)""")
def b8_b9_cascade_tombstones(spark, sf_dir):
    gone = read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))
    lines = read(spark, sf_dir, "lineitem")
    chunks = lines.select("l_orderkey", F.concat_ws("/", "l_orderkey", "l_linenumber").alias("k"))
    relations = lines.select("l_orderkey", F.concat_ws("-", "l_partkey", "l_suppkey").alias("k"))
    return layers.cascade(gone, [("chunk", chunks, "k", "l_orderkey"), ("relation", relations, "k", "l_orderkey")])


@query("SELECT o_orderkey, 'ts:' || sha1('{\"id\": ' || o_orderkey || ', \"status\": \"' || o_orderstatus || '\"}') AS tombstone_id FROM orders")
def b11_stable_ids(spark, sf_dir):
    body = F.format_string('{"id": %d, "status": "%s"}', "o_orderkey", "o_orderstatus")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("ts:"), F.sha1(body)).alias("tombstone_id"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def b16_retention(spark, sf_dir):
    return layers.newest(read(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey")


# --- logical views (C) ------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def c1_not_tombstoned(spark, sf_dir):
    t = read(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").alias("active"), F.col("o_orderkey").alias("object_id"), F.col("o_custkey").alias("baseline_id"))
    return layers.live(read(spark, sf_dir, "lineitem"), t, "l_orderkey").select("l_orderkey", "l_linenumber")


#: A part is replaced by the next one of its brand and type.
PARTS = "pairs AS (SELECT p_partkey AS old_id, lead(p_partkey) OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS new_id FROM part)"


def part_pairs(spark, sf_dir):
    w = Window.partitionBy("p_brand", "p_type").orderBy("p_partkey")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("old_id"), F.lead("p_partkey").over(w).alias("new_id")).filter("new_id is not null")


@query("SELECT p_partkey AS old_id, max(p_partkey) OVER w AS final_id, count(*) OVER w - 1 AS hops FROM part WINDOW w AS (PARTITION BY p_brand, p_type ORDER BY p_partkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) QUALIFY final_id <> old_id")
def c2_resolve_replacements(spark, sf_dir):
    return layers.resolve(part_pairs(spark, sf_dir)).select("old_id", "final_id", n("hops"))


@query("SELECT o_custkey AS old_id, o_orderkey AS replacement_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def c3_best_replacement(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("old_id"), F.col("o_orderkey").alias("replacement_id"), F.col("o_orderdate").alias("created_at"))
    return layers.best_replacement(rows).select("old_id", "replacement_id")


@query(f"WITH {PATHS}, s AS (SELECT DISTINCT split_part(path, '/', 1) || '/en' AS scope FROM paths) SELECT page_id, scope FROM paths JOIN s ON split_part(path, '/', 1) = split_part(scope, '/', 1) WHERE path = scope OR starts_with(path, scope || '/')")
def c14_path_scope(spark, sf_dir):
    p = paths(spark, sf_dir).withColumn("root", F.split_part("path", F.lit("/"), F.lit(1)))
    s = p.select("root", F.concat("root", F.lit("/en")).alias("scope")).distinct()
    return p.join(s, "root").filter(tx.under(F.col("path"), F.col("scope"))).select("page_id", "scope")


# --- full text (F) ------------------------------------------------------------------------------

BM25 = """t AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+') AS w FROM documents), q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+')) AS term FROM benchmark),
 need AS (SELECT item_id, count(*) AS need FROM q GROUP BY 1), st AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM t),
 tf AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
 sc AS (SELECT item_id, doc_id, round(-sum(CASE WHEN ln((docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS bm25, count(*) AS hit FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY 1, 2),
 ranked AS (SELECT item_id, doc_id, bm25, row_number() OVER (PARTITION BY item_id ORDER BY bm25, doc_id) AS rank FROM sc JOIN need USING (item_id) WHERE hit = need)"""


@query(f"WITH {BM25} SELECT * FROM ranked WHERE rank <= 10")
def f3_bm25_search(spark, sf_dir):
    got = fulltext.search(read(spark, sf_dir, "documents"), "doc_id", "text", read(spark, sf_dir, "benchmark"), "item_id", "text", 10)
    return got.select("item_id", "doc_id", "bm25", n("rank"))


@query("""SELECT conv_id, turn, array_to_string(regexp_extract_all(text, '[A-Za-z0-9_./:-]+'), ' ') AS compiled, len(regexp_extract_all(text, '[A-Za-z0-9_]+'))::BIGINT AS terms FROM conversations""")
def f1_f2_compile_query(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", tx.compile_query(F.col("text")).alias("compiled"), F.size(tx.query_terms(F.col("text"))).cast("long").alias("terms"))


@query("""WITH r AS (SELECT l_partkey, l_linestatus, row_number() OVER (PARTITION BY l_linestatus ORDER BY sum(l_quantity) DESC, l_partkey) AS rank FROM lineitem GROUP BY 1, 2)
 SELECT l_partkey, round(sum(1.0 / (60 + rank)), 6) AS score, count(*) AS lists, min(rank) AS best_rank FROM r GROUP BY 1""")
def f5_cross_store_rrf(spark, sf_dir):
    sums = read(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_linestatus").agg(F.sum("l_quantity").alias("q"))
    ranked = [ranking.rank_all(sums.filter(F.col("l_linestatus") == x), ["q"], "l_partkey") for x in ("F", "O")]
    ranked = ranked[0].unionByName(ranked[1])
    return fulltext.fuse(ranked, ["l_partkey"]).select("l_partkey", "score", "lists", n("best_rank"))


@query("""SELECT doc_id, coalesce(nullif(split_part(text, chr(10), 1), ''), lang, '') AS title, CASE WHEN length(f) > 240 THEN rtrim(substr(f, 1, 237)) || '...' ELSE f END AS excerpt, substr(text, 1, 240) AS snippet FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents)""")
def f13_h15_snippets(spark, sf_dir):
    title = F.coalesce(F.nullif(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit("")), "lang", F.lit(""))
    return read(spark, sf_dir, "documents").select("doc_id", title.alias("title"), tx.excerpt(F.col("text")).alias("excerpt"), F.substring("text", 1, 240).alias("snippet"))


# --- vectors (E) ------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6) AS score
 FROM embeddings e JOIN embeddings q ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id) SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 10""")
def e2_e3_vector_top_k(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.top_k(rows, asked, 10).select("query_id", "vec_id", "score", n("rank"))


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS t FROM documents), h AS (SELECT doc_id, sha256(t) AS h FROM t),
 b AS (SELECT doc_id, ('0x' || h[1:2])::INT AS b0, ('0x' || h[3:4])::INT AS b1, CASE WHEN ('0x' || h[5:6])::INT % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS s, ('0x' || h[7:8])::INT AS b3 FROM h),
 p AS (SELECT doc_id, b0 % 24 AS dim, s * (1 + b3 / 255) AS x FROM b UNION ALL SELECT doc_id, b1 % 24, s * 0.5 FROM b), v AS (SELECT doc_id, dim, sum(x) AS x FROM p GROUP BY 1, 2 HAVING abs(sum(x)) > 1e-9), w AS (SELECT doc_id, dim, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM v)
 SELECT doc_id, dim::BIGINT AS dim, round(x, 4) AS value FROM w UNION ALL SELECT doc_id, 0, 1.0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM v)""")
def e1_hash_embedding(spark, sf_dir):
    return vectors.hash_embedding(read(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", n("dim"), F.round("value", 4).alias("value"))


@query("SELECT text_digest, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, md5(text) AS text_digest FROM documents WHERE NOT regexp_matches(text, '(?i)(password|token|secret|api_key) *[=:]')) GROUP BY 1")
def e9_embedding_inputs(spark, sf_dir):
    """One row of each text to embed: secrets are left out, equal texts go once."""
    safe = read(spark, sf_dir, "documents").filter(~F.col("text").rlike(r"(?i)(password|token|secret|api_key) *[=:]"))
    return safe.groupBy(F.md5("text").alias("text_digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
