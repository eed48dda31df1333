"""More registered queries: symbols, graph, ranking, incremental, quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import fusion, validation
from ..sources import files
from ..operators import fulltext, graph, indexing, layers, ranking
from .registry import PATHS, n, paths, query, read

# --- graph (G) -------------------------------------------------------------------------------------

EDGES = """e AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'located_in' AS relation_type FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'located_in' FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'belongs_to' FROM nation),
 b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"""


def edges(spark, sf_dir):
    def rows(table, a, key, b, to, kind):
        return read(spark, sf_dir, table).select(F.concat(F.lit(a), key).alias("src"), F.concat(F.lit(b), to).alias("dst"), F.lit(kind).alias("relation_type"))

    return rows("customer", "c", "c_custkey", "n", "c_nationkey", "located_in").union(rows("supplier", "s", "s_suppkey", "n", "s_nationkey", "located_in")).union(rows("nation", "n", "n_nationkey", "r", "n_regionkey", "belongs_to"))


BFS = f"""{EDGES}, h0 AS (SELECT 'r0' AS node, 0 AS depth), h1 AS (SELECT DISTINCT b.dst AS node, 1 AS depth FROM b JOIN h0 ON src = node), h2 AS (SELECT DISTINCT b.dst AS node, 2 AS depth FROM b JOIN h1 ON src = node),
 reached AS (SELECT node, min(depth)::BIGINT AS depth FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY node)"""


@query(f"WITH {BFS} SELECT node, depth FROM reached")
def g1_bfs(spark, sf_dir):
    seeds = spark.createDataFrame([("r0",)], "node string")
    return graph.expand(edges(spark, sf_dir), seeds, 2).select("node", n("depth"))


@query(f"WITH {BFS} SELECT src, dst, relation_type, greatest(x.depth, y.depth) AS depth FROM e JOIN reached x ON src = x.node JOIN reached y ON dst = y.node")
def g2_traversed_edges(spark, sf_dir):
    e = edges(spark, sf_dir)
    return graph.traversed(e, graph.expand(e, spark.createDataFrame([("r0",)], "node string"), 2)).select("src", "dst", "relation_type", n("depth"))


@query("SELECT DISTINCT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst, 'placed_by' AS relation_type FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def g6_q4_orphans(spark, sf_dir):
    e = read(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("src"), F.concat(F.lit("c"), "o_custkey").alias("dst"), F.lit("placed_by").alias("relation_type"))
    nodes = read(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.concat(F.lit("c"), "c_custkey").alias("node")).union(read(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), "l_orderkey")))
    return graph.orphans(e, nodes)


# --- ranking (H) -----------------------------------------------------------------------------------


@query("""WITH r AS (SELECT o_custkey AS id, 'symbol' AS retriever, 0.6 AS w, row_number() OVER (ORDER BY sum(o_totalprice) DESC, o_custkey) AS rank FROM orders GROUP BY o_custkey UNION ALL SELECT c_custkey, 'fts', 0.4, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) FROM customer)
 SELECT id, round(sum(w / (60 + rank)), 6) AS score, count(*) AS lists, min(rank) AS best_rank FROM r GROUP BY id""")
def h1_weighted_rrf(spark, sf_dir):
    a = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(ranking.exact_sum(F.col("o_totalprice")).alias("s")).select("id", "s", F.lit(0.6).alias("w"))
    b = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("s"), F.lit(0.4).alias("w"))
    ranked = ranking.rank_all(a, ["s"], "id").unionByName(ranking.rank_all(b, ["s"], "id"))
    return fulltext.fuse(ranked, ["id"], "w").select("id", "score", "lists", n("best_rank"))


# --- indexing and incremental (I) --------------------------------------------------------------------


@query("""WITH a AS (SELECT doc_id, source, lang FROM documents) SELECT lang, source, CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' WHEN x = y THEN 'unchanged' ELSE 'changed' END AS change
 FROM (SELECT lang, source, min(n_chars) AS x FROM documents WHERE n_chars > 1000 GROUP BY 1, 2) FULL JOIN (SELECT lang, source, min(n_chars) AS y FROM documents WHERE n_chars > 1100 GROUP BY 1, 2) USING (lang, source)""")
def i25_i26_diff(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    old, new = (d.filter(F.col("n_chars") > x).groupBy("lang", "source").agg(F.min("n_chars").alias("digest")) for x in (1000, 1100))
    return layers.diff(old, new, ["lang", "source"], "digest")


@query("SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS eta FROM events")
def i34_sliding_eta(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return read(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.avg("value").over(w), 6).alias("eta"))


@query(f"""WITH {PATHS}, p AS (SELECT unnest(list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS dir, array_to_string(string_split(path, '/')[1:len(string_split(path, '/'))-1], '/') AS own FROM paths)
 SELECT dir, count(*) AS total, count(*) FILTER (WHERE own = dir) AS direct FROM p GROUP BY dir""")
def i35_directory_rollup(spark, sf_dir):
    return indexing.directory_rollup(paths(spark, sf_dir)).select("dir", "total", "direct")


@query("SELECT s_suppkey, array_to_string(list_transform(regexp_extract_all(s_name, '[A-Z]?[a-z]+|[0-9]+'), lambda x: lower(x)), ' ') AS words FROM supplier")
def i38_name_words(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(tx.words_of_name(F.col("s_name")), " ").alias("words"))


# --- quality and evaluation (Q) -------------------------------------------------------------------------


@query(r"""WITH q AS (SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN 'token = t' || conv_id || E'  \t/srv/data/key/x.pem ' || text ELSE text END AS q FROM conversations), s AS (SELECT *, trim(regexp_replace(q, '\s+', ' ', 'g')) AS s FROM q),
 r AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(s, '(?i)\bbearer\s+[A-Za-z0-9._~+/\-=]+', 'Bearer ***REDACTED***', 'g'), '(?i)\b((?:api[_-]?key|password|secret|token)\s*)([:=])\s*[\x27"]?[^\x27"\s,;]+', '\1\2***REDACTED***', 'g'), '\bAKIA[0-9A-Z]{16}\b', '***REDACTED***', 'g') AS r FROM s)
 SELECT conv_id, turn, role, sha256(s) AS query_hash, CASE WHEN s <> '' AND length(s) <= 160 AND length(q) - length(replace(q, chr(10), '')) <= 1 THEN regexp_replace(r, '(^|[^A-Za-z0-9_.-])/([^/\s]+/){2,}[^,\s:]+', '\1[redacted:absolute_path]', 'g')[1:160] END AS preview FROM r""")
def q12_query_hash(spark, sf_dir):
    """Every second turn with a secret and a path before it."""
    said = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("token = t"), "conv_id", F.lit("  \t/srv/data/key/x.pem "), "text")).otherwise(F.col("text"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", said.alias("q"))
    return rows.select("conv_id", "turn", "role", tx.query_hash(F.col("q")).alias("query_hash"), tx.query_preview(F.col("q")).alias("preview"))


@query("SELECT event_type, count(*) AS count, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max, max_by(value, event_id) AS last FROM events GROUP BY 1")
def q13_metrics(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("count"), F.round(F.sum("value"), 4).alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"), F.max_by("value", "event_id").alias("last"))


@query("SELECT event_type, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, round(quantile_cont(value, 0.95), 6) AS p95_linear, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def q15_q17_percentiles(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    p = ranking.percentiles(rows, ["event_type"], "value", (0.5, 0.95))
    at = lambda q, c: F.max(F.when(F.col("q") == q, F.col(c)))
    p = p.groupBy("event_type").agg(at(0.5, "nearest").alias("p50"), at(0.95, "nearest").alias("p95"), F.round(at(0.95, "linear"), 6).alias("p95_linear"))
    return p.join(rows.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean")), "event_type")


@query("""WITH m(quality, least) AS (VALUES (0, 100), (1, 10000)) SELECT quality::BIGINT AS quality, coalesce(n, 0) AS cases, greatest(least - coalesce(n, 0), 0)::BIGINT AS gap FROM m LEFT JOIN (SELECT quality, count(*) AS n FROM labels GROUP BY 1) USING (quality)""")
def q18_coverage_gap(spark, sf_dir):
    least = spark.createDataFrame([(0, 100), (1, 10000)], "quality int, least long")
    got = read(spark, sf_dir, "labels").groupBy("quality").agg(F.count("*").alias("n"))
    cases = F.coalesce("n", F.lit(0).cast("long"))
    return least.join(got, "quality", "left").select(n("quality"), cases.alias("cases"), F.greatest(F.col("least") - cases, F.lit(0).cast("long")).alias("gap"))


@query("""WITH p AS (SELECT *, (l_returnflag = 'A' OR NULLIF(l_returnflag, 'R') = 'Q') AND NOT (l_linestatus = 'F') AS v FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN v THEN 'enabled_by' WHEN NOT v THEN 'disabled_by' ELSE 'unknown_by' END AS relation, CASE WHEN l_linestatus <> 'F' THEN 'enabled_by' ELSE 'unknown_by' END AS either, 'unknown_by' AS odd, 'unknown_by,unknown_by,unknown_by' AS others FROM p""")
def i23_three_valued_conditions(spark, sf_dir):
    """Conditions over macros in three-valued logic: null is unknown."""
    from ..functions.conditions import compile_condition

    macros = {"A": F.col("l_returnflag") == "A", "Q": F.nullif(F.col("l_returnflag"), F.lit("R")) == "Q", "FINISHED": F.col("l_linestatus") == "F"}
    relation = lambda v: F.when(v, "enabled_by").when(~v, "disabled_by").otherwise("unknown_by")
    odd = ("A &&", "A == y", "defined(A) && FINISHED", "A ||| FINISHED")
    rows = read(spark, sf_dir, "lineitem")
    some = {"relation": "(A || Q) && not FINISHED", "either": "not FINISHED || !A", "odd": odd[0]}
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *[relation(compile_condition(t, macros)).alias(c) for c, t in some.items()], F.concat_ws(",", *[relation(compile_condition(t, macros)) for t in odd[1:]]).alias("others"))


# --- fusion and results (H) --------------------------------------------------------------------------------

_AUTHORITY = {"source_doc": 1.0, "api_doc": 0.95, "widget_doc": 0.92, "workspace_code": 0.82, "source_code": 0.80, "workspace_map": 0.68, "derived": 0.40, "synthetic": 0.28, "official": 0.20}
_LEVELS = list(_AUTHORITY)
_CANDIDATES = f"""c AS (SELECT o_orderkey AS id, o_custkey % 7 AS query_id, ['code_exact', 'api_lookup', 'call_trace', 'unknown'][1 + o_orderkey % 4] AS intent, {_LEVELS}[1 + o_orderkey % {len(_LEVELS)}] AS level, CASE o_orderstatus WHEN 'O' THEN 'en' WHEN 'P' THEN 'all' ELSE 'fr' END AS profile, CASE WHEN o_orderkey % 5 > 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS seen_at, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 4 END AS depth, o_totalprice / 1.3e7 AS fused, o_orderkey % 2 = 0 AS sym, o_orderkey % 3 = 1 AS vec, (SELECT max(o_orderdate) FROM orders) AS clock FROM orders)"""


@query(f"""WITH {_CANDIDATES}, f AS (SELECT *, coalesce(1.0 / (depth + 1), 0) AS prox, epoch(clock) - epoch(seen_at::TIMESTAMP) AS age FROM c)
 SELECT query_id, id, round(fused * (1e0 + 0.2e0 * CASE level {' '.join(f"WHEN '{k}' THEN {v}" for k, v in _AUTHORITY.items())} END + 0.15e0 * CASE profile WHEN 'en' THEN 1.0 WHEN 'all' THEN 0.45 ELSE 0 END + 0.15e0 * CASE WHEN age <= 7 * 86400 THEN 1.0 WHEN age <= 30 * 86400 THEN 0.8 WHEN age <= 90 * 86400 THEN 0.55 WHEN age <= 365 * 86400 THEN 0.25 ELSE 0 END + 0.15e0 * prox + 0.05e0 * least(1.0, (1 + sym::INT + vec::INT) / 3e0)
 + (CASE WHEN sym AND intent IN ('code_exact', 'call_trace') THEN 0.1e0 ELSE 0e0 END + CASE WHEN vec AND intent IN ('api_lookup', 'unknown') THEN 0.08e0 ELSE 0e0 END + CASE WHEN intent = 'call_trace' THEN 0.08e0 * prox ELSE 0e0 END)), 6) AS score FROM f""")
def h3_h4_h5_h6_rerank(spark, sf_dir):
    """Authority table, profile match, freshness, proximity, coverage, intent bonus."""
    o = read(spark, sf_dir, "orders")
    clock = F.lit(o.agg(F.max("o_orderdate")).first()[0])
    k = F.col("o_orderkey")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (1 + i).cast("int"))
    one = lambda name, when: F.when(when, F.struct(F.lit(name).alias("retriever")))
    signals = F.filter(F.array(one("fts", F.lit(True)), one("symbol", k % 2 == 0), one("vector", k % 3 == 1)), lambda x: x.isNotNull())
    rows = o.select(k.alias("candidate_id"), (F.col("o_custkey") % 7).alias("query_id"), pick(("code_exact", "api_lookup", "call_trace", "unknown"), k % 4).alias("intent"), pick(_LEVELS, k % len(_LEVELS)).alias("authority_level"), F.when(F.col("o_orderstatus") == "O", "en").when(F.col("o_orderstatus") == "P", "all").otherwise("fr").alias("profile_id"), F.when(k % 5 > 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("freshness_ts"), F.when(k % 3 == 0, k % 4).alias("graph_depth"), F.lit(0.0).alias("graph_proximity"), (F.col("o_totalprice") / 1.3e7).alias("fused"), signals.alias("signals"))
    return fusion.rerank(rows, clock, "en").select("query_id", F.col("candidate_id").alias("id"), "score")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.8 ELSE 0.6 END::DOUBLE AS unasked, CASE c_mktsegment WHEN 'BUILDING' THEN 1.0 ELSE 0.45 END::DOUBLE AS asked, row_number() OVER (PARTITION BY c_nationkey ORDER BY round(abs(c_acctbal) / 1e5, 6) DESC, c_custkey) AS rank FROM customer")
def h4_h7_profile_match_and_noop(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    own = F.when(F.col("c_mktsegment") == "BUILDING", "en").otherwise("all")
    rows = c.select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("candidate_id"), tx.rounded(F.abs("c_acctbal") / 1e5, 6).alias("fused"), own.alias("profile_id"))
    got = fusion.rerank(rows, F.current_timestamp(), mode="none")
    return got.select(F.col("candidate_id").alias("c_custkey"), fusion.profile_match(F.col("profile_id"), F.lit("auto")).alias("unasked"), fusion.profile_match(F.col("profile_id"), F.lit("EN ")).alias("asked"), n("rank"))


@query("""WITH l AS (SELECT l_orderkey % 50 AS query_id, 'c' || l_partkey % 40 AS id, CASE l_linenumber % 3 WHEN 0 THEN 'symbol' WHEN 1 THEN 'fts' ELSE 'vector' END AS retriever, l_linenumber % 3 AS place, CASE l_linenumber % 3 WHEN 0 THEN 0.55 WHEN 1 THEN 0.3 ELSE 0.0 END AS weight, max(l_quantity) AS raw FROM lineitem WHERE l_orderkey % 200 < 50 GROUP BY 1, 2, 3, 4, 5),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id, retriever ORDER BY raw DESC, id) AS rank FROM l)
 SELECT query_id, id AS candidate_id, round(sum(weight / (60 + rank)), 6) AS fused, max(raw) AS raw_score, first(CASE WHEN retriever = 'symbol' THEN 'S' || rank ELSE 'F' END ORDER BY place, rank) AS title, coalesce(first(retriever ORDER BY place) FILTER (WHERE retriever = 'symbol'), 'all') AS profile_id, array_to_string(list_distinct(list(retriever ORDER BY place))[1:0] || list(retriever ORDER BY place), ',') AS reasons FROM r WHERE weight > 0 GROUP BY 1, 2""")
def h1_h2_fusion_merge(spark, sf_dir):
    """Weighted ranks of three lists, one of them without weight; columns merge by their rules."""
    li = read(spark, sf_dir, "lineitem").filter("l_orderkey % 200 < 50")
    m = F.col("l_linenumber") % 3
    name = F.when(m == 0, "symbol").when(m == 1, "fts").otherwise("vector")
    rows = li.groupBy((F.col("l_orderkey") % 50).alias("query_id"), F.concat(F.lit("c"), F.col("l_partkey") % 40).alias("candidate_id"), name.alias("retriever"), m.alias("place"), F.when(m == 0, 0.55).when(m == 1, 0.3).otherwise(0.0).alias("weight")).agg(F.max("l_quantity").alias("raw_score"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "retriever").orderBy(F.desc("raw_score"), "candidate_id")))
    symbol, none = F.col("retriever") == "symbol", F.lit(None).cast("string")
    rows = rows.withColumns({"object_type": F.lit("chunk"), "title": F.when(symbol, F.concat(F.lit("S"), "rank")).otherwise("F"), "relative_path": none, "source_scope": none, "snippet": none, "profile_id": F.when(symbol, "symbol").otherwise("all"), "graph_depth": F.lit(None).cast("int"), "graph_proximity": F.lit(0.0), "authority_level": F.lit("derived"), "freshness_ts": none, "source_index": F.lit("baseline"), "module_names": F.array().cast("array<string>"), "evidence_keys": F.array().cast("array<string>"), "match_reasons": F.array("retriever")})
    return fusion.fuse(rows).select("query_id", "candidate_id", "fused", "raw_score", "title", "profile_id", F.array_join("match_reasons", ",").alias("reasons"))


@query("""WITH p AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'knowledge-sources/api/' || lang || '.md' WHEN 1 THEN 'out/' || source || '/.config' WHEN 2 THEN 'boards/x_defconfig' ELSE source || '/a.c' END AS path, ['file', 'relation', 'layer', 'profile', 'chunk'][1 + (doc_id // 5) % 5] AS kind, CASE WHEN doc_id % 7 = 0 THEN 'official' END AS named FROM documents)
 SELECT doc_id, CASE WHEN doc_id % 5 IN (1, 2) THEN 'config' WHEN doc_id % 5 = 0 THEN 'doc' WHEN kind = 'relation' THEN 'graph' WHEN kind = 'layer' THEN 'workspace' WHEN kind = 'profile' THEN 'profile' ELSE 'code' END AS type, coalesce(named, CASE WHEN doc_id % 5 = 0 THEN 'source_doc' WHEN doc_id % 5 IN (1, 2) THEN 'profile_config' ELSE 'workspace_code' END) AS authority FROM p""")
def h16_evidence_classes(spark, sf_dir):
    d, k = read(spark, sf_dir, "documents"), F.col("doc_id")
    path = F.when(k % 5 == 0, F.concat(F.lit("knowledge-sources/api/"), "lang", F.lit(".md"))).when(k % 5 == 1, F.concat(F.lit("out/"), "source", F.lit("/.config"))).when(k % 5 == 2, "boards/x_defconfig").otherwise(F.concat("source", F.lit("/a.c")))
    kind = F.element_at(F.array(*map(F.lit, ("file", "relation", "layer", "profile", "chunk"))), (1 + F.floor(k / 5) % 5).cast("int"))
    return d.select("doc_id", fusion.evidence_type(path, kind).alias("type"), fusion.authority_level(path, F.when(k % 7 == 0, "official")).alias("authority"))


@query("SELECT event_id, round(least(1.0, 0.85 * (value - floor(value)) + 0.15), 6) AS confidence, CASE WHEN event_id % 11 = 0 THEN 'partial_ready' WHEN event_id % 3 = 0 THEN 'zero_result' WHEN value - floor(value) < 0.5 OR event_id % 5 = 0 THEN 'low_confidence' ELSE 'ok' END AS status, event_type || ' 的相关证据有哪些？' AS suggestion FROM events")
def h17_h20_statuses(spark, sf_dir):
    e, k = read(spark, sf_dir, "events"), F.col("event_id")
    c = F.col("value") - F.floor("value")
    warnings = F.filter(F.array(F.when(k % 11 == 0, "index.partial_ready"), F.when(k % 5 == 0, "router.low_confidence")), lambda x: x.isNotNull())
    return e.select("event_id", fusion.result_confidence(c).alias("confidence"), fusion.result_status((k % 3).cast("int"), c, warnings).alias("status"), fusion.suggestions(F.concat(F.lit(" "), "event_type"))[2].alias("suggestion"))


@query("""WITH v AS (SELECT l_returnflag AS p, 'CONFIG_M' || l_partkey % 60 AS macro, CASE WHEN l_partkey % 60 % 9 = 0 THEN '' ELSE (max(l_linenumber) % 2)::VARCHAR END AS value, avg(l_discount) > 0.05 AS enabled, 'bool' AS value_type FROM lineitem WHERE l_partkey % 7 <> CASE l_returnflag WHEN 'A' THEN 0 ELSE 1 END AND l_orderkey % 40 = 1 GROUP BY 1, 2, l_partkey % 60)
 SELECT coalesce(a.macro, b.macro) AS macro, CASE WHEN a.macro IS NULL THEN 'missing' WHEN a.value <> '' THEN a.value WHEN a.enabled THEN 'y' ELSE 'n' END AS left_value, CASE WHEN b.macro IS NULL THEN 'missing' WHEN b.value <> '' THEN b.value WHEN b.enabled THEN 'y' ELSE 'n' END AS right_value FROM (SELECT * FROM v WHERE p = 'A') a FULL JOIN (SELECT * FROM v WHERE p = 'R') b ON a.macro = b.macro
 WHERE a.macro IS NULL OR b.macro IS NULL OR a.value <> b.value OR a.enabled <> b.enabled ORDER BY 1 LIMIT 12""")
def h18_h19_macro_diff(spark, sf_dir):
    k = F.col("l_partkey") % 60
    li = read(spark, sf_dir, "lineitem").filter((F.col("l_orderkey") % 40 == 1) & (F.col("l_partkey") % 7 != F.when(F.col("l_returnflag") == "A", 0).otherwise(1)))
    v = li.groupBy(F.col("l_returnflag").alias("p"), F.concat(F.lit("CONFIG_M"), k).alias("macro"), k.alias("k")).agg(F.when(F.col("k") % 9 == 0, "").otherwise((F.max("l_linenumber") % 2).cast("string")).alias("value"), (F.avg("l_discount") > 0.05).alias("enabled"), F.lit("bool").alias("value_type"))
    return fusion.macro_diff(v.filter("p = 'A'"), v.filter("p = 'R'"))


@query("SELECT page_id FROM pages WHERE contains(lower(url || ' ' || html), 'example.net') ORDER BY page_id LIMIT 20")
def h21_item_filter(spark, sf_dir):
    return fusion.filter_items(read(spark, sf_dir, "pages"), " Example.NET", "page_id", 20).select("page_id")


# --- configuration, views, metrics (I, Q) ---------------------------------------------------------------------

_VALUES = ("y", "n", "m", '"y"', '""', "0x0", "0X1F", "0", "-12", "bare", "", '"a b"')


@query(f"""WITH l AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '# CONFIG_P' || p_size || ' is not set' ELSE CASE WHEN p_partkey % 3 = 0 THEN 'P' ELSE 'CONFIG_P' END || p_size || '=' || {list(_VALUES)}[1 + p_partkey % {len(_VALUES)}] END AS line FROM part),
 m AS (SELECT p_partkey, CASE WHEN starts_with(line, '#') THEN split_part(line, ' ', 2) ELSE split_part(line, '=', 1) END AS macro, CASE WHEN starts_with(line, '#') THEN 'n' ELSE split_part(line, '=', 2) END AS raw FROM l), last AS (SELECT macro, arg_max(raw, p_partkey) AS raw FROM m GROUP BY 1)
 SELECT macro, CASE WHEN raw LIKE '"%"' THEN raw[2:-2] WHEN lower(raw) LIKE '0x%' THEN lower(raw) ELSE raw END AS value, CASE WHEN raw IN ('y', 'n') THEN 'bool' WHEN raw = 'm' THEN 'tristate' WHEN raw LIKE '"%"' THEN 'string' WHEN lower(raw) LIKE '0x%' THEN 'hex' WHEN regexp_full_match(raw, '-?[0-9]+') THEN 'int' ELSE 'literal' END AS value_type, raw NOT IN ('n', '0x0', '0', '') AS enabled FROM last""")
def i8_i9_config(spark, sf_dir):
    """Lines of every kind; of one macro's the last counts."""
    k = F.col("p_partkey")
    value = F.element_at(F.array(*map(F.lit, _VALUES)), (1 + k % len(_VALUES)).cast("int"))
    line = F.when(k % 4 == 0, F.concat(F.lit("# CONFIG_P"), "p_size", F.lit(" is not set"))).otherwise(F.concat(F.when(k % 3 == 0, "P").otherwise("CONFIG_P"), "p_size", F.lit("="), value))
    return files.effective_config(files.config_assignments(read(spark, sf_dir, "part").select("p_partkey", line.alias("line"))), "p_partkey")


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'packages/services/HeartRate' || p_size || '/x.c' WHEN 1 THEN 'packages/apps/health/' || p_size WHEN 2 THEN 'ui/heartTile/a.c' WHEN 3 THEN 'framework/engine/AudioEngine/e.c' WHEN 4 THEN 'framework/core.c' WHEN 5 THEN 'uiframework/w.c' WHEN 6 THEN 'drivers/' || p_size ELSE 'misc/' || p_brand END AS path FROM part)
 SELECT p_partkey, split_part(path, '/', 1) AS area, ['service', 'app', 'ui', 'engine', 'framework', 'uiframework', 'driver', NULL][1 + p_partkey % 8] AS layer, ['service_package', 'app_package', 'ui_screen_family', 'engine_component', 'framework_root', 'uiframework_component', 'driver_root', 'directory'][1 + p_partkey % 8] AS role, CASE p_partkey % 8 WHEN 0 THEN 'heart_rate_' || split_part(split_part(path, 'Rate', 2), '/', 1) WHEN 3 THEN 'audio' END AS domain, CASE p_partkey % 8 WHEN 1 THEN 'health' WHEN 2 THEN 'heart_tile' END AS feature FROM p""")
def i36_path_classes(spark, sf_dir):
    return _classified(spark, sf_dir).select("p_partkey", "c.area", "c.layer", "c.role", "c.domain", "c.feature")


def _classified(spark, sf_dir):
    k = F.col("p_partkey") % 8
    c = lambda *x: F.concat(*[F.lit(y) if y not in ("p_size", "p_brand") else F.col(y) for y in x])
    path = F.when(k == 0, c("packages/services/HeartRate", "p_size", "/x.c")).when(k == 1, c("packages/apps/health/", "p_size")).when(k == 2, "ui/heartTile/a.c").when(k == 3, "framework/engine/AudioEngine/e.c").when(k == 4, "framework/core.c").when(k == 5, "uiframework/w.c").when(k == 6, c("drivers/", "p_size")).otherwise(c("misc/", "p_brand"))
    return read(spark, sf_dir, "part").select("p_partkey", path.alias("path"), indexing.classify(path).alias("c"))


@query("""SELECT 'layer' AS view, ['service', 'app', 'ui', 'engine', 'framework', 'uiframework', 'driver'][1 + p_partkey % 8] AS item, count(*) AS files FROM part WHERE p_partkey % 8 < 7 GROUP BY 2 UNION ALL SELECT 'domain', CASE p_partkey % 8 WHEN 0 THEN 'heart_rate_' || p_size ELSE 'audio' END, count(*) FROM part WHERE p_partkey % 8 IN (0, 3) GROUP BY 2 UNION ALL SELECT 'feature', CASE p_partkey % 8 WHEN 1 THEN 'health' ELSE 'heart_tile' END, count(*) FROM part WHERE p_partkey % 8 IN (1, 2) GROUP BY 2""")
def i37_views(spark, sf_dir):
    return indexing.views(_classified(spark, sf_dir)).select("view", "item", "files")


@query("""WITH h AS (SELECT user_id, event_id, lower(trim(event_type)) AS text, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM events), f AS (SELECT user_id AS case_id, min(rank) FILTER (WHERE contains(text, 'purch')) AS first FROM h GROUP BY 1),
 m(metric, actual, eligible) AS (SELECT 'mrr', round(coalesce(avg(1.0 / first), 0), 6), count(first) FROM f UNION ALL SELECT 'top_5_recall', round(coalesce(avg((first <= 5)::INT), 0), 6), count(first) FROM f UNION ALL SELECT 'evidence_hit_rate', round(avg((first IS NOT NULL)::INT), 6), count(*) FROM f UNION ALL SELECT 'schema_compliance', 1.0, count(*) FROM f UNION ALL SELECT 'symbol_top_3_recall', round(coalesce(avg((first <= 3)::INT), 0), 6), count(first) FROM f UNION ALL SELECT 'profile_correctness', 0.0, 0 UNION ALL SELECT 'warning_quality', 1.0, count(*) FROM f UNION ALL SELECT 'blocked_security_contract', 1.0, 1)
 SELECT metric, actual::DOUBLE AS actual, eligible, actual >= CASE metric WHEN 'schema_compliance' THEN 1.0 WHEN 'evidence_hit_rate' THEN 0.85 WHEN 'top_5_recall' THEN 0.90 WHEN 'symbol_top_3_recall' THEN 0.95 WHEN 'mrr' THEN 0.75 WHEN 'profile_correctness' THEN 0.90 WHEN 'warning_quality' THEN 0.85 ELSE 1.0 END AS passed FROM m""")
def q14_q19_q20_quality_gate(spark, sf_dir):
    """First relevant ranks, rates over known cases, thresholds."""
    e = read(spark, sf_dir, "events").withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    items = e.select(F.col("user_id").alias("case_id"), "rank", F.col("event_type").alias("text"))
    first = ranking.first_relevant(items, items.select("case_id").distinct().withColumn("locator", F.lit(" Purch")))
    f = F.col("first")
    cases = first.select((1 / f).alias("reciprocal_rank"), (f <= 5).alias("top_5_hit"), (f <= 3).alias("symbol_top_3_hit"), f.isNotNull().alias("evidence_hit"), F.lit(True).alias("schema_compliant"), F.lit(True).alias("warning_quality_ok"), F.lit(None).cast("boolean").alias("profile_correct"))
    return ranking.quality_metrics(cases).select("metric", "actual", "eligible", "passed")


@query("""WITH a AS (SELECT l_shipdate::DATE % 1 AS z FROM lineitem LIMIT 0), b AS (SELECT p_type AS k, round(avg(p_size) FILTER (WHERE p_partkey % 2 = 0) / 50, 6) AS x, round(avg(p_size) FILTER (WHERE p_partkey % 2 = 1) / 50, 6) AS y FROM part GROUP BY 1)
 SELECT k AS category, round(y - x, 6) AS delta, CASE WHEN x IS NULL OR y IS NULL THEN 'category_evidence_available' WHEN round(x - y, 9) > 0.05 THEN 'category_evidence_regression' END AS failure, CASE WHEN x IS NULL OR y IS NULL THEN 'performance_probe_available' WHEN y / x > 1.2 THEN 'performance_regression' END AS slower FROM b""".replace("a AS (SELECT l_shipdate::DATE % 1 AS z FROM lineitem LIMIT 0), ", ""))
def q21_regressions(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    side = lambda k, c: p.filter(F.col("p_partkey") % 2 == k).groupBy(F.col("p_type").alias("category")).agg(F.round(F.avg("p_size") / 50, 6).alias(c))
    rates = ranking.rate_regression(side(0, "rate"), side(1, "rate")).select("category", "delta", "failure")
    speed = ranking.speed_regression(side(0, "p95"), side(1, "p95"), "category").select("category", F.col("failure").alias("slower"))
    return rates.join(speed, "category")


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN NULL WHEN turn % 3 = 1 THEN '3,' || turn + 1 ELSE '1' END AS ints FROM (SELECT * FROM conversations) WHERE turn + 1 <> 3")
def q23_int_lists(spark, sf_dir):
    t = F.col("turn")
    raw = F.when(t % 3 == 0, F.concat(F.lit("1,x"), "turn")).when(t % 3 == 1, F.concat(F.lit("3, "), t + 1, F.lit(" ,3,,"))).otherwise("1,1")
    return read(spark, sf_dir, "conversations").filter("turn + 1 <> 3").select("conv_id", "turn", F.array_join(ranking.positive_ints(raw), ",").alias("ints"))


@query(r"""SELECT doc_id, len(list_filter(['password', 'token'], lambda w: regexp_matches(text, '(?i)\b(api[_-]?key|password|secret|token)\s*[:=]\s*[\x27"]?[^\x27"\s,;]+'))) > 0 AS assigned, regexp_matches(text, '\bAKIA[0-9A-Z]{16}\b') AS access_key FROM documents""")
def q10_secret_scan(spark, sf_dir):
    kinds = tx.secret_kinds(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_contains(kinds, "assignment").alias("assigned"), F.array_contains(kinds, "access_key").alias("access_key"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(t, '\bAKIA[0-9A-Z]{16}\b', '***REDACTED***', 'g'), '(^|[^A-Za-z0-9_.-])/([^/\s]+/){2,}[^,\s:]+', '\1[redacted:absolute_path]', 'g') AS text FROM (SELECT doc_id, regexp_replace(regexp_replace('Bearer abc.def ' || doc_id || ' password = x' || doc_id || ', see /root/a/b/c.txt or a/b/c ' || text[1:100], '(?i)\bbearer\s+[A-Za-z0-9._~+/\-=]+', 'Bearer ***REDACTED***', 'g'), '(?i)\b((?:api[_-]?key|password|secret|token)\s*)([:=])\s*[\x27"]?[^\x27"\s,;]+', '\1\2***REDACTED***', 'g') AS t FROM documents WHERE text IS NOT NULL)""")
def q11_redaction(spark, sf_dir):
    text = F.concat(F.lit("Bearer abc.def "), "doc_id", F.lit(" password = x"), "doc_id", F.lit(", see /root/a/b/c.txt or a/b/c "), F.substring("text", 1, 100))
    return read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", tx.redact(text).alias("text"))


@query("""WITH a AS (SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 10 <> 1), b AS (SELECT doc_id, lang, CASE WHEN doc_id % 10 = 2 THEN 0 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 10 <> 3), j AS (SELECT coalesce(a.doc_id, b.doc_id) AS k, a.doc_id IS NULL AS r, b.doc_id IS NULL AS l, a.n_chars <> b.n_chars AS c FROM a FULL JOIN b ON a.doc_id = b.doc_id)
 SELECT (SELECT count(*) FROM a) AS left_count, (SELECT count(*) FROM b) AS right_count, false AS equal, (SELECT array_to_string(list(k ORDER BY k), ',') FROM (SELECT k FROM j WHERE l ORDER BY k LIMIT 10)) AS left_only, (SELECT array_to_string(list(k ORDER BY k), ',') FROM (SELECT k FROM j WHERE r ORDER BY k LIMIT 10)) AS right_only, (SELECT array_to_string(list(k ORDER BY k), ',') FROM (SELECT k FROM j WHERE c ORDER BY k LIMIT 10)) AS changed""")
def q9_collection_compare(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    b = d.filter("doc_id % 10 <> 3").withColumn("n_chars", F.when(F.col("doc_id") % 10 == 2, F.lit(0).cast("long")).otherwise(F.col("n_chars")))
    got = validation.compare_collections(d.filter("doc_id % 10 <> 1"), b, "doc_id")
    return got.select("left_count", "right_count", "equal", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("left_only", "right_only", "changed")])


@query("""SELECT 'job_lock:' || event_id AS object FROM events WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY AND event_id % 3 = 0""")
def q7_stale_leases(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    clock = F.lit(e.agg(F.max("ts")).first()[0]) - F.expr("interval 1 day")
    locks = e.filter("event_id % 3 = 0").select(F.col("event_id").alias("lock_id"), F.col("ts").cast("string").alias("expires_at"))
    return validation.stale_leases(locks, clock).select("object")


@query("SELECT 'blocked' AS status, 6 + 3 AS issues".replace("6 + 3", "9::BIGINT"))
def q8_versions_and_status(spark, sf_dir):
    """Of 25 nations every fourth store is missing, every eighth plus one is of another version."""
    k = F.col("n_nationkey")
    found = read(spark, sf_dir, "nation").select(F.col("n_name").alias("target"), F.when(k % 4 == 3, None).when(k % 8 == 1, "0").otherwise("1").alias("version"))
    issues = validation.version_issues(found, "1")
    return validation.report_status(issues).select("status", F.col("issues"))


@query("""WITH o AS (SELECT 'o' || p_partkey AS id, p_brand, p_size, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_type END AS t FROM part WHERE p_partkey % 2 = 0), w AS (SELECT CASE WHEN p_partkey % 4 = 2 THEN 'o' ELSE 'w' END || p_partkey AS id, p_brand, p_size, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_type END AS t FROM part WHERE p_partkey % 3 = 0),
 f AS (SELECT p_brand, p_size, t, max(id) AS new_id FROM w GROUP BY 1, 2, 3) SELECT o.id AS old_id, new_id, coalesce(new_id <> o.id, false) AS replaced, o.id NOT IN (SELECT id FROM w) AS gone FROM o LEFT JOIN f ON o.p_brand = f.p_brand AND o.p_size = f.p_size AND o.t IS NOT DISTINCT FROM f.t""")
def i28_object_matching(spark, sf_dir):
    k = F.col("p_partkey")
    p = read(spark, sf_dir, "part").withColumn("t", F.when(k % 9 != 0, F.col("p_type")))
    old = p.filter(k % 2 == 0).withColumn("id", F.concat(F.lit("o"), k))
    new = p.filter(k % 3 == 0).withColumn("id", F.concat(F.when(k % 4 == 2, "o").otherwise("w"), k))
    return indexing.match_objects(old, new, "id", ["p_brand", "p_size", "t"])
