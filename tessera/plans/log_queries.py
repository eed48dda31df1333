"""Registered queries over tables that are written as logs of commits, and over the
stored full-text index, each with SQL that knows nothing of either."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.lineage import fresh
from ..operators.postings import TextIndex
from ..sources.commits import Log
from .registry import n, query, read

_ORDERS = "o_orderkey, o_orderstatus, o_totalprice"


@query(f"""WITH o AS (SELECT {_ORDERS} FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 1 THEN 'U' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 5 = 1 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM o WHERE o_orderkey % 7 <> 3
 UNION ALL SELECT -o_orderkey, o_orderstatus, o_totalprice FROM o WHERE o_orderkey % 11 = 0""")
def b5_b6_b7_segments(spark, sf_dir):
    """Two segments, one of replaced rows, deletions, compaction, and a segment after it."""
    rows, log = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), Log(spark, fresh(spark, "segments"))
    k = F.col("o_orderkey")
    log.append(rows.filter(k % 3 != 0))
    log.append(rows.filter(k % 3 == 0))
    log.upsert(rows.filter(k % 5 == 1).select("o_orderkey", F.lit("U").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice")), ["o_orderkey"])
    log.delete(rows.filter(k % 7 == 3), ["o_orderkey"])
    log.compact(force=True)
    log.append(rows.filter(k % 11 == 0).withColumn("o_orderkey", -k))
    return log.read()


@query("""SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 10 = 1 THEN 2 ELSE 1 END AS revision, CASE o_orderkey % 10 WHEN 1 THEN 'newer' WHEN 3 THEN 'again' ELSE 'first' END AS note FROM orders""")
def b1_i26_bucketed_merge(spark, sf_dir):
    """A newer row replaces the stored one, an older one doesn't, of equals the new one counts."""
    rows, log = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), Log(spark, fresh(spark, "merged"))
    row = lambda r, note: rows.select("*", F.lit(r).cast("long").alias("revision"), F.lit(note).alias("note"))
    k, order = F.col("o_orderkey"), F.col("revision")
    log.merge(row(1, "first"), ["o_orderkey"], order)
    late = row(2, "newer").filter(k % 10 == 1).unionByName(row(0, "older").filter(k % 10 == 2)).unionByName(row(1, "again").filter(k % 10 == 3))
    log.merge(late, ["o_orderkey"], order)
    return log.read()


def _revised(docs):
    return docs.filter("text is not null").select("doc_id", F.when(F.col("doc_id") % 9 == 4, F.concat(F.lit("revised "), "text")).otherwise(F.col("text")).alias("text"))


def stored_index(spark, sf_dir) -> TextIndex:
    """All documents, of which some are then revised and some deleted."""
    docs, index = read(spark, sf_dir, "documents"), TextIndex(spark, fresh(spark, "text-index"), "doc_id")
    index.write(docs.filter("text is not null").select("doc_id", F.array("text").alias("columns")))
    index.write(_revised(docs).filter("doc_id % 9 = 4").select("doc_id", F.array("text").alias("columns")))
    index.delete(docs.filter("doc_id % 13 = 2"))
    return index


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(CASE WHEN doc_id % 9 = 4 THEN 'revised ' || text ELSE text END)), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id % 13 <> 2),
 q AS (SELECT doc_id AS query_id, regexp_extract_all(text, '[a-z]+')[1:3] AS x FROM documents WHERE doc_id % 20 = 0 AND text IS NOT NULL), u AS (SELECT query_id, x[1] || ' ' || x[2] AS unit FROM q WHERE len(x) = 3 UNION ALL SELECT query_id, x[3] FROM q WHERE len(x) = 3),
 st AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM t), p AS (SELECT doc_id, length, term, lead(term) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM (SELECT doc_id, len(w) AS length, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM t)),
 tf AS (SELECT doc_id, length, unit, count(*) AS tf FROM (SELECT doc_id, length, term AS unit FROM p UNION ALL SELECT doc_id, length, term || ' ' || after FROM p WHERE after IS NOT NULL) WHERE unit IN (SELECT unit FROM u) GROUP BY 1, 2, 3),
 df AS (SELECT unit, count(*) AS df FROM tf GROUP BY 1),
 sc AS (SELECT query_id, doc_id, round(-sum(CASE WHEN ln((docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS bm25, count(*) AS hit FROM tf JOIN df USING (unit) JOIN u USING (unit), st GROUP BY 1, 2),
 ranked AS (SELECT query_id, doc_id, bm25, row_number() OVER (PARTITION BY query_id ORDER BY bm25, doc_id) AS rank FROM sc WHERE hit = 2) SELECT * FROM ranked WHERE rank <= 5""")
def f3_b2_b3_stored_index(spark, sf_dir):
    """A phrase and a word of every twentieth document, by the index as it is after its updates."""
    x = F.slice(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0)), 1, 3)
    asked = read(spark, sf_dir, "documents").filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), x.alias("x")).filter("size(x) = 3")
    asked = asked.select("query_id", F.concat(F.col("x")[0], F.lit("_"), F.col("x")[1], F.lit(" "), F.col("x")[2]).alias("query"))
    return stored_index(spark, sf_dir).search(asked, "query_id", "query", 5).select("query_id", "doc_id", "bm25", n("rank"))
