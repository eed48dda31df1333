"""Vector retrieval by exact cosine (E)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .fulltext import priority, retrieve
from .lineage import cut
from .store import ALL, Scope, Store, newest_first

#: What a query asks the store for at least, and the indexes it falls back to (fixed values).
LEAST_ASKED, FALLBACK = 24, ("doc_fts", "chunk_fts")
#: Queries and rows of a block.
QUERY_BLOCK, ROW_BLOCK = 1024, 8192
#: Queries and rows that are multiplied at once.
SLICE = 1024
#: Bytes of query vectors that go to every task at once.
BROADCAST = 64 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where sizes differ or a norm is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms)


def _better(held: np.ndarray, held_ids: np.ndarray, score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each query's best scores and their ids, of those held and the new ones (queries x
    rows); of equal scores the smaller ids."""
    n, k = held.shape
    least = held[:, -1]
    if score.shape[1] > k:
        least = np.maximum(least, np.partition(score, -k, axis=1)[:, -k])
    q, at = np.nonzero((score >= least[:, None]) & (score > -np.inf))
    q, s, i = np.r_[np.repeat(np.arange(n), k), q], np.r_[held.ravel(), score[q, at]], np.r_[held_ids.ravel(), ids[at]]
    order = np.lexsort((i, -s, q))
    place = np.arange(len(order)) - np.searchsorted(q[order], np.arange(n))[q[order]]
    order = order[place < k]
    return s[order].reshape(n, k), i[order].reshape(n, k)


def top_k(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", query_key: str = "query_id", same: bool = False) -> DataFrame:
    """(query_id, key, score, rank): each query's best rows, itself left out unless ``same``.

    The query set is stated; it is broadcast once, and must fit in ``BROADCAST``.
    Each task multiplies ``SLICE`` rows with as many queries at a time as matrices, and
    keeps its own k best of each query, so only these are shuffled, and memory
    does not grow with rows times queries.
    """
    held = queries.select(F.col(query_key).cast("long"), F.col("embedding").cast("array<double>")).toPandas()
    if held.shape[0] and sum(len(v) for v in held.iloc[:, 1] if v is not None) * 8 > BROADCAST:
        raise ValueError("split the queries: their vectors are over 64 MB")
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in {len(v) for v in held.iloc[:, 1] if v is not None and len(v)}:
        some = [(i, v) for i, v in held.itertuples(index=False) if v is not None and len(v) == size]
        x = np.array([v for _, v in some], "f8")
        norm = np.sqrt((x * x).sum(1))
        ok = norm > 0
        by_size[size] = (np.array([i for i, _ in some], "i8")[ok], (x[ok] / norm[ok, None]).T.copy())
    sent = rows.sparkSession.sparkContext.broadcast(by_size)

    def run(batches):
        best = {size: (np.full((len(qids), k), -np.inf), np.full((len(qids), k), np.iinfo("i8").max)) for size, (qids, _) in sent.value.items()}
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                if size not in sent.value:
                    continue
                some = np.flatnonzero(sizes == size)
                x = lists.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype("f8")
                norm = np.sqrt((x * x).sum(1))
                ok = norm > 0
                own, (qids, q) = ids[some][ok], sent.value[size]
                for a in range(0, len(qids), SLICE):
                    score = np.round((x[ok] @ q[:, a : a + SLICE]) / norm[ok, None], 6).T
                    score[~np.isfinite(score)] = -np.inf
                    if not same:
                        score[qids[a : a + SLICE, None] == own[None, :]] = -np.inf
                    for held, new in zip(best[size], _better(*(b[a : a + SLICE] for b in best[size]), score, own), strict=True):
                        held[a : a + SLICE] = new
        for size, (s, i) in best.items():
            q, at = np.nonzero(s > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(sent.value[size][0][q]), pa.array(i[q, at]), pa.array(s[q, at])], [query_key, key, "score"])

    found = rows.select(F.col(key).cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, f"{query_key} bigint, {key} bigint, score double")
    w = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hash_embedding(docs: DataFrame, key: str, text: str, dims: int = 24) -> DataFrame:
    """(key, dim, value): feature-hash embedding, L2-normalised, all built-in.

    Every token adds to two dimensions that its SHA-256 chooses; the third byte
    gives the sign, the fourth the size. A text without tokens, or whose parts
    cancel out, is the first unit vector. Words are counted within a text first,
    so a text shuffles its distinct words once.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))
    counted = docs.select(key, F.explode(words).alias("t")).groupBy(key, "t").agg(F.count("*").alias("c"))
    digest = F.sha2("t", 256)
    byte = lambda i: F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int")
    sign = F.when(byte(2) % 2 == 0, 1.0).otherwise(-1.0)
    hashed = counted.select(key, "c", byte(0).alias("b0"), byte(1).alias("b1"), sign.alias("s"), byte(3).alias("b3"))
    x = F.col("c") * F.col("s")
    parts = hashed.select(key, F.explode(F.array(F.struct((F.col("b0") % dims).alias("dim"), (x * (1 + F.col("b3") / 255)).alias("x")), F.struct((F.col("b1") % dims).alias("dim"), (x * 0.5).alias("x")))).alias("p"))
    sums = parts.groupBy(key, F.col("p.dim").alias("dim")).agg(F.sum("p.x").alias("x")).filter(F.abs("x") > 1e-9)
    norm = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    found = sums.join(norm, key).select(key, "dim", (F.col("x") / F.col("norm")).alias("value"))
    first = docs.select(key).distinct().join(norm.select(key), key, "left_anti").select(key, F.lit(0).alias("dim"), F.lit(1.0).alias("value"))
    return found.unionByName(first)


# --- a store of vectors in two layers ------------------------------------------------------


def version_gate(layers: dict[str, DataFrame], expected: str | None) -> DataFrame:
    """(source_index, versions, skipped): a layer without a vector of the expected
    model is skipped with a warning (E5)."""
    out = None
    for name, rows in layers.items():
        seen = F.array_sort(F.collect_set("embedding_model_version"))
        part = rows.agg(seen.alias("versions")).select(F.lit(name).alias("source_index"), "versions")
        out = part if out is None else out.unionByName(part)
    lacks = F.lit(False) if expected is None else ~F.array_contains("versions", expected)
    return out.withColumn("skipped", (F.size("versions") > 0) & lacks)


def live_vectors(store: Store, layers: dict[str, DataFrame], expected: str | None = None, object_types: tuple[str, ...] = ("chunk", "entity", "evidence")) -> DataFrame:
    """Vector rows that a search may return (E3): in scope and of the expected
    model, not gone, not replaced, with a visible reference of the same object and
    content hash, and a visible object whose hash, if it has one, is the same."""
    s = store.scope
    refs = store.vector_refs().select(F.col("vector_ref_id").alias("ref_id"), F.col("object_type").alias("ref_type"), F.col("object_id").alias("ref_object"), F.col("content_hash").alias("ref_hash"))
    of_metadata = F.get_json_object("metadata", "$.content_hash")
    live = store.logical("chunk").select(F.lit("chunk").alias("live_type"), "logical_id", F.col("content_hash").alias("live_hash"), F.col("chunk_id").alias("live_chunk"))
    live = live.unionByName(store.logical("entity").select(F.lit("entity").alias("live_type"), "logical_id", of_metadata.alias("live_hash"), F.lit(None).cast("string").alias("live_chunk")))
    live = live.unionByName(store.evidence().select(F.lit("evidence").alias("live_type"), F.col("evidence_id").alias("logical_id"), of_metadata.alias("live_hash"), F.col("chunk_id").alias("live_chunk")))
    out = None
    for name, rows in layers.items():
        rows = rows.filter(F.col("object_type").isin(*object_types))
        if expected is not None:
            rows = rows.filter(F.col("embedding_model_version") == expected)
        rows = store.in_scope(rows).withColumn("source_index", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    own, snapshot = [F.col("profile_id"), F.col("source_scope")], F.lit(s.snapshot_id)
    out = store.hide(out, F.col("object_type"), F.col("object_id"), snapshot, own)
    out = store.hide(out, "vector_ref", F.col("vector_ref_id"), snapshot, own)
    everything = store if (s.profile_id, s.source_scope) == (ALL, ALL) else Store(store.baseline, store.overlay, Scope(s.snapshot_id))  # chains in each row's own scope
    kept = None
    for kind in object_types:
        part = everything.resolved(out.filter(F.col("object_type") == kind), kind, "object_id", snapshot).filter(~F.col("replaced")).drop("resolved_id", "replaced")
        kept = part if kept is None else kept.unionByName(part)
    same = (F.col("vector_ref_id") == F.col("ref_id")) & (F.col("object_type") == F.col("ref_type")) & (F.col("object_id") == F.col("ref_object")) & (F.col("content_hash") == F.col("ref_hash"))
    kept = kept.join(refs, same, "left_semi")
    kept = kept.join(live, (F.col("object_type") == F.col("live_type")) & (F.col("object_id") == F.col("logical_id")))
    return kept.filter("live_hash is null or live_hash = content_hash").withColumn("chunk_id", F.coalesce("chunk_id", "live_chunk")).drop("live_type", "live_hash", "live_chunk")


def nearest(rows: DataFrame, queries: DataFrame, n: int, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """(query_id, columns of ``rows`` but the vector, score): of each query the ``n`` best
    objects (logical_id), each by its best vector of the highest layer that has one of the
    query's size (E3, E4).

    Both sides are cut into blocks, and each two blocks meet in one task, as matrices;
    a task gives the ``n`` best objects of its block for each of its queries, and the
    best of these are the best of all. Blocks are dealt by hash, so an object of very
    many vectors fills none. Null and zero vectors, and those of another size, are
    near to nothing.
    """
    size = lambda: F.size("embedding")
    fit = F.coalesce((size() > 0) & ~F.exists("embedding", lambda x: x.isNull()) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    top = rows.filter(fit).groupBy("logical_id", size().alias("_size")).agg(F.max(priority()).alias("_top"))
    rows = rows.filter(fit).withColumn("_size", size()).join(top, ["logical_id", "_size"]).filter(priority() == F.col("_top")).drop("_size")
    rows = cut(rows.withColumnRenamed("_top", "_priority").withColumn("embedding", F.col("embedding").cast("array<double>")))
    asked = cut(queries.filter(fit).select("query_id", F.col("embedding").cast("array<double>").alias("embedding")))
    qs, rs = (max(1, -(-df.count() // per)) for df, per in ((asked, query_block), (rows, row_block)))
    every = lambda df, key, own, mine, other, theirs: df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(mine)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(theirs - 1))))
    left, right = every(asked, "query_id", "_q", qs, "_r", rs), every(rows, "vector_ref_id", "_r", rs, "_q", qs)
    carried = [c for c in rows.columns if c not in ("embedding", "_priority")]
    schema = StructType([asked.schema["query_id"], *[rows.schema[c] for c in carried], StructField("score", DoubleType())])

    def meet(some, block):
        out = []
        sizes, held = some["embedding"].map(len), block["embedding"].map(len)
        for width in set(sizes) & set(held):
            q, r = some[sizes == width], block[held == width].sort_values("vector_ref_id")
            unit = [x / np.sqrt((x * x).sum(1, keepdims=True)) for x in (np.stack(q["embedding"].to_list()), np.stack(r["embedding"].to_list()))]
            scores, names, rank = unit[0] @ unit[1].T, r["logical_id"].to_numpy(), r["_priority"].to_numpy()
            for key, own in zip(q["query_id"], scores, strict=True):
                own_round = np.round(own, 6)
                most = 4 * n
                while True:  # an object may have several vectors: on until there are n objects
                    least = np.partition(own_round, -most)[-most] if most < len(own) else -2.0
                    at = np.flatnonzero(own_round >= least)
                    at = at[np.lexsort((names[at], -rank[at], -own_round[at]))]
                    _, first = np.unique(names[at], return_index=True)
                    if len(first) >= n or most >= len(own):
                        break
                    most *= 4
                at = at[np.sort(first)[:n]]
                out.append(r.iloc[at][carried].assign(query_id=key, score=own[at]))
        every = pd.concat(out) if out else block.head(0).assign(query_id=some["query_id"].head(0), score=0.0)
        return every[["query_id", *carried, "score"]]

    best = left.groupBy("_q", "_r").cogroup(right.groupBy("_q", "_r")).applyInPandas(meet, schema)
    best = newest_first(best.withColumn("score", F.round("score", 6)), ["query_id", "logical_id"], priority().desc(), F.desc("score"), F.col("vector_ref_id"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), priority().desc(), "logical_id")
    return best.withColumn("_at", F.row_number().over(w)).filter(F.col("_at") <= n).drop("_at")


def search_vectors(store: Store, layers: dict[str, DataFrame], queries: DataFrame, k: int = 12, expected: str | None = None, object_types: tuple[str, ...] = ("chunk",), domain: str | None = None, doc_type: str | None = None) -> DataFrame:
    """(query_id, logical_id, source_index, score, rank, ...).

    Of an object's vectors the higher layer's counts, then the better score; the
    store is asked for max(4 k, 24), domain and document type are filtered after
    that, so fewer than k may remain. Chunks bring their file's path and a snippet.
    """
    rows = live_vectors(store, layers, expected, object_types)
    pairs = nearest(rows, queries, max(4 * k, LEAST_ASKED))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), priority().desc(), "logical_id")
    pairs = hydrate(store, pairs)
    if domain is not None:
        pairs = pairs.filter(F.col("domain") == domain)
    if doc_type is not None:
        pairs = pairs.filter(F.col("doc_type") == doc_type)
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hydrate(store: Store, matches: DataFrame) -> DataFrame:
    """Adds path, title, snippet, domain and document type by object type."""
    own = lambda c, k: F.get_json_object(c, f"$.{k}")
    files = store.scoped("file").select("file_id", F.col("relative_path").alias("rel_path"))
    flat = lambda c: F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, 240)
    chunk = store.physical("chunk").select(F.lit("chunk").alias("object_type"), F.col("chunk_id").alias("object_id"), "file_id", F.coalesce(own("metadata", "title"), "chunk_type").alias("title"), flat(F.col("text")).alias("snippet"), own("metadata", "domain").alias("domain"), own("metadata", "doc_type").alias("doc_type"))
    entity = store.physical("entity").select(F.lit("entity").alias("object_type"), F.col("entity_id").alias("object_id"), "file_id", F.col("name").alias("title"), flat(F.coalesce(own("metadata", "summary"), "qualified_name")).alias("snippet"), own("metadata", "domain").alias("domain"), own("metadata", "doc_type").alias("doc_type"))
    evidence = store.physical("evidence").select(F.lit("evidence").alias("object_type"), F.col("evidence_id").alias("object_id"), "file_id", F.col("citation_label").alias("title"), flat(F.col("excerpt")).alias("snippet"), own("metadata", "domain").alias("domain"), own("metadata", "doc_type").alias("doc_type"))
    known = chunk.unionByName(entity).unionByName(evidence).join(files, "file_id", "left").drop("file_id")
    return matches.join(known, ["object_type", "object_id"], "left")


def search_or_fall_back(store: Store, layers: dict[str, DataFrame], queries: DataFrame, k: int = 12, expected: str | None = None, embedded: bool = True, **how) -> tuple[DataFrame, str, list[str]]:
    """Matches, mode and warnings (E7): without query vectors, or if nothing is
    found because a layer holds another model's vectors, full text answers."""
    warnings = [] if embedded else ["embedding.provider_unavailable"]
    if embedded:
        gate = version_gate(layers, expected).collect()
        skipped = sum(r["skipped"] for r in gate)
        # Without a vector of the model in any layer nothing can be found, and nothing is searched.
        if not skipped or any(expected in r["versions"] for r in gate):
            found = search_vectors(store, layers, queries, k, expected, **how)
            if not skipped or found.limit(1).count():
                return found, "vector", ["embedding.version_mismatch"] * bool(skipped)
        warnings.append("embedding.version_mismatch")
    filters = {c: v for c, v in how.items() if c in ("domain", "doc_type")}
    return retrieve(store, queries, k, FALLBACK, **filters), "fts_fallback", [*warnings, "retrieval.vector_fallback"]
