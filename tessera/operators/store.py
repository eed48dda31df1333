"""Logical views over a baseline and an overlay.

A store is two dictionaries of DataFrames (file, chunk, entity, relation,
evidence, vector_ref; the overlay also holds tombstone and replacement) seen
through a scope. Views are joins: tombstones are anti-joined by id with the
scope as a further condition, replacement chains are followed once for each
scope that rows have, and what is visible is a union of both layers. Nothing is
looked up row by row, and nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property, wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import layers
from .lineage import settled

KEYS = {"file": "file_id", "chunk": "chunk_id", "entity": "entity_id", "relation": "relation_id", "evidence": "evidence_id", "vector_ref": "vector_ref_id", "tombstone": "tombstone_id", "replacement": "replacement_id"}
ALL = "all"
#: Columns that views leave out: they would move with their rows through every join. ``with_texts`` adds them.
LONG = ("text",)


@dataclass(frozen=True)
class Scope:
    """What a query sees; ``all`` filters nothing, and rows of ``all`` are seen by every scope."""

    snapshot_id: str = "current"
    profile_id: str = ALL
    source_scope: str = ALL
    path_scope: str | None = None


def json_text(value: Column) -> Column:
    """A JSON string, or null, as a sorted-key dump writes it (ASCII text)."""
    return F.coalesce(F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), '"', '\\\\"'), F.lit('"')), F.lit("null"))


def stable_id(prefix: str, **fields: Column) -> Column:
    """``prefix:`` and the SHA-1 of the fields as sorted JSON."""
    parts = [x for k, name in enumerate(sorted(fields)) for x in (F.lit(("{" if not k else ", ") + f'"{name}": '), json_text(fields[name]))]
    return F.concat(F.lit(prefix + ":"), F.sha1(F.concat(*parts, F.lit("}"))))


def newest_first(rows: DataFrame, by: list[str], *order: Column) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_n")


def _once(view):
    """A view is worked out once a store and kept in the shared folder: others build on it."""

    @wraps(view)
    def kept(self: Store, *kind: str) -> DataFrame:
        key = (view.__name__, *kind)
        if key not in self._views:
            self._views[key] = settled(view(self, *kind))
        return self._views[key]

    return kept


class Store:
    def __init__(self, baseline: dict[str, DataFrame], overlay: dict[str, DataFrame], scope: Scope = Scope()):
        self.baseline, self.overlay, self.scope = baseline, overlay, scope
        self._chains: dict[str, DataFrame] = {}
        self._views: dict[tuple[str, ...], DataFrame] = {}

    def within(self, **changes) -> Store:
        """The same tables under another scope; tombstones and chains are known already."""
        out = Store(self.baseline, self.overlay, replace(self.scope, **changes))
        out._chains = self._chains
        out.__dict__ |= {name: self.__dict__[name] for name in ("_gone", "_named") if name in self.__dict__}
        return out

    # -- rows ------------------------------------------------------------------

    def effective(self) -> list[Column]:
        """A row's scope: what the query asks for, or the row's own (C4)."""
        s = self.scope
        return [
            (F.lit(s.profile_id) if s.profile_id != ALL else F.col("profile_id")).alias("_profile"),
            (F.lit(s.source_scope) if s.source_scope != ALL else F.col("source_scope")).alias("_source"),
        ]

    def in_scope(self, rows: DataFrame) -> DataFrame:
        s = self.scope
        if "snapshot_id" in rows.columns:
            rows = rows.filter(F.col("snapshot_id") == s.snapshot_id)
        return rows.filter(layers.in_scope(s.profile_id, s.source_scope))

    def physical(self, table: str) -> DataFrame:
        """Every row of both layers, the overlay's first by key, whatever its scope."""
        key = KEYS[table]
        over = self.overlay[table].withColumn("layer", F.lit("overlay"))
        base = self.baseline[table].withColumn("layer", F.lit("baseline"))
        return over.unionByName(base.join(over.select(key), key, "left_anti"))

    def scoped(self, table: str) -> DataFrame:
        """Rows in scope of both layers, the overlay's first by key."""
        key = KEYS[table]
        over = self.in_scope(self.overlay[table]).withColumn("layer", F.lit("overlay"))
        base = self.in_scope(self.baseline[table]).withColumn("layer", F.lit("baseline"))
        return over.unionByName(base.join(over.select(key), key, "left_anti"))

    # -- tombstones --------------------------------------------------------------

    @cached_property
    def _gone(self) -> DataFrame:
        """(type, snapshot, scope, id) that active tombstones name; worked out once, as every view asks for it."""
        t = self.overlay["tombstone"].filter("active")
        ids = F.array_distinct(F.filter(F.array("object_id", "baseline_id"), lambda x: x.isNotNull()))
        return settled(t.select(F.col("object_type").alias("_t_type"), F.col("snapshot_id").alias("_t_snapshot"), F.col("profile_id").alias("_t_profile"), F.col("source_scope").alias("_t_source"), F.explode(ids).alias("_t_id")).distinct())

    def hide(self, rows: DataFrame, kind: Column | str, key: Column, snapshot: Column | None = None, scope: list[Column] | None = None) -> DataFrame:
        """Rows whose object ``kind``, ``key`` no active tombstone names in the row's scope."""
        profile, source = scope or self.effective()
        kind = F.lit(kind) if isinstance(kind, str) else kind
        t = self._gone
        named = (t["_t_type"] == kind) & (t["_t_id"] == key) & (t["_t_snapshot"] == (F.col("snapshot_id") if snapshot is None else snapshot))
        return rows.join(t, named & t["_t_profile"].isin(profile, F.lit(ALL)) & t["_t_source"].isin(source, F.lit(ALL)), "left_anti")

    def visible(self, rows: DataFrame, kind: str) -> DataFrame:
        """Chunks or entities neither they nor whose file is gone."""
        return self.hide(self.hide(rows, kind, F.col(KEYS[kind])), "file", F.col("file_id"))

    # -- replacements ------------------------------------------------------------

    def resolved(self, rows: DataFrame, kind: str, key: str, snapshot: Column | None = None) -> DataFrame:
        """Adds ``resolved_id`` and ``replaced``: the end of the replacement chain of
        ``key`` in each row's scope (C2, C3). Chains are followed once for each
        scope, by pointer jumping."""
        ends = self._ends(kind).withColumnRenamed("_id", key)
        at = {"_snapshot": F.col("snapshot_id") if snapshot is None else snapshot, "_profile": self.effective()[0], "_source": self.effective()[1]}
        out = rows.withColumns(at)
        # A scope that no replacement names is like any other such scope.
        for c in ("_profile", "_source"):
            named = self._named[c].withColumnRenamed("_name", c).withColumn("_known", F.lit(True))
            out = out.join(named, c, "left").withColumn(c, F.when(F.col("_known"), F.col(c)).otherwise("")).drop("_known")
        out = out.join(ends, ["_snapshot", "_profile", "_source", key], "left")
        return out.withColumn("resolved_id", F.coalesce("_final", key)).withColumn("replaced", F.col("_final").isNotNull()).drop("_final", "_snapshot", "_profile", "_source")

    @cached_property
    def _named(self) -> dict[str, DataFrame]:
        """Profiles and sources that some replacement is limited to."""
        asked = self.overlay["replacement"].filter("active")
        return {name: settled(asked.filter(F.col(c) != ALL).select(F.col(c).alias("_name")).distinct()) for name, c in (("_profile", "profile_id"), ("_source", "source_scope"))}

    def _ends(self, kind: str) -> DataFrame:
        """(_snapshot, _profile, _source, _id, _final): the end of every chain, for
        each scope that replacements name and for all others together; worked out once."""
        if kind in self._chains:
            return self._chains[kind]
        asked = self.overlay["replacement"].filter((F.col("object_type") == kind) & F.col("active"))
        known = asked
        for name, c in (("_profile", "profile_id"), ("_source", "source_scope")):
            names = self._named[name].select(F.col("_name").alias(name))
            every = names.union(names.sparkSession.range(0, 1, 1, 1).select(F.lit("").alias(name)))
            # Rows of all hold in every scope, others in their own. The few names go to the rows: an
            # inner join would be planned as a product of both sides' partitions.
            wide = known.filter(F.col(c) == ALL).crossJoin(F.broadcast(every))
            known = wide.unionByName(known.filter(F.col(c) != ALL).withColumn(name, F.col(c)))
        exact = [F.desc(F.col("profile_id") == F.col("_profile")), F.desc(F.col("source_scope") == F.col("_source"))]
        best = newest_first(known, ["snapshot_id", "_profile", "_source", "old_object_id"], *exact, F.desc_nulls_last("created_at"), F.desc("replacement_id"))
        place = lambda c: F.struct(F.col("snapshot_id"), F.col("_profile"), F.col("_source"), F.col(c).alias("id"))
        ends = layers.resolve(settled(best.select(place("old_object_id").alias("old_id"), place("new_object_id").alias("new_id"))))
        ends = ends.filter("hops > 0").select(F.col("old_id.snapshot_id").alias("_snapshot"), F.col("old_id._profile").alias("_profile"), F.col("old_id._source").alias("_source"), F.col("old_id.id").alias("_id"), F.col("final_id.id").alias("_final"))
        self._chains[kind] = settled(ends)
        return self._chains[kind]

    # -- views ---------------------------------------------------------------------

    def paths(self) -> DataFrame:
        return self.physical("file").select("file_id", "relative_path")

    @_once
    def existing(self, kind: str) -> DataFrame:
        """Ids of chunks or entities that are in scope, not gone and under the path scope (C11)."""
        rows = self.visible(self.in_scope(self.physical(kind)), kind)
        if self.scope.path_scope is not None:
            under = self.paths().filter(tx.under(F.trim(F.col("relative_path"), F.lit("/")), self.scope.path_scope.strip("/")))
            rows = rows.join(under, "file_id", "left_semi")
        return rows.select(F.col(KEYS[kind]).alias("existing_id")).distinct()

    @_once
    def logical(self, kind: str) -> DataFrame:
        """Chunks or entities as a query sees them (C5, C6): ``logical_id`` and
        ``source_index`` (overlay, baseline, merged) before the physical columns but ``LONG``."""
        key = KEYS[kind]
        over = self.visible(self.in_scope(self.overlay[kind].drop(*LONG)), kind)
        over = over.select(F.col(key).alias("logical_id"), F.lit("overlay").alias("source_index"), "*")
        base = self.resolved(self.in_scope(self.baseline[kind].drop(*LONG)), kind, key)
        moved = base.filter("replaced").join(self.existing(kind), F.col("resolved_id") == F.col("existing_id"), "left_semi")
        own = self.visible(base.filter(~F.col("replaced")), kind)
        base = moved.unionByName(own).withColumn("source_index", F.when(F.col("replaced"), "merged").otherwise("baseline"))
        base = base.join(over.select(F.col("logical_id").alias("resolved_id")), "resolved_id", "left_anti")
        base = newest_first(base, ["resolved_id"], F.col(key))
        return over.unionByName(base.select(F.col("resolved_id").alias("logical_id"), "source_index", *over.columns[2:]))

    def with_texts(self, rows: DataFrame, kind: str) -> DataFrame:
        """Adds the ``LONG`` columns of each row's own layer to rows of ``logical``."""
        key, own = KEYS[kind], F.when(F.col("source_index") == "overlay", "overlay").otherwise("baseline")
        held = [t[kind].select(key, F.lit(name).alias("_layer"), *[c for c in LONG if c in t[kind].columns]) for name, t in (("overlay", self.overlay), ("baseline", self.baseline))]
        return rows.withColumn("_layer", own).join(held[0].unionByName(held[1]), [key, "_layer"]).drop("_layer")

    @_once
    def relations(self) -> DataFrame:
        """Relations with redirected, living endpoints."""
        live = self.existing("entity")
        fresh = settled(self.visible(self.in_scope(self.overlay["entity"]), "entity").select(F.col("entity_id").alias("fresh_id")))
        known = self.hide(self.in_scope(self.physical("relation")), "relation", F.col("relation_id")).select(F.col("relation_id").alias("_known"))

        def seen(rows: DataFrame) -> DataFrame:
            rows = self.hide(self.in_scope(rows), "relation", F.col("relation_id"))
            rows = self.resolved(rows, "relation", "relation_id")
            gone = rows.filter("replaced").join(known, F.col("resolved_id") == F.col("_known"), "left_semi").select("relation_id")
            rows = rows.drop("resolved_id", "replaced").join(gone, "relation_id", "left_anti").withColumn("moved", F.lit(False))
            for end in ("src_entity_id", "dst_entity_id"):
                rows = self.resolved(rows, "entity", end).join(live, F.col("resolved_id") == F.col("existing_id"), "left_semi")
                rows = rows.withColumn(end, F.col("resolved_id")).withColumn("moved", F.col("moved") | F.col("replaced")).drop("resolved_id", "replaced")
            return rows

        over = settled(seen(self.overlay["relation"])).withColumn("source_index", F.when(F.col("moved"), "merged").otherwise("overlay"))
        base = seen(self.baseline["relation"]).join(over.select("relation_id"), "relation_id", "left_anti")
        for end in ("src_entity_id", "dst_entity_id"):
            base = base.join(fresh.withColumnRenamed("fresh_id", f"_{end}"), F.col(end) == F.col(f"_{end}"), "left")
        touched = F.col("moved") | F.col("_src_entity_id").isNotNull() | F.col("_dst_entity_id").isNotNull()
        base = base.withColumn("source_index", F.when(touched, "merged").otherwise("baseline")).drop("_src_entity_id", "_dst_entity_id")
        return over.unionByName(base).drop("moved")

    def orphan_relations(self) -> DataFrame:
        """Relations of which an endpoint is no live entity."""
        live = self.logical("entity").select(F.col("logical_id").alias("_live"))
        known = self.hide(self.in_scope(self.physical("relation")), "relation", F.col("relation_id")).select(F.col("relation_id").alias("_known"))

        def bad(rows: DataFrame) -> DataFrame:
            rows = self.hide(self.in_scope(rows), "relation", F.col("relation_id"))
            rows = self.resolved(rows, "relation", "relation_id")
            gone = rows.filter("replaced").join(known, F.col("resolved_id") == F.col("_known"), "left_semi").select("relation_id")
            rows = rows.drop("resolved_id", "replaced").join(gone, "relation_id", "left_anti")
            for end, name in (("src_entity_id", "src"), ("dst_entity_id", "dst")):
                rows = self.resolved(rows, "entity", end).join(live, F.col("resolved_id") == F.col("_live"), "left")
                rows = rows.withColumn(f"missing_{name}", F.col("_live").isNull()).drop("_live", "resolved_id", "replaced")
            return rows

        over = bad(self.overlay["relation"])
        base = bad(self.baseline["relation"]).join(over.select("relation_id"), "relation_id", "left_anti")
        rows = over.withColumn("source_index", F.lit("overlay")).unionByName(base.withColumn("source_index", F.lit("baseline")))
        return rows.filter("missing_src or missing_dst").select("relation_id", "source_index", "missing_src", "missing_dst")

    @_once
    def evidence(self) -> DataFrame:
        """Evidence with redirected objects (C8), less what its own, its file's, its
        chunk's or its object's tombstone hides (C9)."""

        def seen(rows: DataFrame, layer: str) -> DataFrame:
            rows = self.in_scope(rows)
            rows = self.hide(self.hide(rows, "evidence", F.col("evidence_id")), "file", F.col("file_id"))
            rows = self.hide(rows, "chunk", F.col("chunk_id"))
            rows = settled(self.hide(rows, F.col("object_type"), F.when(F.col("object_type").isin("chunk", "entity", "relation"), F.col("object_id"))))
            parts = []
            for kind in ("chunk", "entity"):
                some = self.resolved(rows.filter(F.col("object_type") == kind), kind, "object_id")
                some = some.join(self.existing(kind), F.col("resolved_id") == F.col("existing_id"), "left").filter("not replaced or existing_id is not null").drop("existing_id")
                some = some.withColumn("chunk_id", F.when(F.col("replaced") & (F.col("chunk_id") == F.col("object_id")), F.col("resolved_id")).otherwise(F.col("chunk_id")))
                parts.append(some)
            rest = rows.filter(~F.col("object_type").isin("chunk", "entity"))
            kinds = F.col("object_type") == "relation"
            rest = self.resolved(rest.filter(kinds), "relation", "object_id").unionByName(rest.filter(~kinds).withColumn("resolved_id", F.col("object_id")).withColumn("replaced", F.lit(False))).filter("not replaced")
            out = parts[0].unionByName(parts[1]).unionByName(rest)
            return out.withColumn("source_index", F.when(F.col("replaced"), "merged").otherwise(layer)).withColumn("object_id", F.col("resolved_id")).drop("resolved_id", "replaced")

        over = seen(self.overlay["evidence"], "overlay")
        return over.unionByName(seen(self.baseline["evidence"], "baseline").join(over.select("evidence_id"), "evidence_id", "left_anti"))

    @_once
    def vector_refs(self) -> DataFrame:
        """References to vectors of objects that are visible."""
        snapshot = F.lit(self.scope.snapshot_id)
        refs = self.hide(self.in_scope(self.physical("vector_ref")), "vector_ref", F.col("vector_ref_id"), snapshot)
        evidence = self.in_scope(self.physical("evidence"))
        if self.scope.path_scope is not None:
            evidence = evidence.join(self.paths().filter(tx.under(F.trim(F.col("relative_path"), F.lit("/")), self.scope.path_scope.strip("/"))), "file_id", "left_semi")
        known = self.existing("chunk").withColumn("_kind", F.lit("chunk")).unionByName(self.existing("entity").withColumn("_kind", F.lit("entity")))
        known = known.unionByName(evidence.select(F.col("evidence_id").alias("existing_id"), F.lit("evidence").alias("_kind")))
        return refs.join(known, (F.col("object_type") == F.col("_kind")) & (F.col("object_id") == F.col("existing_id")), "left_semi")

    def overlay_live(self, kind: str) -> DataFrame:
        """Ids of overlay rows that suppress the baseline's hits (C13). A scope of
        ``all`` is taken literally here, so that only rows of ``all`` count then."""
        s = self.scope
        rows = self.overlay[kind].filter((F.col("snapshot_id") == s.snapshot_id) & F.col("profile_id").isin(s.profile_id, ALL) & F.col("source_scope").isin(s.source_scope, ALL))
        rows = self.hide(rows, kind, F.col(KEYS[kind]), F.lit(s.snapshot_id), [F.lit(s.profile_id), F.lit(s.source_scope)])
        return rows.select(F.col(KEYS[kind]).alias("live_id")).distinct()

    # -- changes -------------------------------------------------------------------

    def file_tombstones(self, files: DataFrame, reason: str) -> DataFrame:
        """Tombstones of ``files`` (file_id) and of all that hangs on them, in both
        layers: chunks, entities, evidence, relations of those entities at either
        end, vectors of those objects (B8)."""
        return self._cascade(files, reason, "file_id", ("file", "chunk", "entity", "evidence"))

    def chunk_tombstones(self, chunks: DataFrame, reason: str) -> DataFrame:
        """Tombstones of ``chunks`` (chunk_id), their evidence and vectors."""
        return self._cascade(chunks, reason, "chunk_id", ("chunk", "evidence"))

    def _cascade(self, roots: DataFrame, reason: str, key: str, tables: tuple[str, ...]) -> DataFrame:
        roots = roots.select(key).distinct()
        profile, source = self.effective()
        s, rows, named = self.scope, [], []
        snapshot = F.lit(s.snapshot_id)

        def add(kind: str, hit: DataFrame, layer: str) -> None:
            at = F.col("snapshot_id") if "snapshot_id" in hit.columns else snapshot
            object_id = F.col(KEYS[kind]).cast("string")
            baseline_id = object_id if layer == "baseline" else F.lit(None).cast("string")
            row = hit.select(F.lit(kind).alias("object_type"), object_id.alias("object_id"), baseline_id.alias("baseline_id"), at.alias("snapshot_id"), profile.alias("profile_id"), source.alias("source_scope"))
            rows.append(row)

        # Objects named by one layer also reach what hangs on them in the layers after it: baseline comes first.
        for layer, held in (("baseline", self.baseline), ("overlay", self.overlay)):
            for kind in tables:
                table = self.in_scope(held[kind])
                hit = table.join(roots, key, "left_semi")
                if kind == "evidence" and key == "chunk_id":
                    objects = table.filter("object_type = 'chunk'").join(roots, F.col("object_id") == roots["chunk_id"], "left_semi")
                    hit = hit.unionByName(objects).dropDuplicates([KEYS[kind]])
                add(kind, hit, layer)
                if kind != "file":
                    named.append(hit.select(F.lit(kind).alias("_kind"), F.col(KEYS[kind]).alias("_id")))
            so_far = named[0]
            for x in named[1:]:
                so_far = so_far.unionByName(x)
            so_far = so_far.distinct()
            if key == "file_id":
                entities = so_far.filter("_kind = 'entity'").select("_id")
                table = self.in_scope(held["relation"])
                ends = table.select("relation_id", F.explode(F.array("src_entity_id", "dst_entity_id")).alias("_id")).join(entities, "_id", "left_semi").select("relation_id")
                add("relation", table.join(ends, "relation_id", "left_semi"), layer)
            refs = self.in_scope(held["vector_ref"])
            add("vector_ref", refs.join(so_far, (F.col("object_type") == F.col("_kind")) & (F.col("object_id") == F.col("_id")), "left_semi"), layer)
        out = rows[0]
        for x in rows[1:]:
            out = out.unionByName(x)
        out = out.withColumn("reason", F.lit(reason))
        ids = stable_id("ts", **{c: F.col(c) for c in ("baseline_id", "object_id", "object_type", "profile_id", "reason", "snapshot_id", "source_scope")})
        return out.withColumn("tombstone_id", ids).withColumn("active", F.lit(True)).dropDuplicates(["tombstone_id"])

    # -- full-text rows ------------------------------------------------------------

    def index_rows(self, layer: str) -> DataFrame:
        """Rows of the four full-text indexes (B2, B3, F6-F8): a chunk goes to
        chunk_fts, to doc_fts if it is a document's and to code_fts if it is code;
        ``columns`` holds the indexed texts, ``title`` and ``snippet`` what is shown."""
        held = self.baseline if layer == "baseline" else self.overlay
        files = held["file"].select("file_id", F.col("relative_path").alias("rel_path"), "language", F.col("metadata").alias("file_metadata"))
        own, of_file = F.col("metadata"), F.col("file_metadata")
        text = lambda m, k: tx.metadata_text(m, k)
        chunks = held["chunk"].join(files, "file_id", "left")
        domain, doc_type = F.coalesce(text(own, "domain"), text(of_file, "domain")), F.coalesce(text(own, "doc_type"), text(of_file, "doc_type"))
        title = F.coalesce(text(own, "title"), text(of_file, "title"), "rel_path", "chunk_type")
        symbols = F.coalesce(*[F.nullif(tx.metadata_joined(own, k), F.lit("")) for k in ("symbols", "symbol_names", "code_symbols")])
        is_doc = text(own, "doc_type").isNotNull() | F.startswith("chunk_type", F.lit("doc")) | F.coalesce(F.lower("language").isin(*tx.DOC_LANGUAGES), F.lit(False))
        # A list of symbol names routes to code even if it is empty.
        is_code = F.startswith("chunk_type", F.lit("code")) | tx.metadata_joined(own, "symbol_names").isNotNull() | text(own, "code_text").isNotNull() | F.coalesce(F.lower("language").isin(*tx.CODE_LANGUAGES), F.lit(False))
        code_text = F.coalesce(text(own, "code_text"), "text")
        scope = ["file_id", "snapshot_id", "profile_id", "source_scope", "rel_path"]
        shown = lambda c: F.substring(c, 1, 240).alias("snippet")
        parts = [
            chunks.select(F.lit("chunk_fts").alias("index_name"), F.col("chunk_id").alias("object_id"), F.lit("chunk").alias("object_type"), *scope, domain.alias("domain"), doc_type.alias("doc_type"), title.alias("title"), shown(F.col("text")), F.array(title, "text", symbols, tx.metadata_joined(own, "tags")).alias("columns")),
            chunks.filter(is_doc).select(F.lit("doc_fts").alias("index_name"), F.col("chunk_id").alias("object_id"), F.lit("chunk").alias("object_type"), *scope, domain.alias("domain"), F.coalesce(doc_type, F.lit("doc")).alias("doc_type"), title.alias("title"), shown(F.col("text")), F.array(title, "text").alias("columns")),
            chunks.filter(is_code).select(F.lit("code_fts").alias("index_name"), F.col("chunk_id").alias("object_id"), F.lit("chunk").alias("object_type"), *scope, domain.alias("domain"), doc_type.alias("doc_type"), F.coalesce(symbols, "rel_path", "chunk_type").alias("title"), shown(F.coalesce(text(own, "comments"), code_text)), F.array(symbols, text(own, "comments"), code_text).alias("columns")),
        ]
        entities = held["entity"].join(files, "file_id", "left")
        summary = F.coalesce(text(own, "summary"), "path")
        parts.append(entities.select(F.lit("entity_fts").alias("index_name"), F.col("entity_id").alias("object_id"), F.lit("entity").alias("object_type"), *scope, domain.alias("domain"), doc_type.alias("doc_type"), F.col("name").alias("title"), shown(summary), F.array("name", "qualified_name", tx.metadata_joined(own, "aliases"), summary).alias("columns")))
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out

    def chunks_with_vectors(self) -> DataFrame:
        """Chunks with their vector reference beside them (B4), joined on reading, not written back."""
        refs = self.physical("vector_ref").filter("object_type = 'chunk'")
        refs = refs.select(F.coalesce("chunk_id", "object_id").alias("chunk_id"), F.col("vector_ref_id").alias("embedding_ref"), "embedding_model_version", F.col("content_hash").alias("embedding_content_hash"))
        return self.physical("chunk").join(newest_first(refs, ["chunk_id"], F.desc("embedding_ref")), "chunk_id", "left")
