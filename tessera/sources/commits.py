"""Tables as a log of commits (B1, B5-B7, B12): append, upsert, delete, merge and
compaction by several writers at once.

A table is a folder. Rows are in parts, folders of Parquet files that are never
changed; ``_log/<version>.json`` lists the live parts of a version. A writer
first writes its parts, then the next version's file, which only one writer can
create. One who finds it taken looks at the new state and tries again; what it
had worked out stays valid unless the new state changed what it rests on. So
commits are in one order, a crash before the last step leaves the old version,
and a reader sees one version throughout.

Deleted and replaced rows are marked by place: a commit adds (file, row) lists
to the parts they lie in, and readers leave these rows out by an anti-join; a
part without such a list is scanned as it is. A read is two branches of a plan,
however many parts there are.

Parts may belong to a ``table`` of the folder, so one commit changes several
tables at once, and to a ``bucket``, so that a merge rewrites touched buckets only.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Parts and rows from which on parts are merged (fixed values).
MOST_PARTS, MOST_ROWS = 8, 1024
ROWS = "rows"
#: A part's name in the path of one of its files.
_PART = "/([A-Za-z_]+-[0-9a-f]{32}(?:/_bucket=[0-9]+)?)/[^/]+$"


class Conflict(RuntimeError):
    """What a writer rests on was changed by another one, too often to go on."""


@dataclass(frozen=True)
class Part:
    name: str
    number: int  # commits in order; a later part's row is the newer
    rows: int
    table: str = ROWS
    bucket: int | None = None
    gone: tuple[str, ...] = ()  # lists of its rows that are no more
    gone_rows: int = 0


@dataclass(frozen=True)
class State:
    version: int = 0
    next: int = 1
    parts: tuple[Part, ...] = ()
    schemas: dict[str, str] = field(default_factory=dict)
    sums: dict[str, int] = field(default_factory=dict)  # what writers count, summed over commits

    def of(self, table: str = ROWS, buckets: set[int] | None = None) -> list[Part]:
        return [p for p in self.parts if p.table == table and (buckets is None or p.bucket in buckets)]


class Log:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- files ------------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _put(self, version: int, text: str) -> bool:
        """Creates a version's file whole; False if it is there already."""
        name, fresh = f"{self.root}/_log/{version:020d}.json", f"{self.root}/_log/.{uuid.uuid4().hex}.tmp"
        fs, tmp = self._fs(fresh)
        out = fs.create(tmp, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":  # a link is made or fails at once, a local rename does not
                local = lambda p: unquote(urlparse(p).path) if p.startswith("file:") else p
                os.link(local(fresh), local(name))
                return True
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(tmp, self._fs(name)[1], none)
            return True
        except FileExistsError:
            return False
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        finally:
            fs.delete(tmp, False)

    def versions(self) -> list[int]:
        fs, at = self._fs(f"{self.root}/_log")
        if not fs.exists(at):
            return []
        return sorted(int(m[1]) for s in fs.listStatus(at) if (m := re.fullmatch(r"(\d{20})\.json", s.getPath().getName())))

    def state(self, version: int | None = None) -> State:
        known = self.versions()
        if not known:
            return State()
        fs, at = self._fs(f"{self.root}/_log/{known[-1] if version is None else version:020d}.json")
        source = fs.open(at)
        try:
            raw = json.loads(bytes(source.readAllBytes()))
        finally:
            source.close()
        parts = tuple(Part(**{**p, "gone": tuple(p["gone"])}) for p in raw.pop("parts"))
        return State(**raw, parts=parts)

    # -- reading ----------------------------------------------------------------

    def _scan(self, state: State, parts: list[Part], table: str, place: bool = False) -> DataFrame:
        """Live rows of ``parts``; with ``place`` also where each lies."""
        schema = StructType.fromJson(json.loads(state.schemas[table]))
        part = F.regexp_extract(F.col("_metadata.file_path"), _PART, 1).alias("_part")
        at = [F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"), part]
        columns = [f"`{c}`" for c in schema.names]

        def load(some: list[Part]) -> DataFrame:
            return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p.name}" for p in some])

        plain, marked = [p for p in parts if not p.gone], [p for p in parts if p.gone]
        out = None
        if plain:
            out = load(plain).select(*columns, *(at if place else []))
        if marked:
            gone = self.spark.read.schema("_file string, _row bigint").parquet(*[f"{self.root}/{g}" for p in marked for g in p.gone])
            live = load(marked).select(*columns, *at).join(gone, ["_file", "_row"], "left_anti")
            live = live if place else live.drop("_file", "_row", "_part")
            out = live if out is None else out.unionByName(live)
        if out is None:
            out = self.spark.createDataFrame([], schema)
            if place:
                out = out.select("*", F.lit("").alias("_file"), F.lit(0).cast("long").alias("_row"), F.lit("").alias("_part"))
        return out

    def read(self, table: str = ROWS, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a version, the last one by default, of some buckets only if asked."""
        state = self.state(version)
        if table not in state.schemas:
            raise FileNotFoundError(f"no commit of {table} below {self.root}")
        return self._scan(state, state.of(table, buckets), table)

    # -- writing ----------------------------------------------------------------

    def _write(self, df: DataFrame, table: str = ROWS, bucket: str | None = None, order: tuple[str, ...] = (), near: bool = False) -> list[Part]:
        """Writes rows as a part, or as a part a bucket, sorted by ``order`` if asked; each is
        counted on its way and read back. A bucket is a file, or, with ``near``, a file of
        every task, so that no row moves."""
        name, seen = f"{table}-{uuid.uuid4().hex}", Observation()
        watched = df.observe(seen, F.count(F.lit(1)).alias("n"))
        if bucket is None:
            (watched.sortWithinPartitions(*order) if order else watched).write.parquet(f"{self.root}/{name}")
            found = {None: self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}").count()}
        else:
            placed = watched.withColumn("_bucket", F.col(bucket))
            (placed if near else placed.repartition("_bucket")).sortWithinPartitions("_bucket", *order).write.partitionBy("_bucket").parquet(f"{self.root}/{name}")
            back = self.spark.read.parquet(f"{self.root}/{name}") if seen.get["n"] else None
            found = {r[0]: r[1] for r in back.groupBy("_bucket").count().collect()} if back is not None else {}
        if sum(found.values()) != seen.get["n"]:
            raise RuntimeError(f"part {name} of {self.root} lacks rows that were to be written")
        return [Part(name if b is None else f"{name}/_bucket={b}", 0, n, table, b) for b, n in found.items() if n]

    def _schema(self, state: State, schemas: dict[str, StructType]) -> dict[str, str]:
        """Known columns and new ones, which are null in older parts."""
        out = dict(state.schemas)
        for table, schema in schemas.items():
            known = StructType.fromJson(json.loads(out[table])) if table in out else StructType([])
            types = {f.name: f.dataType.simpleString() for f in known}
            for f in schema:
                kind = f.dataType.simpleString()
                if types.get(f.name, kind) != kind:
                    raise ValueError(f"column {f.name} of {table} is {types[f.name]}, not {kind}")
            out[table] = StructType([*known, *[f for f in schema if f.name not in types]]).json()
        return out

    def _commit(self, change: Callable[[State], State], tries: int = 20) -> int:
        """Makes ``change``, which is asked again whenever another commit came first."""
        for _ in range(tries):
            state = self.state()
            after = replace(change(state), version=state.version + 1, next=state.next + 1)
            raw = asdict(after) | {"parts": [asdict(p) for p in after.parts]}
            if self._put(after.version, json.dumps(raw)):
                return after.version
        raise Conflict(f"{tries} commits of others came before this one in {self.root}")

    @staticmethod
    def _new(state: State, parts: list[Part]) -> tuple[Part, ...]:
        return tuple(replace(p, number=state.next) for p in parts)

    def append(self, rows: DataFrame | dict[str, DataFrame], sums: dict[str, int] | None = None) -> int:
        """Adds rows as new parts (B5), of several tables at once if asked; returns the version."""
        rows = rows if isinstance(rows, dict) else {ROWS: rows}
        parts = [p for table, df in rows.items() for p in self._write(df, table)]
        schemas = {table: df.schema for table, df in rows.items()}
        return self._commit(lambda s: replace(s, parts=s.parts + self._new(s, parts), schemas=self._schema(s, schemas), sums=added(s.sums, sums)))

    def _mark(self, state: State, parts: list[Part], keys: DataFrame, key: list[str], table: str) -> dict[str, tuple[str, int]]:
        """Part name to (list, rows): live rows of ``parts`` whose key is in ``keys``."""
        rows = [p for p in parts if p.rows > p.gone_rows]
        if not rows:
            return {}
        name = f"gone-{uuid.uuid4().hex}"
        hit = self._scan(state, rows, table, place=True).join(keys.select(*key).distinct(), key, "left_semi")
        hit.select("_file", "_row", "_part").write.parquet(f"{self.root}/{name}")
        counts = self.spark.read.schema("_file string, _row bigint, _part string").parquet(f"{self.root}/{name}").groupBy("_part").count().collect()
        return {part: (name, n) for part, n in counts}  # a row a part

    @staticmethod
    def _marked(parts: tuple[Part, ...], lists: dict[str, tuple[str, int]]) -> tuple[Part, ...]:
        return tuple(replace(p, gone=(*p.gone, lists[p.name][0]), gone_rows=p.gone_rows + lists[p.name][1]) if p.name in lists else p for p in parts)

    def _change_keys(self, keys: DataFrame, key: list[str], new: list[Part], schema: StructType | None, table: str) -> int:
        done: dict[tuple, dict] = {}

        def change(state: State) -> State:
            lists = {}
            for p in state.of(table):
                at = (p.name, p.gone)
                if at not in done:  # a part of another writer, or one in which it has marked rows since
                    fresh = [x for x in state.of(table) if (x.name, x.gone) not in done]
                    found = self._mark(state, fresh, keys, key, table)
                    done.update({(x.name, x.gone): found.get(x.name) for x in fresh})
                if done[at]:
                    lists[p.name] = done[at]
            schemas = self._schema(state, {table: schema}) if schema is not None else state.schemas
            return replace(state, parts=self._marked(state.parts, lists) + self._new(state, new), schemas=schemas)

        return self._commit(change)

    def upsert(self, rows: DataFrame, key: list[str], table: str = ROWS) -> int:
        """Adds rows (one a key) and marks older rows of their keys, also those that
        others commit meanwhile."""
        parts = self._write(rows, table)
        return self._change_keys(self._load(parts, rows.schema), key, parts, rows.schema, table)

    def _load(self, parts: list[Part], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p.name}" for p in parts]) if parts else self.spark.createDataFrame([], schema)

    def delete(self, keys: DataFrame, key: list[str], table: str = ROWS) -> int:
        """Marks all rows of ``keys`` (B6); returns how many rows went."""
        before = self.state()
        if table not in before.schemas:
            return 0
        version = self._change_keys(keys, key, [], None, table)
        live = lambda s: sum(p.rows - p.gone_rows for p in s.of(table))
        return live(self.state(version - 1)) - live(self.state(version))

    def compact(self, force: bool = False, table: str = ROWS) -> bool:
        """Merges parts into one if they are many or later ones hold many rows (B7). It
        takes the last one's number, so parts that are added meanwhile stay newer; if
        another writer marks rows of the merged parts or merges them too, it starts again."""
        done: dict[tuple, list[Part]] = {}
        worth = False

        def change(state: State) -> State:
            nonlocal worth
            old = state.of(table)
            rest = sum(p.rows - p.gone_rows for p in old[1:])
            worth = (len(old) > 1 and (force or len(old) - 1 >= MOST_PARTS or rest >= MOST_ROWS)) or (force and any(p.gone for p in old))
            if not worth:
                return state
            at = tuple((p.name, p.gone) for p in old)
            base = next((k for k in done if set(k) <= set(at)), None)
            if base is None:
                done[at] = self._write(self._scan(state, old, table), table)
                base = at
            merged = {name for name, _ in base}
            number = max(p.number for p in old if p.name in merged)
            return replace(state, parts=tuple(replace(p, number=number) for p in done[base]) + tuple(p for p in state.parts if p.name not in merged))

        # Nothing to merge is no commit.
        change(self.state())
        if worth:
            self._commit(change)
        return worth

    def merge(self, rows: DataFrame, key: list[str], order: Column, buckets: int = 64, table: str = ROWS) -> tuple[int, set[int]]:
        """Upserts into parts by the key's hash (B1): only buckets that ``rows`` touch are
        read and written anew. Of a key's rows the greatest ``order`` counts, the new
        one if both are equal, so an older row that comes late changes nothing.
        Returns the version and the buckets."""
        columns = rows.columns
        placed = lambda df: df.withColumn("_b", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        touched = {r[0] for r in placed(rows).select("_b").distinct().collect()}
        done: dict[tuple, list[Part]] = {}

        def change(state: State) -> State:
            old = state.of(table, touched)
            at = tuple((p.name, p.gone) for p in old)
            if at not in done:
                both = placed(rows).withColumn("_new", F.lit(True))
                if old:
                    both = both.unionByName(placed(self._scan(state, old, table)).withColumn("_new", F.lit(False)), allowMissingColumns=True)
                last = F.max_by(F.struct(*[c for c in both.columns if c not in (*key, "_new")]), F.struct(order.alias("o"), "_new")).alias("_r")
                best = both.groupBy(*key).agg(last).select(*key, "_r.*").select(*columns, *[c for c in both.columns if c not in (*columns, "_b", "_new")], "_b")
                done[at] = [replace(p, bucket=int(p.bucket)) for p in self._write(best, table, "_b")]
            gone = {p.name for p in old}
            schemas = self._schema(state, {table: rows.schema})
            return replace(state, parts=tuple(p for p in state.parts if p.name not in gone) + self._new(state, done[at]), schemas=schemas)

        return self._commit(change), touched

    def vacuum(self, keep: int = 2) -> int:
        """Forgets all but the last ``keep`` versions and deletes what only they listed;
        readers of older versions must have ended. Parts that no version lists yet
        belong to writers at work and stay."""
        known = self.versions()
        old, live = known[:-keep], {x for v in known[-keep:] for p in self.state(v).parts for x in (p.name, *p.gone)}
        names = {x for v in old for p in self.state(v).parts for x in (p.name, *p.gone)} - live
        for x in (*sorted(names), *[f"_log/{v:020d}.json" for v in old]):
            fs, at = self._fs(f"{self.root}/{x}")
            fs.delete(at, True)
        return len(names)


def added(a: dict[str, int], b: dict[str, int] | None) -> dict[str, int]:
    return {k: a.get(k, 0) + (b or {}).get(k, 0) for k in {*a, *(b or {})}}
