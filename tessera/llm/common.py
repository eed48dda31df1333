"""What the operators share: shared scratch tables, row counts, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch; long texts make the bytes the limit.
ARROW_ROWS, ARROW_BYTES = 1024, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where it is unset, as in tests on one machine, a temporary folder is
    made and set for this session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def tune(spark: SparkSession) -> None:
    """Bound what one Arrow batch hands to a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def remove(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


_LEFT: dict[str, SparkSession] = {}


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Has ``path`` removed when the driver ends, as results are read late."""
    if not _LEFT:
        atexit.register(clean_up)
    _LEFT[path] = spark


def clean_up() -> None:
    """Removes all scratch tables of this driver; results that read them are void then."""
    while _LEFT:
        path, spark = _LEFT.popitem()
        try:
            remove(spark, path)
        except Exception:  # the JVM may be gone already
            return


class Scratch:
    """Written tables in the shared folder: lineage ends there, and a lost
    executor costs only the tasks that read its part again. What an operator
    does not drop itself goes when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[name] = path
        remove_at_exit(self.spark, path)
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                remove(self.spark, path)
                _LEFT.pop(path, None)


def whole(docs: DataFrame, **keys) -> DataFrame:
    """Each row of ``docs`` as one struct ``row`` beside the columns of ``keys``,
    so that columns of any name come through joins unchanged."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(name) for name, c in keys.items()])


#: Bytes of a text that are cut into words at once.
SLICE = 1 << 20


def word_slices(text: bytes):
    """The words of a text (runs without white space of ASCII), a slice at a time,
    so that of a very long text not all words are held at once."""
    at = 0
    while len(text) - at > SLICE:
        end = max(text.rfind(c, at, at + SLICE) for c in (b" ", b"\n"))
        if end <= at:  # one word longer than a slice: up to its end
            ends = [x for c in (b" ", b"\n") if (x := text.find(c, at + 1)) > 0]
            end = min(ends, default=len(text))
        yield text[at:end].split()
        at = end
    yield text[at:].split() if at else text.split()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def components(scratch: Scratch, edges: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """Connected components of (u, v) links as (node, component = least node).

    Alternates large-star and small-star contraction; each round is two
    aggregations to a minimum (combined before the shuffle) and two equi-joins,
    so a node of very many links is never gathered. Links stay in tables.
    Nodes without links are not returned.
    """
    now = scratch.table(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0"
    )
    for k in range(1, most_rounds + 1):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = scratch.table(small.select("e.*").filter("u <> v").distinct(), f"{name}-{k}")
        sums = lambda t: t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        same = sums(now) == sums(after)
        scratch.drop(f"{name}-{k - 1}")
        now = after
        if same:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


#: Members of a group that one task compares at once; larger groups are cut
#: into blocks of about this many, and every pair of blocks is compared.
GROUP = 4096


def in_blocks(scratch: Scratch, rows: DataFrame, keys: list[str], member: str, name: str, most: int = GROUP, weight: str | None = None, most_weight: int = 1 << 20, carried: DataFrame | None = None) -> DataFrame:
    """Deals members of groups to (keys, block pair); lone members go.

    ``rows`` is a written table. A group over ``most`` members is cut into blocks by the member's hash
    and each member goes to all pairs with its own block, so that every two
    members meet in some task, which never holds over about 2 x ``most`` rows,
    nor, of the column ``weight``, a sum over about 2 x ``most_weight``.
    Adds ``block_a``, ``block_b`` and ``own``, and what ``carried`` has for the member.
    """
    heavy = F.sum(weight) / most_weight if weight else F.lit(0.0)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("members"), heavy.alias("heavy")).filter("members > 1")
    sizes = scratch.table(sizes, f"{name}-sizes")
    dealt = rows.join(sizes, keys).withColumn("cuts", F.ceil(F.greatest(F.col("members") / most, "heavy")).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(member), F.col("cuts").cast("bigint")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    dealt = dealt.withColumn("block_a", F.least("own", "other")).withColumn("block_b", F.greatest("own", "other"))
    every = [*keys, "block_a", "block_b"]
    if carried is not None:
        dealt = dealt.join(carried, member)
    return dealt.drop("members", "heavy", "cuts", "other").repartition(*every).sortWithinPartitions(*every)


def split_large(rows: DataFrame, large: DataFrame, keys: list[str], member: str, most: int) -> DataFrame:
    """Like ``in_blocks`` for rows whose groups mostly are small: only groups in
    ``large`` (keys, members) are cut, the others stay one block. ``large`` is
    joined by whatever way its size allows."""
    dealt = rows.join(large, keys, "left").withColumn("cuts", F.ceil(F.coalesce(F.col("members") / most, F.lit(1.0))).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(member), F.col("cuts").cast("bigint")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    return dealt.withColumn("block_a", F.least("own", "other")).withColumn("block_b", F.greatest("own", "other")).drop("members", "cuts", "other")


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of finished steps."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def groups(batches, n_keys: int):
    """Record batches sorted by their first ``n_keys`` columns, as one
    ``pyarrow.RecordBatch`` of whole groups after another."""
    import numpy as np
    import pyarrow as pa

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        ends = starts_of(batch, n_keys)
        last = int(ends[-1])
        if last:
            yield batch.slice(0, last)
        held = batch.slice(last)
        if last:
            held = pa.RecordBatch.from_arrays([c.take(pa.array(np.arange(len(held)))) for c in held.columns], schema=held.schema)
    if held is not None and held.num_rows:
        yield held


def starts_of(batch, n_keys: int):
    """Where groups of equal first columns begin."""
    import numpy as np
    import pyarrow.compute as pc

    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for k in range(n_keys):
        c = batch.column(k)
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def forest(n: int, near):
    """Links that connect what ``near(i, others)`` (a boolean for each of
    ``others``) connects: breadth first over members not yet reached, so a
    group gives fewer links than members."""
    import numpy as np

    left = np.arange(n)
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = near(i, left)
            found = left[hit]
            if len(found):
                left = left[~hit]
                for j in found.tolist():
                    yield i, j
                queue.extend(found.tolist())
