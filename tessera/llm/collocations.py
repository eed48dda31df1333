"""Phrase collocations: word sequences that occur together more than apart.

Texts are lower-cased (A-Z) and cut at ``. , ; : ! ?`` and line ends into
pieces, pieces at blanks and tabs into words; all counts are per language. Four
steps: identical pieces become one row with a multiplicity; each task counts the
weighted n-grams of its distinct pieces in duckdb, which works out of core, and
deals them by hash into buckets, sorted and compressed; one task a bucket adds
them up, again in duckdb, and gives the frequent ones; candidates then send
lookup requests for their parts, shuffled to where the part's count lies, and
answers meet again at the candidate.

N-grams of three words go where their first two are counted. No n-gram is a
group: a frequent one is one row a task. Pieces of more than
``LONG`` words are cut, each with the two words that follow as context, so a
text without any sign to cut at is no larger row than others.

Defined results: a null text is empty, a null language ``und``; empty texts and
pieces give nothing; repeated rows count each; ties of score go by frequency,
then the phrase's bytes; very long texts are cut into pieces whole, but no
piece stays longer than ``LONG`` words; an empty table gives no row; other
columns are not read. Scores are integers, their products decimals of 38 digits:
frequencies below 10^15 are exact.
"""

from __future__ import annotations

import contextlib
import os
import re
import shutil
import tempfile
import uuid
from collections import Counter
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Frequency of a candidate, share of a longer one that drops it, phrases a language (contract).
LEAST, COVERED, MOST = 10, 50, 2000
#: Words of a piece's row, distinct pieces a task holds before it gives them on.
LONG, HELD = 4096, 1 << 18
#: Buckets for each partition of a shuffle; a task works out one after another.
BUCKETS = 4
#: duckdb's memory in one Python worker; what is more goes to the spill folder.
MEMORY = "320MB"
#: A-Z to a-z, a tab to a blank, what ends a piece to a line end.
TABLE = bytes(10 if c in b".,;:!?\n\v\f\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_NOT_PLAIN = re.compile(rb"^ |  | $")


def pieces_of(text: bytes):
    """(words joined by blanks, words at the end that are context only) of a text."""
    for piece in text.translate(TABLE).split(b"\n"):
        if _NOT_PLAIN.search(piece):
            piece = b" ".join(filter(None, piece.split(b" ")))
        if not piece:
            continue
        if piece.count(b" ") < LONG:
            yield piece, 0
            continue
        words = piece.split(b" ")
        for k in range(0, len(words), LONG):
            part = words[k : k + LONG + 2]
            yield b" ".join(part), max(0, len(part) - LONG)


def count_pieces(batches):
    """(lang, piece, ahead, n), combined as far as the task's memory goes."""
    held: Counter = Counter()

    def flush():
        keys, n = list(held), list(held.values())
        for k in range(0, len(keys), 1 << 15):
            some = keys[k : k + (1 << 15)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.string()), pa.array([x[1] for x in some], pa.binary()).view(pa.string()), pa.array([x[2] for x in some], pa.int32()), pa.array(n[k : k + (1 << 15)], pa.int64())], ["lang", "piece", "ahead", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.update((lang, piece, ahead) for piece, ahead in pieces_of(text or b""))
            if len(held) > HELD:
                yield from flush()
    yield from flush()


@contextlib.contextmanager
def duck(shared: str):
    """A duckdb of one thread and bounded memory, whose spill files are in the shared
    folder where that is a path, in the task's own scratch otherwise; they go with
    the task's attempt and nothing else reads them."""
    import duckdb

    at = urlparse(shared)
    top = at.path if at.scheme in ("", "file") else tempfile.gettempdir()
    spill = os.path.join(top, f"duckdb-{uuid.uuid4().hex}")
    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": spill, "preserve_insertion_order": False})
    try:
        yield con
    finally:
        con.close()
        shutil.rmtree(spill, ignore_errors=True)


def count_grams(buckets: int, shared: str):
    """Pieces to (bucket, grams): the task's n-grams with their weights, one Arrow
    stream or more for each bucket. A row (a, b, c) is two n-grams at once: the pair's
    count is the sum of its rows, which go to one bucket; words have rows of their own."""

    def packed(bucket: int, tables: list[pa.Table]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, tables[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(pa.concat_tables(tables).combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["bucket", "grams"])

    def run(batches):
        with duck(shared) as con:
            con.execute("CREATE TABLE pieces (lang VARCHAR, piece VARCHAR, ahead INTEGER, n BIGINT)")
            for batch in batches:
                if batch.num_rows:
                    arrived = pa.Table.from_batches([batch])  # noqa: F841  duckdb reads it by name
                    con.execute("INSERT INTO pieces SELECT * FROM arrived")
            # Each word starts one row with the two words that follow it.
            con.execute("""CREATE TABLE starts AS SELECT lang, a, b, c, sum(n)::BIGINT AS n FROM (SELECT lang, n, unnest(w[: len(w) - ahead]) AS a, unnest(w[2:]) AS b, unnest(w[3:]) AS c
             FROM (SELECT lang, string_split(piece, ' ') AS w, ahead, sum(n)::BIGINT AS n FROM pieces GROUP BY lang, piece, ahead)) WHERE a IS NOT NULL GROUP BY lang, a, b, c""")
            con.execute("DROP TABLE pieces")
            rows = con.sql(f"""SELECT (hash(lang, a, b) % {buckets})::INTEGER AS bucket, lang, a, b, c, n FROM (SELECT * FROM starts WHERE b IS NOT NULL
             UNION ALL SELECT lang, a, NULL, NULL, sum(n)::BIGINT FROM starts GROUP BY lang, a) ORDER BY bucket, lang, a, b, c""").to_arrow_reader(1 << 16)
            now, held = None, []
            for batch in rows:
                bucket = batch.column(0).to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
                for i, j in zip(edges[:-1], edges[1:], strict=True):
                    if i == j:
                        continue
                    if held and (now != bucket[i] or sum(map(len, held)) >= 1 << 18):
                        yield packed(now, held)
                        held = []
                    now = int(bucket[i])
                    held.append(pa.Table.from_batches([batch.slice(i, j - i).drop_columns("bucket")]))
            if held:
                yield packed(now, held)

    return run


def add_up(least: int, shared: str):
    """Buckets, in order, to (lang, phrase, words, n): n-grams of at least ``least`` occurrences,
    and a row of no words for what a language's words are together."""

    often = f"HAVING sum(n) >= {int(least)}"

    def sums(con):
        return con.sql(f"""SELECT lang, a AS phrase, 1 AS words, sum(n)::BIGINT AS n FROM grams WHERE b IS NULL GROUP BY lang, a {often}
             UNION ALL SELECT lang, a || ' ' || b, 2, sum(n)::BIGINT FROM grams WHERE b IS NOT NULL GROUP BY lang, a, b {often}
             UNION ALL SELECT lang, a || ' ' || b || ' ' || c, 3, sum(n)::BIGINT FROM grams WHERE c IS NOT NULL GROUP BY lang, a, b, c {often}
             UNION ALL SELECT lang, '', 0, sum(n)::BIGINT FROM grams WHERE b IS NULL GROUP BY lang""").to_arrow_reader(1 << 15)

    def run(batches):
        with duck(shared) as con:
            now = None
            for batch in batches:
                for bucket, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if bucket != now:
                        if now is not None:
                            yield from sums(con)
                        con.execute("CREATE OR REPLACE TABLE grams (lang VARCHAR, a VARCHAR, b VARCHAR, c VARCHAR, n BIGINT)")
                        now = bucket
                    arrived = pa.ipc.open_stream(raw.as_buffer()).read_all()  # noqa: F841
                    con.execute("INSERT INTO grams SELECT * FROM arrived")
            if now is not None:
                yield from sums(con)

    return run


def count(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, n) of all frequent n-grams of up to three words; words = 0 has each language's total."""
    spark = docs.sparkSession
    common.tune(spark)
    shared, buckets = common.shared_dir(spark), BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    pieces = rows.mapInArrow(count_pieces, "lang string, piece string, ahead int, n bigint").repartition("lang", "piece")
    grams = pieces.mapInArrow(count_grams(buckets, shared), "bucket int, grams binary").repartition("bucket").sortWithinPartitions("bucket")
    return grams.mapInArrow(add_up(least, shared), "lang string, phrase string, words int, n bigint")


def mine(docs: DataFrame, least: int = LEAST, covered: int = COVERED, most: int = MOST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``most`` phrases a language."""
    scratch = common.Scratch(docs.sparkSession)
    grams = scratch.table(count(docs, least), "n-grams")
    found = grams.filter("words > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("found"))
    candidates = grams.filter("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    w = F.split("phrase", " ")
    some = lambda i, n: F.array_join(F.slice(w, i, n), " ")
    cut = lambda k, n: [F.struct(F.lit(k).alias("k"), F.lit(s).alias("side"), some(*x).alias("part")) for s, x in (("l", (1, k)), ("r", (k + 1, n - k)))]
    asked = candidates.select("lang", "phrase", "words", "a", F.explode(F.when(F.col("words") == 2, F.array(*cut(1, 2))).otherwise(F.array(*cut(1, 3), *cut(2, 3)))).alias("x")).select("lang", "phrase", "words", "a", "x.*")
    # A request goes to its part's count; both answers of a cut come back to its candidate.
    answers = asked.join(found, ["lang", "part"]).groupBy("lang", "phrase", "words", "a", "k").agg(*[F.max(F.when(F.col("side") == s, F.col("found"))).alias(s) for s in ("l", "r")])
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide("a") * wide("a")), wide("l") * wide("r"))
    best = answers.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    longer = asked.filter((F.col("words") == 3) & F.contains("part", F.lit(" "))).groupBy("lang", F.col("part").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    total = grams.filter("words = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    kept = kept.select("lang", "phrase", "a", "m.l", "m.r", "m.score").withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= most)
    return kept.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
