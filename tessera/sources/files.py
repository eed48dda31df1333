"""File sources: workspace scan, segments, lines of configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import area_of, language_of, matches_any

#: Folders that no scan enters (fixed values).
NEVER = [".git", ".hg", ".svn", ".repo"]


def scan(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, content: bool = False) -> DataFrame:
    """(relative_path, size, modified, language, area, content_hash) of the files below ``root``.

    Spark lists and reads in parallel; contents are only read for their hash, or
    returned with ``content``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # Both sides as the file system spells them: the root's own length is cut, wherever its name occurs again.
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().getPath().rstrip("/")
    plain = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?(?=/)", ""), "%20", " ")
    relative = F.substring(plain, F.lit(len(full) + 2), F.length(plain))
    rows = files.withColumn("relative_path", relative).filter(~matches_any(F.col("relative_path"), [*NEVER, *(exclude or [])]))
    if include:
        rows = rows.filter(matches_any(F.col("relative_path"), include))
    columns = ["relative_path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), language_of(F.col("relative_path")).alias("language"), area_of(F.col("relative_path")).alias("area"), F.sha2("content", 256).alias("content_hash")]
    return rows.select(*columns, *(["content"] if content else []))


def segments(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of ordered segments, for each key the last segment's."""
    every = None
    for k, part in enumerate(parts):
        part = part.withColumn("_segment", F.lit(k))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc("_segment"))
    return every.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_segment")


_SYMBOL = "(?:CONFIG_[A-Za-z0-9_]+|[A-Za-z][A-Za-z0-9_]+)"


def config_assignments(lines: DataFrame, line: str = "line") -> DataFrame:
    """Macro lines of defconfig and .config text: (macro, value, value_type, enabled) (I8)."""
    text = F.trim(F.regexp_replace(F.col(line), r"^\s+|\s+$", ""))
    unset = F.regexp_extract(text, rf"^#\s*({_SYMBOL})\s+is\s+not\s+set\s*$", 1)
    macro, raw = F.regexp_extract(text, rf"^({_SYMBOL})=(.*)$", 1), F.trim(F.regexp_extract(text, rf"^({_SYMBOL})=(.*)$", 2))
    rows = lines.withColumn("macro", F.when(unset != "", unset).otherwise(macro)).filter("macro <> ''")
    rows = rows.withColumn("_raw", F.when(unset != "", "n").otherwise(raw))
    r = F.col("_raw")
    quoted = r.rlike('^".*"$')
    kind = F.when(r.isin("y", "n"), "bool").when(r == "m", "tristate").when(quoted, "string").when(F.startswith(F.lower(r), F.lit("0x")), "hex").when(r.rlike("^-?[0-9]+$"), "int").otherwise("literal")
    inner = F.regexp_replace(F.expr("substring(_raw, 2, length(_raw) - 2)"), r'\\(["\\])', "$1")
    value = F.when(quoted, inner).when(F.startswith(F.lower(r), F.lit("0x")), F.lower(r)).otherwise(r)
    on = F.when(r.isin("y", "n"), r == "y").when((r == "m") | quoted, True).when(F.startswith(F.lower(r), F.lit("0x")), r != "0x0").when(r.rlike("^-?[0-9]+$"), r != "0").otherwise(r != "")
    return rows.withColumn("value_type", kind).withColumn("enabled", on).withColumn("value", value).drop("_raw", line)


def effective_config(assignments: DataFrame, order: str) -> DataFrame:
    """Later files override earlier ones, macro by macro."""
    return assignments.groupBy("macro").agg(F.max_by(F.struct("value", "value_type", "enabled"), order).alias("last")).select("macro", "last.*")
