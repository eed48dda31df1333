"""Upkeep of an overlay: snapshots, retention, compaction, migrations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .layers import newest

TERMINAL = ("ready", "failed", "partial_ready")


def without_snapshot(tables: dict[str, DataFrame], snapshot: str, protected: tuple[str, ...] = ("current",)) -> dict[str, DataFrame]:
    """The overlay's tables without a snapshot's rows (B15); protected ones stay."""
    if snapshot in protected:
        raise ValueError(f"{snapshot} can't be deleted")
    return {n: t.filter(F.col("snapshot_id") != snapshot) if "snapshot_id" in t.columns else t for n, t in tables.items()}


def old_jobs(jobs: DataFrame, keep: int) -> DataFrame:
    """Terminal jobs beyond the ``keep`` newest, by time, then id."""
    done = jobs.filter(F.col("status").isin(*TERMINAL)).withColumn("all", F.lit(1))
    kept = newest(done, ["all"], [F.desc("updated_at"), F.col("job_id")], keep)
    return done.join(kept.select("job_id"), "job_id", "left_anti").drop("all")


def ordered_jobs(jobs: DataFrame, status: str | None = None) -> DataFrame:
    """Jobs, the newest first, ties by id."""
    rows = jobs if status is None else jobs.filter(F.col("status") == status)
    return rows.orderBy(F.desc("updated_at"), "job_id")


def profiles_of(profiles: DataFrame, snapshot: str) -> DataFrame:
    """A snapshot's profiles by record id."""
    return profiles.filter(F.col("snapshot_id") == snapshot).orderBy("profile_record_id")


def compacted(overlay: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The overlay without inactive tombstones and replacements (B17); its index rows
    are derived from the tables whenever they are read, so none are stale."""
    return {n: t.filter("active") if n in ("tombstone", "replacement") else t for n, t in overlay.items()}


def migrate(tables: dict[str, DataFrame], version: int, steps: dict[int, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]], target: int) -> tuple[dict[str, DataFrame], list[int]]:
    """Tables brought from ``version`` to ``target`` by the steps between (B18), each
    named by the version it leads to; (tables, steps applied).

    Steps are plans over the old tables, which are not touched: the caller publishes
    all of the result or none of it, and the old version is the way back.
    """
    if version > target:
        raise ValueError(f"version {version} is newer than {target}")
    missing = [v for v in range(version + 1, target + 1) if v not in steps]
    if missing:
        raise ValueError(f"there is no step to {missing}")
    applied = list(range(version + 1, target + 1))
    for v in applied:
        tables = steps[v](dict(tables))
    return tables, applied


def add_column(table: str, name: str, value: Column) -> Callable[[dict[str, DataFrame]], dict[str, DataFrame]]:
    """A migration step that gives a table a column, if it has none of the name."""

    def step(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        t = tables[table]
        return {**tables, table: t if name in t.columns else t.withColumn(name, value)}

    return step
