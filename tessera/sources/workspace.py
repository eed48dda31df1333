"""Workspaces: path guard, repositories, ignore files, document and build scans."""

from __future__ import annotations

import json
import os
import subprocess
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from .files import scan

GIT_SECONDS = 5


class PathBlocked(ValueError):
    """A path that no allowed root covers; the message holds no absolute path."""

    def __init__(self, reason: str, name: str):
        super().__init__(f"{reason}: {name}")
        self.reason = reason


@dataclass(frozen=True)
class Guarded:
    path: Path
    label: str
    display: str


class PathGuard:
    """Lets paths under allowed roots through, as they are written and as they
    resolve, so that neither dots nor links lead out (A19)."""

    def __init__(self, roots: dict[str, str], base: str | None = None):
        self.base = base or os.getcwd()
        self.roots = [(label, Path(os.path.abspath(os.path.join(self.base, os.path.expanduser(r))))) for label, r in roots.items()]

    def guard(self, path: str, must_exist: bool = False, follow_out: bool = False) -> Guarded:
        plain = Path(os.path.abspath(os.path.join(self.base, os.path.expanduser(path))))
        inside = [(label, r) for label, r in self.roots if plain.is_relative_to(r)]
        if not inside:
            raise PathBlocked("path_outside_allowlist", plain.name or ".")
        if must_exist and not plain.exists():
            raise PathBlocked("path_missing", plain.name or ".")
        if not follow_out and not any(plain.resolve().is_relative_to(r.resolve()) for _, r in self.roots):
            raise PathBlocked("symlink_outside_allowlist", plain.name or ".")
        label, root = inside[0]
        return Guarded(plain, label, f"{label}:{plain.relative_to(root).as_posix()}")


def _git(folder: str, *args: str, given: str | None = None) -> tuple[str, str | None]:
    try:
        r = subprocess.run(("git", "-C", folder, *args), input=given, capture_output=True, text=True, timeout=GIT_SECONDS, check=False)
    except FileNotFoundError:
        return "", "git_not_available"
    except subprocess.TimeoutExpired:
        return "", "git_timeout"
    if r.returncode and not (args[0] == "check-ignore" and r.returncode == 1):
        return r.stdout, r.stderr.strip() or f"git exited {r.returncode}"
    return r.stdout, None


REPOSITORY = "relative_path string, commit string, branch string, dirty boolean, boundary string, error string"


def repositories(spark: SparkSession, guard: PathGuard, root: str) -> DataFrame:
    """(relative_path, commit, branch, dirty, boundary, error) of repositories below
    ``root`` and of its submodules (A7). Links that lead out are not entered."""
    top = guard.guard(root, must_exist=True).path
    found: dict[str, tuple] = {}
    for folder, names, files in os.walk(top):
        marker = os.path.join(folder, ".git")
        where = os.path.relpath(folder, top)
        if ".git" in names or ".git" in files:
            commit, error = _git(folder, "rev-parse", "--verify", "HEAD")
            branch, _ = _git(folder, "branch", "--show-current")
            status, bad = _git(folder, "status", "--porcelain", "--untracked-files=no")
            found[where] = (where, commit.strip() or None if not error else None, branch.strip() or None, None if bad else bool(status.strip()), "directory" if os.path.isdir(marker) else "file", error)
        names[:] = sorted(n for n in names if n not in (".git", ".hg", ".svn", ".repo") and not os.path.islink(os.path.join(folder, n)))
    if found.get(".", (None, None))[1]:
        said, error = _git(str(top), "submodule", "status", "--recursive")
        for line in [] if error else said.splitlines():
            parts = line.strip().lstrip("-+U").split(None, 2)
            if len(parts) > 1 and parts[1] not in found:
                try:
                    there = guard.guard(os.path.join(top, parts[1])).path.exists()
                except PathBlocked:
                    continue
                found[parts[1]] = (parts[1], parts[0], None, None, "submodule_status", None if there else "submodule_path_missing")
    order = sorted(found.values(), key=lambda r: (r[0] != ".", r[0]))
    return spark.createDataFrame(order, REPOSITORY)


def ignored(spark: SparkSession, root: str, files: DataFrame, repos: DataFrame, block: int = 20_000) -> DataFrame:
    """(relative_path) of ``files`` that their repository's ignore files leave out.

    git answers for paths on the driver's disk; they go to it in blocks from an
    iterator, one repository after another, never all at once.
    """
    owned = nearest_repository(files, repos).filter("repo is not null").orderBy("repo", "relative_path")
    out: list[tuple[str]] = []
    held: list[str] = []
    now = None

    def flush() -> None:
        if held:
            folder = root if now == "." else os.path.join(root, now)
            short = {p if now == "." else p[len(now) + 1 :]: p for p in held}
            said, error = _git(folder, "check-ignore", "-z", "--stdin", given="\0".join(short) + "\0")
            if not error:
                out.extend((short[p],) for p in said.split("\0") if p in short)
            held.clear()

    for r in owned.select("repo", "relative_path").toLocalIterator():
        if r["repo"] != now or len(held) >= block:
            flush()
            now = r["repo"]
        held.append(r["relative_path"])
    flush()
    return spark.createDataFrame(out, "relative_path string")


def nearest_repository(files: DataFrame, repos: DataFrame, path: str = "relative_path") -> DataFrame:
    """Adds ``repo``: the deepest repository that holds a path, ``.`` for the root's
    own (A9). A path meets its own prefixes in an equi-join, so a deep tree is no
    range join."""
    parts = F.split(path, "/")
    prefixes = F.concat(F.array(F.lit(".")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    up = files.select(path).distinct().select(path, F.posexplode(prefixes).alias("depth", "repo"))
    known = repos.select(F.col("relative_path").alias("repo")).distinct()
    best = up.join(known, "repo").groupBy(path).agg(F.max_by("repo", "depth").alias("repo"))
    return files.join(best, path, "left")


def scan_workspace(spark: SparkSession, guard: PathGuard, root: str, include: list[str] | None = None, exclude: list[str] | None = None, use_ignore_files: bool = True) -> dict[str, DataFrame]:
    """files, repositories and areas of a workspace (A1, A6, A9): scanned in parallel,
    without excluded, ignored and linked-out files."""
    top = guard.guard(root, must_exist=True).path
    repos = repositories(spark, guard, str(top))
    files = scan(spark, f"file://{top}", include, exclude)

    real = str(top.resolve())

    @F.udf("boolean")
    def inside(p: str) -> bool:
        at = os.path.realpath(os.path.join(real, p))
        return at == real or at.startswith(real + "/")

    files = files.filter(inside("relative_path"))
    if use_ignore_files:
        files = files.join(ignored(spark, str(top), files, repos), "relative_path", "left_anti")
    files = nearest_repository(files, repos)
    return {"files": files, "repositories": repos, "areas": area_counts(files)}


def area_counts(files: DataFrame, path: str = "relative_path") -> DataFrame:
    """(area, files, folders) of top-level folders; files at the top have none."""
    area = tx.area_of(F.col(path))
    parts = F.split(path, "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    rows = files.filter(area.isNotNull())
    folders = rows.select(area.alias("area"), F.explode(up).alias("f")).distinct().groupBy("area").agg(F.count("*").alias("folders"))
    return rows.groupBy(area.alias("area")).agg(F.count("*").alias("files")).join(folders, "area")


def scan_documents(spark: SparkSession, guard: PathGuard, root: str, suffixes: tuple[str, ...] = (".md", ".markdown", ".mdx", ".html", ".htm")) -> DataFrame:
    """Source documents with their ``category``, the first folder (A11); texts are read as UTF-8."""
    top = guard.guard(root, must_exist=True).path
    rows = scan(spark, f"file://{top}", content=True)
    low = F.lower("relative_path")
    wanted = F.lit(False)
    for s in suffixes:
        wanted = wanted | low.endswith(s)
    category = F.coalesce(tx.area_of(F.col("relative_path")), F.lit("uncategorized"))
    return rows.filter(wanted).select("relative_path", F.when(category == "widget", "widgets").otherwise(F.lower(category)).alias("category"), "size", "modified", "content_hash", F.decode("content", "UTF-8").alias("text"))


def scan_build_outputs(spark: SparkSession, guard: PathGuard, root: str, patterns: tuple[str, ...] = ("*_defconfig", "defconfig", ".config", "compile_commands.json")) -> DataFrame:
    """Configurations and compile databases with their ``kind``."""
    top = guard.guard(root, must_exist=True).path
    rows = scan(spark, f"file://{top}", include=list(patterns), content=True)
    name = F.element_at(F.split("relative_path", "/"), -1)
    kind = F.when(name == ".config", "dotconfig").when(name == "compile_commands.json", "compile_db").otherwise("defconfig")
    return rows.select("relative_path", kind.alias("kind"), "size", "modified", "content_hash", F.decode("content", "UTF-8").alias("text"))


SUITE = "case_id string, title string, category string, priority string, input_tool string, expected_intent string, request string, locators array<string>"


def load_suite(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a YAML or JSON file (A18); a suite is a small file on the driver."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        import yaml  # an optional library

        held = yaml.safe_load(text)
    else:
        held = json.loads(text)
    cases = held.get("cases", []) if isinstance(held, dict) else held
    seen = set()
    rows = []
    for c in cases:
        if not c.get("case_id") or c["case_id"] in seen:
            raise ValueError(f"a case needs an id of its own: {c.get('case_id')!r}")
        seen.add(c["case_id"])
        rows.append((c["case_id"], c.get("title"), c.get("category"), c.get("priority"), c.get("input_tool"), (c.get("expected_route") or {}).get("intent"), json.dumps(c.get("request") or {}, sort_keys=True), [e.get("locator") for e in c.get("expected_evidence") or []]))
    return spark.createDataFrame(rows, SUITE)


def load_report(spark: SparkSession, path: str) -> DataFrame:
    """A JSON report as one row."""
    return spark.read.option("multiLine", True).json(path)
