"""Project identification: hint, exact root, worktree, subpath, suffix, fallback; over distinct paths only."""

from __future__ import annotations

import fnmatch
import os
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Project:
    id: str
    roots: tuple[str, ...] = ()
    worktrees: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = field(default=())


def fallback_id(path: str | None) -> str:
    name = os.path.basename((path or "").rstrip("/")).lower()
    return "".join(c for c in name if c.isascii() and (c.isalnum() or c in "-_")) or "unknown"


def same_tail(a: str, b: str, least: int = 2) -> int:
    """Length of the longest common tail of components, letter case folded; 0 below `least`."""
    x, y, n = a.lower().strip("/").split("/")[::-1], b.lower().strip("/").split("/")[::-1], 0
    while n < min(len(x), len(y)) and x[n] == y[n]:
        n += 1
    return n if n >= least else 0


def registered(cwd: str, registry: list[Project]) -> str | None:
    """The project that the first of these rules finds: exact root, worktree, below a root, suffix, common tail."""
    path = cwd.rstrip("/")
    rules = (
        lambda p: any(path == r.rstrip("/") for r in p.roots),
        lambda p: any(fnmatch.fnmatchcase(path, g) for g in p.worktrees),
        lambda p: any(path.startswith(r.rstrip("/") + "/") for r in p.roots),
        lambda p: any(path == s or path.endswith("/" + s.strip("/")) for s in p.suffixes),
        lambda p: any(same_tail(path, r) for r in p.roots),
    )
    return next((p.id for rule in rules for p in registry if rule(p)), None)


def identify(cwd: str | None, registry: list[Project], hint: str | None = None) -> str:
    """The hint, the registry's project, or the folder's own name."""
    if hint or not cwd:
        return hint or "unknown"
    return registered(cwd, registry) or fallback_id(cwd.rstrip("/"))


def read_hint(directory: str, name: str = ".project-id", levels: int = 4) -> str | None:
    """The first line of a hint file in the directory or up to `levels` above."""
    for _ in range(levels + 1):
        try:
            with open(os.path.join(directory, name), encoding="utf-8") as f:
                return f.readline().strip() or None
        except OSError:
            directory = os.path.dirname(directory)
    return None


def decode_project_dir(path: Column) -> Column:
    """The project that a session file's folder stands for: below .claude/projects the working directory's path is written with
    dashes for slashes, so the last part between dashes is taken; null for other paths. Whether the decoded directory exists
    is not asked, for executors do not see the machine that wrote the session."""
    folder = F.regexp_extract(path, r"/\.claude/projects/([^/]+)/", 1)
    parts = F.filter(F.split(folder, "-"), lambda x: x != "")
    return F.element_at(F.when(F.size(parts) > 0, parts), -1)


def registry_project(registry: list[Project], path: Column) -> Column:
    """The registry's project of a path's folder, null if only the fallback would name one."""

    @F.pandas_udf("string")
    def run(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: registered(os.path.dirname(p or ""), registry))

    return run(path)


def resolve(items: DataFrame, registry: list[Project], only_unknown: bool = True) -> DataFrame:
    """items with the project of those that lack one (or of all) found anew from their path; distinct paths are mapped once."""
    target = F.col("project").isNull() | (F.col("project") == "unknown") if only_unknown else F.lit(True)
    paths = items.where(target).select("source_path").distinct()

    def run(batches):
        for b in batches:
            b["found"] = [identify(os.path.dirname(p), registry) for p in b["source_path"]]
            yield b

    found = paths.mapInPandas(run, "source_path string, found string")
    out = items.join(found, "source_path", "left")
    keep = F.when(target & F.col("found").isNotNull() & (F.col("found") != "unknown"), F.col("found")).otherwise(F.col("project"))
    return out.withColumn("project", keep).drop("found").select(*items.columns)
