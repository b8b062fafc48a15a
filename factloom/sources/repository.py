"""Listings and contents of a repository as DataFrames, from the working tree or from a commit."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import under

#: Never listed by a walk: folders of these names, and what a machine keeps for itself in the control folder.
IGNORED_PARTS = (".git", "__pycache__")
IGNORED_LOCAL = ("receipts", "cache", ".install-state.json", ".status-seen.json")
#: Seconds that git may take.
PATIENCE = 600
#: Files that a task reads at a time.
SHARE = 2000
TEXT_SUFFIXES = (".py", ".md", ".html", ".json", ".yml", ".yaml", ".toml", ".txt")


def _git(root: str, *args: str, data: bytes | None = None) -> bytes | None:
    """What git says; None where there is no git or it refuses. A git that does not end in time is an error, not an absent one."""
    try:
        done = subprocess.run(["git", "-c", "core.quotepath=off", "-C", root, *args], input=data, capture_output=True, timeout=PATIENCE)
    except OSError:
        return None
    return done.stdout if done.returncode == 0 else None


def _lines(data: bytes | None) -> list[str] | None:
    return None if data is None else [x for x in data.decode("utf-8", "ignore").split("\n") if x]


def tracked(root: str) -> list[str] | None:
    """Tracked and untracked, not ignored paths; None where git does not answer."""
    return _lines(_git(root, "ls-files", "--cached", "--others", "--exclude-standard"))


def walked(root: str, derived: Sequence[str] = (), control: str = ".facts") -> list[str]:
    """Paths below root without derived output and without what belongs to this machine alone."""
    left_out = {f"{control}/{n}" for n in IGNORED_LOCAL}
    out = []
    for folder, names, files in os.walk(root):
        base = os.path.relpath(folder, root).replace(os.sep, "/")
        prefix = "" if base == "." else base + "/"
        names[:] = sorted(n for n in names if n not in IGNORED_PARTS and prefix + n not in left_out and prefix + n not in derived)
        out += [prefix + f for f in files if not f.endswith(".pyc") and prefix + f not in left_out]
    return out


def within(files: DataFrame, roots: Sequence[str] = (".",), derived: Sequence[str] = ("wiki",)) -> DataFrame:
    """files (path) at or below any root and below no derived prefix; distinct."""
    clean = [r.strip().replace("\\", "/").removeprefix("./").rstrip("/") for r in roots]
    inside, outside = F.lit(False), F.lit(False)
    for r in clean:
        inside = inside | under(F.col("path"), F.lit("" if r == "." else r))
    for p in derived:
        outside = outside | under(F.col("path"), F.lit(p))
    return files.where(inside & ~outside).distinct()


def files(spark: SparkSession, root: str, roots: Sequence[str] = (".",), derived: Sequence[str] = ("wiki",), control: str = ".facts") -> DataFrame:
    """path of every file in scope: from git, else from a walk."""
    found = tracked(root)
    listed = spark.createDataFrame([(p,) for p in (walked(root, derived, control) if found is None else found)], "path string")
    return within(listed, roots, derived)


def disk_paths(spark: SparkSession, root: str) -> DataFrame:
    """path, is_dir of everything on disk, a wider set than the files in scope."""
    rows = []
    for folder, names, own in os.walk(root):
        names[:] = [n for n in names if n != ".git"]
        base = os.path.relpath(folder, root).replace(os.sep, "/")
        prefix = "" if base == "." else base + "/"
        rows += [(prefix + n, True) for n in names] + [(prefix + n, False) for n in own]
    return spark.createDataFrame(rows, "path string, is_dir boolean")


def _seen(root: str) -> None:
    if not os.path.isdir(root):
        raise FileNotFoundError(f"{root} is not there on this executor: a repository must lie in a folder that all executors share")


def contents(spark: SparkSession, root: str, listed: DataFrame, suffixes: Sequence[str] = TEXT_SUFFIXES) -> DataFrame:
    """path, content (null where unreadable) of the listed text files, read by the tasks that use them.

    Executors must see ``root``; one that does not fails instead of giving nulls.
    """
    at = str(Path(root).resolve())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _seen(at)
        for batch in batches:
            out = []
            for path in batch["path"]:
                try:
                    out.append((Path(at) / path).read_bytes().decode("utf-8", "ignore"))
                except OSError:
                    out.append(None)
            yield pd.DataFrame({"path": batch["path"], "content": pd.Series(out, index=batch.index, dtype=object)})

    text = F.lit(False)
    for e in suffixes:
        text = text | F.col("path").endswith(e)
    return listed.where(text).select("path").mapInPandas(run, "path string, content string")


def _blobs(root: str, shas: list[str]) -> list[str | None]:
    """Contents of blobs, null where git has none."""
    data = _git(root, "cat-file", "--batch", data="".join(f"{s}\n" for s in shas).encode())
    if data is None:
        return [None] * len(shas)
    out: list[str | None] = []
    at = 0
    for _ in shas:
        head, _, _ = data[at : at + 200].partition(b"\n")
        fields, at = head.split(), at + len(head) + 1
        if len(fields) != 3:
            out.append(None)
            continue
        size = int(fields[2])
        out.append(data[at : at + size].decode("utf-8", "ignore"))
        at += size + 1
    return out


def contents_at(spark: SparkSession, root: str, ref: str = "HEAD", suffixes: Sequence[str] = (".py",)) -> DataFrame | None:
    """path, content at a commit, all or nothing: None where the commit or one blob cannot be read. Modules of other repositories are no files.

    The driver lists names and hashes; tasks ask git for the blobs, SHARE at a time. Executors must see ``root``.
    """
    listing = _lines(_git(root, "ls-tree", "-r", ref))
    if listing is None:
        return None
    heads = [(path, head.split()) for head, path in (x.split("\t", 1) for x in listing) if path.endswith(tuple(suffixes))]
    blobs = spark.createDataFrame([(path, h[2]) for path, h in heads if h[1] == "blob"], "path string, sha string")
    at = str(Path(root).resolve())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _seen(at)
        for batch in batches:
            for i in range(0, len(batch), SHARE):
                share = batch.iloc[i : i + SHARE]
                yield pd.DataFrame({"path": share["path"], "content": pd.Series(_blobs(at, list(share["sha"])), index=share.index, dtype=object)})

    read = blobs.mapInPandas(run, "path string, content string").cache()
    return None if not read.where("content is null").isEmpty() else read


def changed_paths(spark: SparkSession, root: str, base: str = "HEAD") -> DataFrame:
    """path of everything that differs from ``base`` or is untracked; empty where git does not answer."""
    diff, new = _lines(_git(root, "diff", "--name-only", "--no-renames", base)), _lines(_git(root, "ls-files", "--others", "--exclude-standard"))
    rows = [] if diff is None or new is None else [(p,) for p in (*diff, *new)]
    return spark.createDataFrame(rows, "path string").distinct()


def ref_resolves(root: str, ref: str) -> bool:
    return _git(root, "rev-parse", "--verify", "--quiet", f"{ref}^{{commit}}") is not None


def head_commit(root: str) -> str | None:
    found = _lines(_git(root, "rev-parse", "HEAD"))
    return found[0] if found else None


def tasks(contents: DataFrame, root: str = ".trellis") -> tuple[DataFrame, DataFrame]:
    """The task relation from task.json files below ``root``/tasks, and the paths that are not JSON objects."""
    schema = "id string, name string, status string, package string, dev_type string, priority string, _bad string"
    under_tasks = contents.where(F.col("path").startswith(f"{root}/tasks/") & F.col("path").endswith("/task.json"))
    parsed = under_tasks.select("path", F.from_json("content", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("j"))
    good = parsed.where("j is not null and j._bad is null")
    parts = F.split("path", "/")
    found = good.select(
        F.coalesce("j.id", "j.name", F.element_at(parts, -2)).alias("id"),
        F.coalesce("j.status", F.lit("")).alias("status"),
        "j.package",
        "j.dev_type",
        "j.priority",
        (F.element_at(F.split(F.substring("path", len(root) + 8, 1 << 20), "/"), 1) == "archive").alias("archived"),
    )
    return found, parsed.where("j is null or j._bad is not null").select(F.lit("tasks").alias("family"), F.col("path").alias("entry"))
