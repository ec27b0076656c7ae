"""A worktree on disk as a Spark data source: ``spark.read.format("worktree").load(root)``.

The driver lists only the upper levels; every directory below them is a partition
whose task walks it. Ignored directories, version-control data, linked
directories and what lies outside the wanted scopes are pruned while listing.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith

from quernel.sources.worktree import ignore_rule, within

SCHEMA = "path string, full_path string, external boolean, length long, content binary"


class Rule(NamedTuple):
    base: str
    regex: str
    whole: bool
    top: bool
    directory: bool
    negated: bool

    def hits(self, path: str, is_directory: bool) -> bool:
        if self.directory and not is_directory or self.base and not path.startswith(self.base + "/"):
            return False
        below = path[len(self.base) + 1 :] if self.base else path
        if self.top and "/" in below:
            return False
        return re.match(self.regex, below if self.whole else below.rpartition("/")[2]) is not None


def ignored(path: str, rules: list[Rule], is_directory: bool) -> bool:
    """Whether the last rule that hits a path leaves it out."""
    return next((not r.negated for r in reversed(rules) if r.hits(path, is_directory)), False)


def rules_of(file: str, base: str) -> list[Rule]:
    """The rules of an ignore file, none where it can't be read."""
    try:
        with open(file, encoding="utf-8", errors="replace", newline=None) as f:
            return [Rule(base, *found) for line in f if (found := ignore_rule(line))]
    except OSError:
        return []


def exclude_file(root: str) -> str | None:
    """The file of rules that aren't in the tree, also where ``.git`` is a file that names the directory, or that has a common one."""
    marker = os.path.join(root, ".git")
    try:
        if os.path.isfile(marker):
            with open(marker, encoding="utf-8") as f:
                named = re.fullmatch(r"(?is)gitdir:\s*(\S.*?)\s*", f.read())
            if not named or not os.path.isdir(marker := os.path.normpath(os.path.join(root, named[1]))):
                return None
            common = os.path.join(marker, "commondir")
            if os.path.isfile(common):
                with open(common, encoding="utf-8") as f:
                    marker = os.path.normpath(os.path.join(marker, f.read().strip()))
    except OSError:
        return None
    return os.path.join(marker, "info", "exclude")


def wanted(path: str, scopes: list[str], leading: bool = False) -> bool:
    """Whether a path lies in a scope, or, ``leading``, is a directory on the way to one."""
    return not scopes or any(path == s or path.startswith(s + "/") or (leading and (s.startswith(path + "/") or not path)) for s in scopes)


class Directory(InputPartition):
    def __init__(self, path: str, rules: list[Rule], deep: bool) -> None:
        self.path, self.rules, self.deep = path, rules, deep


def entries(root: str, path: str, rules: list[Rule], scopes: list[str], prefixes: list[str]) -> tuple[list[Rule], list[str], list[str]]:
    """The rules that hold in a directory, its directories and its files, ignored ones left out, in the order of names."""
    folder = os.path.join(root, path)
    rules = rules + rules_of(os.path.join(folder, ".gitignore"), path)
    directories, files = [], []
    for e in sorted(os.scandir(folder), key=lambda e: e.name):
        below = f"{path}/{e.name}" if path else e.name
        is_directory = e.is_dir()
        if e.name.lower() == ".git" or (is_directory and e.is_symlink()) or not wanted(below, scopes, is_directory):
            continue
        if prefixes and not any(below.startswith(p) or (is_directory and p.startswith(below)) for p in prefixes):
            continue
        if not ignored(below, rules, is_directory):
            (directories if is_directory else files).append(below)
    return rules, directories, files


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = os.path.abspath(re.sub("^file:/*", "/", options["path"]))
        self.scopes = [s.strip("/") for s in json.loads(options.get("scopes", "[]"))]
        self.levels = int(options.get("levels", "2"))
        self.content = options.get("content", "false") == "true"
        self.prefixes: list[str] = []

    def partitions(self) -> list[InputPartition]:
        if not os.path.isdir(self.root):
            raise FileNotFoundError(f"the worktree {self.root} does not exist")
        exclude = exclude_file(self.root)
        found, level = [], [("", rules_of(exclude, "") if exclude else [])]
        for _ in range(self.levels):
            below = []
            for path, rules in level:
                held, directories, _files = entries(self.root, path, rules, self.scopes, self.prefixes)
                found.append(Directory(path, rules, False))
                below += [(d, held) for d in directories]
            level = below
        return found + [Directory(path, rules, True) for path, rules in level]

    def read(self, partition: Directory) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        todo = [(partition.path, partition.rules)]
        while todo:
            path, rules = todo.pop()
            held, directories, files = entries(self.root, path, rules, self.scopes, self.prefixes)
            for f in files:
                row = self.row(f)
                if row is not None:
                    rows.append(row)
                    size += 200 + len(row[4] or b"")
                    if size > 16 << 20:
                        yield self.batch(rows)
                        rows, size = [], 0
            if partition.deep:
                todo += [(d, held) for d in reversed(directories)]
        if rows:
            yield self.batch(rows)

    def row(self, path: str) -> tuple | None:
        """A file under the path of what it is linked to; None where that is no file."""
        full = os.path.join(self.root, path)
        linked = os.path.islink(full)
        real = os.path.realpath(full) if linked else full
        try:
            length = os.stat(real).st_size if os.path.isfile(real) else None
            content = open(real, "rb").read() if self.content and length is not None else None
        except OSError:
            return None
        if length is None:
            return None
        told = os.path.relpath(real, os.path.realpath(self.root)).replace(os.sep, "/") if linked else path
        return told, real, told.startswith("../"), length, content

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [("path", pa.string()), ("full_path", pa.string()), ("external", pa.bool_()), ("length", pa.int64()), ("content", pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])


class PushingReader(Reader):
    """For sessions in which ``spark.sql.python.filterPushdown.enabled`` is true; Spark refuses it in others."""

    def pushFilters(self, filters: list) -> Iterator:
        """Equal paths and common beginnings of paths prune directories too; Spark still applies them."""
        for f in filters:
            if getattr(f, "attribute", None) == ("path",) and not self.prefixes:
                if isinstance(f, EqualTo):
                    self.prefixes = [f.value]
                elif isinstance(f, In):
                    self.prefixes = list(f.value)
                elif isinstance(f, StringStartsWith):
                    self.prefixes = [f.value]
            yield f


class Worktree(DataSource):
    """Options: ``scopes`` (a JSON list of paths), ``levels`` that the driver lists (2), ``content`` ("true" reads the files), ``pushdown`` ("true" prunes by filters on paths)."""

    @classmethod
    def name(cls) -> str:
        return "worktree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return (PushingReader if self.options.get("pushdown") == "true" else Reader)(self.options)


def listed(spark: SparkSession, root: str, scopes: list[str] = (), content: bool = False, levels: int = 2, external: list[str] = ()) -> DataFrame:
    """(path, full_path, external, length, content) of the files of a worktree in a folder that driver and executors share.

    A file link counts as the file it leads to, once; links out of the tree count
    only where ``external`` names the place. Linked directories are not entered.
    """
    spark.dataSource.register(Worktree)
    options = {"scopes": json.dumps(list(scopes)), "levels": levels, "content": str(content).lower(), "pushdown": spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")}
    read = spark.read.format("worktree").options(**options).load(root)
    kept = read.where(~F.col("external") | within(F.col("path"), list(external)))
    others = [c for c in read.columns if c != "path"]
    return kept.groupBy("path").agg(F.min_by(F.struct(*others), "full_path").alias("f")).select("path", "f.*")
