"""Paths: globs, normal form, ancestors."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str, escapes: bool = False) -> str:
    """A glob as a regular expression for whole paths: ``*`` and ``?`` stay in a segment, ``**/`` spans any number.

    A glob without ``/`` matches any one segment. With ``escapes`` a backslash takes the next character as it is.
    """
    out, i = [], 0
    while i < len(glob):
        if escapes and glob[i] == "\\" and i + 1 < len(glob):
            out.append(re.escape(glob[i + 1]))
            i += 2
        elif glob.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif glob[i] == "*":
            out.append("[^/]*")
            i += 1
        elif glob[i] == "?":
            out.append("[^/]")
            i += 1
        elif glob[i] == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            i = end + 1
        else:
            out.append(re.escape(glob[i]))
            i += 1
    body = "".join(out)
    return f"^{body}$" if "/" in glob else f"^(?:.*/)?{body}(?:/.*)?$"


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def stem_of(name: Column) -> Column:
    """The name without its last extension; a name that only begins with a dot has none."""
    return F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")


def ancestors(path: Column) -> Column:
    """All directories above a path, from the top."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, F.least(i, F.size(parts) - 1)), "/"))


def normal_path(path: Column) -> Column:
    """Forward slashes, no empty or ``.`` segments, ``..`` taken back; null for absolute paths and for those that leave the root."""
    slashed = F.regexp_replace(path, r"\\", "/")
    start = F.array(F.lit("").cast("string"))
    folded = F.aggregate(
        F.split(slashed, "/", -1), start,
        lambda done, s: F.when((s == "") | (s == "."), done).when((s == "..") & (F.size(done) > 1), F.slice(done, F.lit(1), F.size(done) - 1)).when(s == "..", F.array(F.lit("!"))).otherwise(F.concat(done, F.array(s))),
    )
    bad = slashed.startswith("/") | slashed.rlike("^[A-Za-z]:") | (F.element_at(folded, 1) == "!")
    return F.when(~bad, F.array_join(F.slice(folded, F.lit(2), F.greatest(F.size(folded) - 1, F.lit(0))), "/"))
