"""Bounded results as text: JSON columns on the cluster, and a compact table text for rows in hand."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_./ -]*")


def as_json(df: DataFrame) -> DataFrame:
    """One column ``json`` with each row as an object; nulls are written."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def _value(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v)
    text = v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    if _PLAIN.fullmatch(text) and text.strip() == text and text not in ("true", "false", "null"):
        return text
    return json.dumps(text, ensure_ascii=False)


def table_text(name: str, columns: list[str], rows: Iterable) -> str:
    """``name[n]{columns}:`` and a line of values for each row, which are few by then."""
    lines = ["  " + ",".join(_value(r[c]) for c in columns) for r in rows]
    return "\n".join([f"{name}[{len(lines)}]{{{','.join(columns)}}}:", *lines])
