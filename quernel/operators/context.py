"""Context of one declaration: what it is, who owns it, its lines and its file's outline, under one budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.operators.bounded import whole_sections
from quernel.operators.text import TERMINATOR, line_span


def show_symbol(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Declarations with their text, documentation and counts of what is around them.

    (path, kind, name, container, body, documentation, lines, overloads, attributes,
    modifiers, parameters, type_parameters, members, bases). ``facts`` as
    ``csharp.syntax_facts`` gives them; overloads share file, container, kind and
    name, members are one level below.
    """
    declared = facts.where(~F.col("kind").isin("invocation", "object_creation", "catch"))
    body = F.col("text").substr(F.col("start") + 1, F.col("length"))
    # commas that part parameters, not those of type arguments
    flat = F.regexp_replace(F.regexp_replace("signature", "<[^<>]*>", ""), "<[^<>]*>", "")
    parameters = F.when(F.length("signature") <= 2, 0).otherwise(F.size(F.split(flat, ",", -1)))
    met = declared.join(files.select("path", "text").hint("merge"), "path")  # texts are too large to broadcast, however few bytes their table has
    return met.select(
        "path", "kind", "name", "container", body.alias("body"), "documentation", F.size(F.split(body, TERMINATOR, -1)).alias("lines"), "overloads",
        F.size("attributes").alias("attributes"), F.size("modifiers").alias("modifiers"), parameters.alias("parameters"), "type_parameters",
        "members", F.size("bases").alias("bases"),
    )


def show_document(files: DataFrame, path: str, first: int | None = None, last: int | None = None, budget: int = 1000, expected: str | None = None) -> DataFrame:
    """(path, status, first_line, last_line, text, omitted, content_hash): a document's span.

    With ``expected``, the hash that an earlier answer told, a text that changed since has the status "changed" and no text.
    """
    one = files.where(F.col("path") == path)
    span = line_span(one, first or 1, last or (1 << 30), budget).join(one.select("path", F.sha2("text", 256).alias("content_hash")), "path")
    if expected is None:
        return span
    same = F.col("content_hash") == expected
    kept = [F.when(same, F.col(c)).alias(c) for c in ("first_line", "last_line", "text", "omitted")]
    return span.select("path", F.when(same, F.col("status")).otherwise("changed").alias("status"), *kept, "content_hash")


def missing_sections(requested: list[str], available: list[str]) -> list[str]:
    """Asked-for section names that there are none of, in the order asked."""
    return [s for s in dict.fromkeys(requested) if s not in set(available)]


def sections(shown: DataFrame, owners: DataFrame, outline: DataFrame) -> DataFrame:
    """(path, name, priority, section, text): declaration, owner, document and outline of each shown declaration."""
    one = shown.select("path", "name", "kind", "body", "lines")
    declaration = one.select("path", "name", F.lit(0).alias("priority"), F.lit("declaration").alias("section"), F.concat_ws(" ", "kind", "name").alias("text"))
    owned = one.join(owners.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("project")), ",").alias("text")), "path")
    owner = owned.select("path", "name", F.lit(1).alias("priority"), F.lit("owner").alias("section"), "text")
    document = one.select("path", "name", F.lit(2).alias("priority"), F.lit("document").alias("section"), F.col("body").alias("text"))
    listed = outline.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "kind", "name"))), lambda x: F.concat_ws(" ", x["kind"], x["name"])), "\n").alias("text"))
    outlined = one.join(listed, "path").select("path", "name", F.lit(3).alias("priority"), F.lit("outline").alias("section"), "text")
    return declaration.unionByName(owner).unionByName(document).unionByName(outlined)


def context(all_sections: DataFrame, budget: int) -> DataFrame:
    """(path, name, included, omitted, used): whole sections by priority that fit the budget of characters."""
    return whole_sections(all_sections.withColumn("chars", F.length("text")), ["path", "name"], ["priority", "section"], "chars", budget)
