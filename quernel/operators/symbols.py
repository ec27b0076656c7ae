"""Declaration search: identifier tokens, ranks, identities and their resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.operators.bounded import capped

KIND_ORDER = ["rank", "path", "name", "id"]


#: Where words of an identifier part: before an upper-case letter after a lower-case one, before the last of several that
#: goes on in lower case, and at signs that are neither letters nor digits.
PARTING = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|[^\p{L}\p{Nd}]+"


def tokens(name: Column) -> Column:
    """Words of an identifier in lower case."""
    return F.transform(F.filter(F.split(name, PARTING, -1), lambda x: x != ""), F.lower)


def rank_of(name: Column, qualified: Column, query: Column) -> Column:
    """0 qualified name, 1 name, 2 either in other letter case, 3 name begins, 4 tokens or acronym, 5 name holds; else null.

    Several words match if each begins some token; one word also as a beginning of the acronym.
    """
    q, low, t, asked = F.lower(query), F.lower(name), tokens(name), tokens(query)
    every = (F.size(asked) > 0) & F.forall(asked, lambda w: F.exists(t, lambda x: F.startswith(x, w)))
    by_acronym = (F.size(asked) <= 1) & F.startswith(acronym(name), q)
    return (
        F.when(qualified == query, 0).when(name == query, 1).when((low == q) | (F.lower(qualified) == q), 2)
        .when(F.startswith(low, q), 3).when(every | by_acronym, 4).when(F.contains(low, q), 5)
    )


def acronym(name: Column) -> Column:
    return F.array_join(F.transform(tokens(name), lambda x: F.left(x, F.lit(1))), "")


def rank(name: Column, qualified: Column, query: str) -> Column:
    return rank_of(name, qualified, F.lit(query))


def search_symbols(declarations: DataFrame, query: str) -> DataFrame:
    """Declarations (name, qualified, ...) that match, with ``rank``."""
    return declarations.withColumn("rank", rank(F.col("name"), F.col("qualified"), query)).where("rank IS NOT NULL")


def best_tier(ranked: DataFrame) -> DataFrame:
    """Rows of the least rank only."""
    least = ranked.agg(F.min("rank").alias("least"))
    return ranked.join(F.broadcast(least), F.col("rank") == F.col("least")).drop("least")  # one row


# The kinds and accessibilities that can be asked for.
KINDS = ("namespace", "class", "struct", "interface", "record", "enum", "delegate", "method", "constructor", "destructor", "property", "indexer", "event", "field", "enum-member", "operator", "conversion-operator")
ACCESSIBILITIES = ("public", "internal", "protected", "private", "protected-internal", "private-protected", "file", "not-applicable")


def _closed(name: str, values: list[str], allowed: tuple[str, ...]) -> list[str]:
    unknown = sorted(set(values) - set(allowed))
    if unknown:
        raise ValueError(f"unknown {name} {unknown}; there are {list(allowed)}")
    return list(dict.fromkeys(values))


def in_namespace(namespace: Column, wanted: str) -> Column:
    """The namespace itself and those below it."""
    return (namespace == wanted) | namespace.startswith(wanted + ".")


def filtered(
    declarations: DataFrame, kinds: list[str] = (), accessibilities: list[str] = (), namespace: str | None = None, projects: list[str] = (),
    include_tests: bool = True, include_generated: bool = True,
) -> DataFrame:
    """Declarations of any of the kinds and accessibilities, in a namespace, of any of the projects (``owning_projects``), without tests or generated code if unwanted."""
    out = declarations
    if kinds:
        out = out.where(F.col("kind").isin(_closed("kinds", kinds, KINDS)))
    if accessibilities:
        out = out.where(F.col("accessibility").isin(_closed("accessibilities", accessibilities, ACCESSIBILITIES)))
    if namespace is not None:
        out = out.where(in_namespace(F.col("namespace"), namespace))
    if projects:
        out = out.where(F.arrays_overlap("owning_projects", F.array(*[F.lit(p) for p in projects])))
    if not include_tests:
        out = out.where(~F.col("is_test"))
    return out if include_generated else out.where(~F.col("is_generated"))


def resolve(requests: DataFrame, declarations: DataFrame) -> DataFrame:
    """(request, state, matches) of ids (request, name, stable, exact) among declarations (name, stable, exact).

    An exact id wins, else the only one with the same stable part; several are
    ambiguous, none but the name is stale, nothing is not found. Declarations are
    counted by name, stable part and id before they meet the requests.
    """
    def counted(*keys: str, name: str) -> DataFrame:
        return declarations.groupBy(*keys).agg(F.count("*").alias(name))

    met = requests.join(counted("name", name="n_named"), "name", "left").join(counted("name", "stable", name="n_same"), ["name", "stable"], "left").join(counted("name", "exact", name="n_exact"), ["name", "exact"], "left")
    n = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    exact, same, named = n("n_exact"), n("n_same"), n("n_named")
    state = F.when((exact == 1) | (same == 1), "resolved").when(same > 1, "ambiguous").when(named > 0, "stale").otherwise("not_found")
    return met.select("request", state.alias("state"), F.when(exact == 1, 1).when(same > 0, same).otherwise(named).cast("long").alias("matches"))


def replacements(resolved: DataFrame, requests: DataFrame, declarations: DataFrame, most: int = 20) -> DataFrame:
    """(request, id, place, total, omitted): for stale and ambiguous requests the first declarations of the same name, by id.

    A name's first declarations are taken once, before requests meet them.
    """
    wanted = resolved.where(F.col("state").isin("stale", "ambiguous")).join(requests.select("request", "name"), "request")
    few = capped(declarations.select("name", "id"), ["name"], ["id"], most)
    return wanted.select("request", "name").join(few, "name").select("request", "id", "place", "total", "omitted")


def siblings(declarations: DataFrame, parent: str, name: str) -> DataFrame:
    """(parent, name, overloads): declarations that share parent and name."""
    return declarations.groupBy(parent, name).agg(F.count("*").alias("overloads"))
