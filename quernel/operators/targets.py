"""Many targets at once: which declarations each means, by an inverted index of their names.

Targets meet declarations by equality only: of whole names, of the beginnings of
words and acronyms, of three-letter pieces. For each target the piece or word that
the fewest declarations have finds its candidates, and the rank is worked out for
those. Targets that one tier settles don't go on to the next. What a batch means
is told by classes of declarations that nothing tells apart; a target's
declarations are counted, not listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions.checkpoint import cut
from quernel.functions.identity import framed, parsed_symbol_id
from quernel.operators.bounded import capped
from quernel.operators.semantics import same_symbol
from quernel.operators.symbols import acronym, rank_of, tokens

PIECE = 3
#: The kinds of identities that name something other than a declaration.
OTHER_IDS = r"^(file|text|syntax|reference|implementation)/q[0-9]+:"
#: Names of matches up to which they are broadcast, so that declarations of other names aren't shuffled.
FEW_NAMES = 10_000


def forms(targets: DataFrame) -> DataFrame:
    """(target, form, parsed): "id" of a symbol identity, "unsupported" of another kind or version, "blank", else "query"."""
    t = F.col("target")
    form = F.when(F.trim(t) == "", "blank").when(F.col("parsed").isNotNull(), "id").when(t.rlike(OTHER_IDS) | t.startswith("symbol/"), "unsupported").otherwise("query")
    return targets.where("target IS NOT NULL").select("target").distinct().withColumn("parsed", parsed_symbol_id(t)).select("target", form.alias("form"), "parsed")


def _pieces(text: Column, size: Column) -> Column:
    """The distinct pieces of ``size`` letters of a text; none of a shorter one."""
    last = F.length(text) - size + 1
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, size))))


def _rarest(asked: DataFrame, index: DataFrame) -> DataFrame:
    """(target, id): for each target (target, k) the ids (k, id) of that of its keys that has the fewest; none if one has none."""
    counts = index.join(asked.select("k").distinct(), "k", "left_semi").groupBy("k").agg(F.count("*").alias("n"))
    best = asked.join(counts, "k", "left").groupBy("target").agg(F.min_by("k", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "k")).alias("k"))
    return best.join(index, "k").select("target", "id")  # the ids of other keys are only counted


def _lengths(words: DataFrame, column: str) -> list[int]:
    """The lengths that the words of targets have; names have a bounded number of them."""
    return sorted(r[0] for r in words.select(F.length(column)).distinct().collect() if r[0])


def _beginnings(text: Column, lengths: list[int]) -> Column:
    return F.filter(F.array(*[F.when(F.length(text) >= n, F.left(text, F.lit(n))) for n in lengths] or [F.lit(None).cast("string")]), lambda x: x.isNotNull())


def ranked_names(queries: DataFrame, declarations: DataFrame) -> DataFrame:
    """(target, name, qualified, rank): the names of declarations (id, name, qualified) of the best rank that each query (target) has, as ``rank_of`` gives it."""
    queries = cut(queries.select("target").distinct().withColumn("q", F.lower("target")))
    # declarations that share their names match alike: one of each stands for all until the end
    names = cut(declarations.groupBy("name", "qualified").agg(F.min("id").alias("id")).select("id", "name", "qualified"))
    low = names.select("id", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("qualified")))).alias("q"))
    found = []

    def settle(pairs: DataFrame, asked: DataFrame) -> DataFrame:
        ranks = pairs.distinct().join(names, "id").withColumn("rank", rank_of(F.col("name"), F.col("qualified"), F.col("target"))).where("rank IS NOT NULL")
        best = ranks.groupBy("target").agg(F.min("rank").alias("best"))
        found.append(cut(ranks.join(best, "target").where("rank = best").select("target", "name", "qualified", "rank")))
        return cut(asked.join(found[-1].select("target").distinct(), "target", "left_anti"))

    left = settle(queries.join(low, "q").select("target", "id"), queries)  # equal names
    for tier in ("beginnings", "words", "pieces"):
        if not left.take(1):
            break
        if tier == "beginnings":
            asked = left.select("target", F.col("q").alias("k"))
            ids = names.select("id", F.explode(_beginnings(F.lower("name"), _lengths(left, "q"))).alias("k"))
            pairs = asked.join(ids, "k").select("target", "id")
        elif tier == "words":
            words = cut(left.select("target", F.explode(F.array_distinct(tokens(F.col("target")))).alias("k")))
            held = names.select("id", F.explode(F.array_distinct(F.flatten(F.transform(tokens(F.col("name")), lambda w: _beginnings(w, _lengths(words, "k")))))).alias("k"))
            short = names.select("id", F.explode(_beginnings(acronym(F.col("name")), _lengths(left, "q"))).alias("q"))
            pairs = _rarest(words, held).unionByName(left.join(short, "q").select("target", "id"))
        else:
            size = F.least(F.length("q"), F.lit(PIECE))
            asked = cut(left.select("target", F.explode(_pieces(F.col("q"), size)).alias("k")))
            grams = F.array_distinct(F.flatten(F.array(*[_pieces(F.lower("name"), F.lit(n)) for n in _lengths(asked, "k")] or [F.array().cast("array<string>")])))
            pairs = _rarest(asked, names.select("id", F.explode(grams).alias("k")))
        left = settle(pairs, left)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _named(names: DataFrame, declarations: DataFrame) -> DataFrame:
    """The columns of ``names`` (name, qualified, ...) and of the declarations of just these names."""
    alike = F.col("d.name").eqNullSafe(F.col("m.name")) & F.col("d.qualified").eqNullSafe(F.col("m.qualified"))
    # a compressed table of few bytes has more declarations than a driver should hold, so they are never broadcast
    return declarations.alias("d").hint("merge").join(names.alias("m"), alike).drop(F.col("m.name"), F.col("m.qualified"))


def ranked_matches(queries: DataFrame, declarations: DataFrame) -> DataFrame:
    """(target, id, rank): the declarations (id, name, qualified) of the best rank that each query (target) has, as ``rank_of`` gives it."""
    return _named(ranked_names(queries, declarations), declarations.select("id", "name", "qualified")).select("target", "id", "rank")


def id_matches(ids: DataFrame, declarations: DataFrame) -> DataFrame:
    """(target, id, rank): declarations (id, name, stable, location) of identities (target, parsed): those at the very place, else all of the same stable part."""
    asked = ids.select("target", F.col("parsed.name").alias("name"), F.col("parsed.stable").alias("stable"), F.col("parsed.location").alias("place"))
    met = asked.join(declarations.select("id", "name", "stable", "location").hint("merge"), ["name", "stable"])
    met = met.select("target", "id", F.when(F.col("place") == F.col("location"), 0).otherwise(1).alias("rank"))
    best = met.groupBy("target").agg(F.min("rank").alias("best"))
    return met.join(best, "target").where("rank = best").select("target", "id", "rank")


def _place(name: Column, stable: Column, location: Column) -> Column:
    """What a declaration is and where, as one hash; null where a part is."""
    whole = name.isNotNull() & stable.isNotNull() & location.isNotNull()
    return F.when(whole, F.unhex(F.sha2(F.concat(framed(name), framed(stable), framed(location)), 256)))


def _classes(declarations: DataFrame, variants: DataFrame, places: DataFrame) -> DataFrame:
    """(name, qualified, stable, links, alone, place, first, n): declarations alike in all of these as one row with their number and least id.

    ``links`` are the symbols that a declaration resolves to, with their variants, and
    null where it resolves in none; one without a link is ``alone``, by its id. Only
    ``places`` (place) that are asked for part declarations.
    """
    d = declarations.select("id", "name", "qualified", "stable", "source", _place(F.col("name"), F.col("stable"), F.col("location")).alias("place"))
    asked = places.select("place").distinct().withColumn("asked", F.lit(True))
    d = d.join(asked.hint("merge"), "place", "left").withColumn("place", F.when(F.col("asked"), F.col("place"))).drop("asked")
    # what a source's declarations resolve to is the same for all of them
    link = F.when(F.col("variant").isNotNull() & F.col("symbol").isNotNull(), F.struct("variant", "symbol"))
    bound = variants.where("status = 'resolved'").select(F.explode("sources").alias("source"), link.alias("link"))
    bound = bound.groupBy("source").agg(F.array_sort(F.collect_set("link")).alias("links"))
    seen = d.join(bound.hint("merge"), "source", "left").withColumn("alone", F.when(F.size("links") == 0, F.col("id")))
    return seen.groupBy("name", "qualified", "stable", "links", "alone", "place").agg(F.min("id").alias("first"), F.count("*").alias("n"))


def _of_names(declarations: DataFrame, names: DataFrame) -> DataFrame:
    """The declarations of ``names`` (name), or all where these are many."""
    names = cut(names.select("name").distinct())
    if names.count() > FEW_NAMES:
        return declarations
    return declarations.alias("d").join(F.broadcast(names.alias("w")), F.col("d.name").eqNullSafe(F.col("w.name")), "left_semi")


def resolve_batch(targets: DataFrame, declarations: DataFrame, variants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each of many targets means: (target, form, status, candidates, groups), and their matches (target, id, rank).

    ``declarations`` are those in scope: id (its own for each), name, qualified, stable,
    location, source, owner; ``variants`` as in ``states_of``. A target is an identity, a
    qualified name or a query; matches of the best rank are its candidates. One symbol is
    resolved, several are ambiguous, none in any variant is unresolved. An identity that
    nothing has any more is stale, a query without a match not found; blank targets and
    identities of other things are unsupported.

    Targets times declarations may be more than any disk holds, so targets meet classes
    of declarations, and matches are worked out only where they are read.
    """
    asked = cut(forms(targets).select("target", "form", F.monotonically_increasing_id().alias("key")))
    queries = asked.where("form = 'query'")
    parsed = asked.where("form = 'id'").withColumn("parsed", parsed_symbol_id(F.col("target")))
    ids = parsed.select("key", "parsed.name", "parsed.stable", _place(F.col("parsed.name"), F.col("parsed.stable"), F.col("parsed.location")).alias("place"))
    names = ranked_names(queries, declarations)
    declarations = _of_names(declarations, names.select("name").unionByName(ids.select("name")))
    cells = cut(_classes(declarations, variants, ids))
    alike = cut(cells.groupBy("name", "qualified", "stable", "links", "alone").agg(F.min("first").alias("first"), F.sum("n").alias("n")))
    there = cells.where("place IS NOT NULL").select("place", "first", "n", "links")
    told = ["key", "first", "n", "links"]
    met = _named(names.join(queries.select("target", "key"), "target").select("key", "name", "qualified"), alike).select(*told)
    met = met.unionByName(ids.join(there, "place").select(*told))
    elsewhere = ids.join(there.select("place").distinct(), "place", "left_anti").select("key", "name", "stable")
    met = cut(met.unionByName(elsewhere.join(alike, ["name", "stable"]).select(*told)))
    counts = met.groupBy("key").agg(F.sum("n").alias("candidates"), F.count("links").alias("classes"))
    several = met.where("links IS NOT NULL").join(counts.where("classes > 1").select("key"), "key", "left_semi")
    states = several.select(F.col("key").alias("target"), F.col("first").alias("candidate"), F.lit("resolved").alias("status"), F.explode_outer("links").alias("link"))
    parts = same_symbol(states.select("target", "candidate", "status", "link.variant", "link.symbol")).groupBy(F.col("target").alias("key")).agg(F.countDistinct("grouping").alias("groups"))
    out = asked.join(counts, "key", "left").join(parts, "key", "left")  # what is of one class is one group
    n, g = F.coalesce("candidates", F.lit(0).cast("long")), F.coalesce("groups", "classes", F.lit(0).cast("long"))
    status = (
        F.when(F.col("form").isin("unsupported", "blank"), "unsupported").when((n == 0) & (F.col("form") == "id"), "stale").when(n == 0, "not_found")
        .when(g == 1, "resolved").when(g > 1, "ambiguous").otherwise("unresolved")
    )
    every = _named(names, declarations.select("id", "name", "qualified")).select("target", "id", "rank").unionByName(id_matches(parsed, declarations))
    return out.select("target", "form", status.alias("status"), n.alias("candidates"), g.alias("groups")), every


def replaced(resolved: DataFrame, targets: DataFrame, declarations: DataFrame, most: int = 20) -> DataFrame:
    """(target, id, place, total, omitted): for stale identities the first declarations that still have their name."""
    stale = forms(targets).join(resolved.where("status = 'stale'").select("target"), "target", "left_semi").select("target", F.col("parsed.name").alias("name"))
    few = capped(declarations.select("name", "id").join(stale.select("name").distinct(), "name", "left_semi"), ["name"], ["id"], most)
    return stale.join(few, "name").select("target", "id", "place", "total", "omitted")
