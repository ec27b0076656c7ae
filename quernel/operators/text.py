"""Search in texts: literal and regular expressions with exact places, line spans, skip counts, evidence.

A text is searched whole, on the JVM. One replacement writes a mark that the text
doesn't hold around every match; the pieces between marks are, in turn, text and
match, and running sums of their lengths give each match's offset. A binary
search in the offsets at which lines start gives its line. Only patterns that may
backtrack without end go to a matcher with a deadline for each file.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from functools import lru_cache
from re import _parser as patterns

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.operators import evidence
from quernel.operators.bounded import early_stop, utf16_order

TERMINATOR = "\r\n|\n|\r"
#: The places after terminators.
LINE_STARTS = r"(?<=\n)|(?<=\r)(?!\n)"
PREVIEW = 160
#: Characters that are in no text of a language; a mark is the first of them that a text doesn't hold.
MARKS = [chr(c) for c in range(0xFDD0, 0xFDF0)]


def lines(files: DataFrame) -> DataFrame:
    """(path, line, content): lines from 1; CR, LF and CRLF end a line."""
    split = files.select("path", F.posexplode(F.split("text", TERMINATOR, -1)).alias("at", "content"))
    return split.select("path", (F.col("at") + 1).alias("line"), "content")


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def preview(content: Column, start: Column, width: int = PREVIEW) -> Column:
    """At most ``width`` characters around a place, with marks where text is left out; a blank line gives the mark alone."""
    first = F.greatest(F.lit(0), F.least(start - width // 2, F.length(content) - width))
    part = content.substr(first + 1, F.lit(width))
    cut = F.concat(F.when(first > 0, "…").otherwise(""), part, F.when(first + width < F.length(content), "…").otherwise(""))
    return F.when(F.trim(content) == "", "…").otherwise(cut)


@lru_cache(maxsize=1)
def _same_letters() -> dict[str, str]:
    """All characters of each simple upper case that has several."""
    found: dict[str, str] = {}
    for c in map(chr, range(0x110000)):
        found[_upper(c)] = found.get(_upper(c), "") + c
    return {u: cs for u, cs in found.items() if len(cs) > 1}


def _upper(c: str) -> str:
    """A character's simple upper case; dotless i and long s stay, as in a comparison by ordinals."""
    if c in "\u0131\u017f":
        return c
    return next((u for u in (c.upper(), c.title()) if len(u) == 1), c)


def _alike(c: str) -> str:
    if c < "\x80":
        return "".join(sorted({c.lower(), c.upper()}))
    return _same_letters().get(_upper(c), c)


def quoted(query: str, case_sensitive: bool) -> str:
    """A literal as a Java pattern. Letter case is folded character by character as ordinal comparison does, so a match is as long as the query."""
    code = lambda c: c if c.isascii() and c.isalnum() else f"\\x{{{ord(c):x}}}"
    if case_sensitive:
        return "".join(map(code, query))
    return "".join(code(c) if len(_alike(c)) == 1 else f"[{''.join(map(code, _alike(c)))}]" for c in query)


def holding(files: DataFrame, query: str, case_sensitive: bool = False) -> DataFrame:
    """Files whose text holds ``query``: the filter that runs before places are worked out."""
    return files.where(F.col("text").contains(query) if case_sensitive else F.col("text").rlike(quoted(query, False)))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once. A column named in a lambda would be put in its place there, and worked out for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(lengths: Column, block: int = 256) -> Column:
    """The sum of what stands before each number of an array, and of all; by blocks, so that a long array isn't copied for each of its numbers."""

    def before(numbers: Column) -> Column:
        begin = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("at"))
        return F.aggregate(numbers, begin, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["at"], F.array(a["sum"])).alias("at")))

    def summed(parts: Column, sums: Column) -> Column:
        moved = F.zip_with(parts, sums["at"], lambda part, s: F.transform(part["at"], lambda y: y + s))
        return F.concat(F.flatten(moved), F.array(sums["sum"]))

    def blocks(xs: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)), F.lit(block))
        return F.transform(starts, lambda i: before(F.slice(xs, i + 1, F.lit(block))))

    return let(lengths, lambda xs: let(blocks(xs), lambda parts: let(before(F.transform(parts, lambda p: p["sum"])), lambda sums: summed(parts, sums))))


def _line_of(starts: Column, offset: Column) -> Column:
    """How many of the sorted ``starts`` are not beyond an offset, by halving."""
    span = F.struct(F.lit(0).alias("lo"), F.size(starts).alias("hi"))

    def half(s, _):
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        right = (s["lo"] < s["hi"]) & (F.get(starts, mid) <= offset)
        return F.struct(F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(right, s["hi"]).otherwise(F.greatest(mid, s["lo"])).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(starts) + 1)).cast("int"))
    return F.aggregate(steps, span, half, lambda s: s["lo"])


#: Matches of a text up to which each is placed by what stands before it; of more, by running sums over the text.
FEW = 16

MATCH = "array<struct<line: int, column: int, start: bigint, match: string, preview: string>>"


def located(files: DataFrame, pattern: str, most: int | None = None) -> DataFrame:
    """``files`` with ``found``: the matches of a Java pattern in the whole text, in order, the first ``most`` of them.

    ``line`` and ``column`` (UTF-16 units) count from 1, ``start`` is the offset in
    UTF-16 units; a match of nothing counts. A text without a match has an empty
    array, a null text too. A text that holds all 32 marks is an error.
    """
    text = F.col("text")
    wide = lambda xs: F.transform(xs, lambda x: utf16_length(x).cast("long"))
    mark = F.coalesce(*[F.when(~F.contains(text, F.lit(m)), F.lit(m)) for m in MARKS], F.raise_error(F.lit("a text holds every mark")))

    def told(h: Column, starts: Column, lines_: Column) -> Column:
        line = h["line"]
        return let(F.struct(F.get(lines_, line - 1).alias("content"), (h["start"] - F.get(starts, line - 1)).alias("column"), utf16_length(F.get(lines_, line - 1)).alias("width")), lambda at: match(h, at))

    def match(h: Column, at: Column) -> Column:
        ended = at["column"] > at["width"]  # between a carriage return and its line feed: the next line has begun
        content = F.when(ended, F.lit("")).otherwise(at["content"])
        shown = let(F.struct(content.alias("c"), _scalars(at["content"], at["width"], at["column"]).alias("s")), lambda x: preview(x["c"], x["s"]))
        return F.struct(
            (h["line"] + ended.cast("int")).alias("line"), (F.when(ended, F.lit(0)).otherwise(at["column"]) + 1).cast("int").alias("column"),
            h["start"].alias("start"), h["match"].alias("match"), shown.alias("preview"),
        )

    def placed(pieces: Column, at: Column, starts: Column, lines_: Column) -> Column:
        odd = F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2))  # text and match in turn
        hits = F.transform(odd if most is None else F.slice(odd, F.lit(1), F.lit(most)), lambda i: F.struct(F.get(pieces, i).alias("match"), F.get(at, i).alias("start")))
        lined = F.transform(hits, lambda h: F.struct(h["match"].alias("match"), h["start"].alias("start"), _line_of(starts, h["start"]).alias("line")))
        return F.transform(lined, lambda h: told(h, starts, lines_))

    def near(pieces: Column) -> Column:
        odd = F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2))
        return F.transform(odd if most is None else F.slice(odd, F.lit(1), F.lit(most)), lambda i: let(F.array_join(F.slice(pieces, F.lit(1), i), ""), lambda before: by_prefix(F.get(pieces, i), before)))

    def by_prefix(matched: Column, before: Column) -> Column:
        line = F.octet_length(before) - F.octet_length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
        tail = F.substring_index(before, "\n", -1)
        content = F.concat(tail, F.substring_index(F.substring(text, F.length(before) + 1, F.lit((1 << 31) - 1)), "\n", 1))
        shown = let(F.struct(content.alias("c"), F.length(tail).alias("s")), lambda x: F.struct(x["s"].alias("s"), preview(x["c"], x["s"]).alias("p")))
        told_ = lambda x: F.struct(line.cast("int").alias("line"), (x["s"] + 1).cast("int").alias("column"), F.length(before).cast("long").alias("start"), matched.alias("match"), x["p"].alias("preview"))
        return let(shown, told_)

    def far(pieces: Column) -> Column:
        starts = running(wide(F.split(text, LINE_STARTS, -1)))  # the last number is where the text ends, which begins no line
        return let(running(wide(pieces)), lambda at: let(starts, lambda ss: let(F.split(text, TERMINATOR, -1), lambda ls: placed(pieces, at, F.slice(ss, F.lit(1), F.size(ss) - 1), ls))))

    # a text of line feeds only whose characters are a unit each needs no running sums for a few matches
    plain = ~F.contains(text, F.lit("\r")) & (utf16_length(text) == F.length(text))
    at_once = -1 if most is None else 2 * max(most, 1) + 1  # what is left of the text then is one piece
    pieces = let(mark, lambda m: F.split(F.regexp_replace(text, F.lit(pattern), F.concat(m, F.lit("$0"), m)), m, at_once))
    found = let(pieces, lambda ps: F.when((F.size(ps) <= 2 * FEW + 1) & plain, near(ps)).otherwise(far(ps)))
    return files.select("*", F.when(text.rlike(pattern), found).otherwise(F.array().cast(MATCH)).alias("found"))


def _scalars(content: Column, width: Column, units: Column) -> Column:
    """How many characters the first ``units`` UTF-16 units of a line of ``width`` are; half a surrogate pair isn't one."""

    def cut(coded: Column) -> Column:
        half = F.hex(F.substring(coded, (units * 2 - 1).cast("int"), F.lit(1))).between("D8", "DB") & (units > 0)
        return F.length(F.decode(F.substring(coded, F.lit(1), (units * 2 - F.when(half, 2).otherwise(0)).cast("int")), "UTF-16BE"))

    return F.when(width == F.length(content), units.cast("int")).otherwise(let(F.encode(content, "UTF-16BE"), cut))


def _rows(found: DataFrame) -> DataFrame:
    """(path, line, column, match, preview) for each of ``found``."""
    return found.select("path", F.explode("found").alias("x")).select("path", "x.line", "x.column", "x.match", "x.preview")


def search_literal(files: DataFrame, query: str, case_sensitive: bool = False) -> DataFrame:
    """Every non-overlapping occurrence of ``query``: (path, line, column, match, preview).

    A query may hold line ends; its match then begins in the line that is told.
    Columns count UTF-16 units from 1. Null texts have no matches.
    """
    if not query:
        raise ValueError("the query is empty")
    return _rows(located(holding(files, query, case_sensitive).select("path", "text"), quoted(query, case_sensitive)))


def required_literal(pattern: str) -> str | None:
    """The longest run of characters that every match of a case-sensitive pattern holds; None if none can be told."""
    try:
        parsed = patterns.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    best, flags = "", parsed.state.flags

    def runs(items) -> None:
        nonlocal best
        run = ""
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                run += chr(arg)
            else:
                best, run = max(best, run, key=len), ""
                if name == "SUBPATTERN" and not arg[1]:
                    runs(arg[3])
                elif name == "ATOMIC_GROUP":
                    runs(arg)
                elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
                    runs(arg[2])
        best = max(best, run, key=len)

    if not flags & (re.I | re.X):
        runs(parsed)
    return best or None


def may_hang(pattern: str) -> bool:
    """Whether a pattern repeats without bound what itself repeats or branches, or refers back: matching may then take time beyond any power of the text."""
    bare = re.sub(r"\\Q.*?\\E", "x", pattern, flags=re.S)
    if re.search(r"\\[1-9]|\\k<", bare):
        return True
    bare = re.sub(r"\\[xpP]\{[^}]*\}|\\.", "x", bare, flags=re.S)
    bare = re.sub(r"\[\^?\]?(?:[^\[\]]|\[[^\]]*\])*\]", "x", bare)
    groups, last = [False], False
    for m in re.finditer(r"\((\?(?:[:=!>]|<[=!]|<\w+>|[a-zA-Z-]*:))?|\)|\||[*+]\+?\??|\{\d+(?:,\d*)?\}[+?]?|.", bare, re.S):
        token = m[0]
        if token[0] == "(":
            groups.append(False)
        elif token == ")":
            last = groups.pop() if len(groups) > 1 else False
            groups[-1] |= last
            continue
        elif token == "|":
            groups[-1] = True
        elif token[0] in "*+" or re.match(r"\{\d+,\}", token) or (token[0] == "{" and int(re.match(r"\{(?:\d+,)?(\d+)", token + "0}")[1] or 0) > 1000):
            if last:
                return True
            groups[-1] = True
        last = False
    return False


def java_pattern(pattern: str, case_sensitive: bool = True) -> str:
    """A pattern under the engine's rules: only a line feed ends a line for ``.``, ``^`` and ``$``, which go by the whole text."""
    return ("(?d)" if case_sensitive else "(?diu)") + pattern


def check_pattern(files: DataFrame, pattern: str) -> None:
    """An error where the pattern is broken, before anything is searched."""
    session = files.sparkSession
    try:
        session._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:
        raise ValueError(f"the regular expression is invalid: {pattern}") from e


def regex_files(files: DataFrame, pattern: str, case_sensitive: bool = True, deadline: float = 1.0, most: int | None = None) -> DataFrame:
    """The columns of every file but its text, with status and found: "analyzed", or "regular_expression_timeout" and no matches, or "no_text" of a null text.

    Matches are those of ``located`` in Java's dialect. A pattern that ``may_hang``
    is matched in Python's ``regex`` under ``deadline`` seconds a file; the others go on.
    """
    pattern_ = java_pattern(pattern, case_sensitive)
    check_pattern(files, pattern_)
    if may_hang(pattern):
        return _under_deadline(files, pattern, re.I if not case_sensitive else 0, deadline, most)
    literal = required_literal(pattern) if case_sensitive else None
    seen = files.withColumn("status", F.when(F.col("text").isNull(), "no_text").otherwise("analyzed"))
    if literal:  # a text without it has no match, which a search for it tells sooner
        seen = seen.withColumn("text", F.when(F.col("text").contains(literal), F.col("text")))
    return located(seen, pattern_, most).drop("text")


def search_regex(files: DataFrame, pattern: str, case_sensitive: bool = True, deadline: float = 1.0) -> DataFrame:
    """Every match of a pattern in whole texts: (path, line, column, match, preview); a match of nothing has the empty ``match``.

    ``^``, ``$``, ``\\A`` and ``\\z`` stand for the ends of the text, unless the pattern says ``(?m)``.
    Files that exceed the deadline give nothing here; ``search_evidence`` tells them.
    """
    literal = required_literal(pattern) if case_sensitive else None
    seen = files.where(F.col("text").contains(literal)) if literal else files
    return _rows(regex_files(seen, pattern, case_sensitive, deadline))


def _under_deadline(files: DataFrame, pattern: str, flags: int, deadline: float, most: int | None) -> DataFrame:
    import regex

    regex.compile(pattern, flags=flags)

    seen = files.withColumn("status", F.lit(None).cast("string")).withColumn("found", F.array().cast(MATCH))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder, ends = regex.compile(pattern, flags=flags), re.compile(TERMINATOR)
        known = None if LOOKS_BACK.search(pattern) else Endless(finder, deadline, most)
        for f in frames:
            told = [_outcome(finder, ends, text, deadline, most, known) for text in f["text"]]
            yield f.drop(columns="text").assign(status=[t[0] for t in told], found=[t[1] for t in told])

    return seen.mapInPandas(run, seen.drop("text").schema)


#: What makes an attempt at a place depend on more than the character before it.
LOOKS_BACK = re.compile(r"\(\?<[=!]|\\G")


class Endless:
    """Ends of texts at whose beginning a pattern is tried for longer than the deadline.

    A try at a place goes by what follows it and the character before it, if the
    pattern doesn't look back. So one that alone took longer than the deadline will
    in every text that ends alike, if the search comes to that place, and isn't
    repeated. What several tries take together says nothing of another text.
    """

    #: Ends that are kept, their characters, and how many may be looked for beyond those that were met again.
    MOST, CHARACTERS, SPARE = 256, 1 << 24, 4

    def __init__(self, finder, deadline: float, most: int | None) -> None:
        self.finder, self.deadline, self.most = finder, deadline, most
        self.tails: list[tuple[str, bool]] = []
        self.room, self.spare = self.CHARACTERS, self.SPARE

    def learn(self, text: str, begin: int) -> None:
        """Of a text whose search exceeded the deadline after ``begin``: the end whose first try alone does."""
        if len(self.tails) == self.MOST or not self.spare:
            return
        self.spare -= 1
        until = time.monotonic() + self.deadline
        for at in range(begin, len(text) + 1):
            if time.monotonic() > until:
                return
            try:
                self.finder.match(text, at, timeout=self.deadline)
            except TimeoutError:
                tail = text[max(at - 1, 0) :]
                if len(tail) <= self.room:
                    self.tails.append((tail, at == 0))
                    self.room -= len(tail)
                return

    def exceeds(self, text: str) -> bool:
        """Whether the search comes to a try that is known to exceed the deadline; False where that isn't told in time."""
        for tail, whole in self.tails:
            if text.endswith(tail) and (not whole or len(text) == len(tail)) and self._reached(text, 0 if whole else len(text) - len(tail) + 1):
                self.spare += 1
                return True
        return False

    def _reached(self, text: str, place: int) -> bool:
        at, found, until = 0, 0, time.monotonic() + self.deadline
        while at < place:
            left = until - time.monotonic()
            if left <= 0:
                return False
            try:
                m = self.finder.match(text, at, timeout=left)
            except TimeoutError:
                return False
            found += m is not None
            if m and (m.end() == at or (self.most is not None and found > self.most)):
                return False  # matches of nothing are left to the search itself
            at = m.end() if m else at + 1
        return at == place


def _outcome(finder, ends, text: str | None, deadline: float, most: int | None, known: Endless | None = None) -> tuple[str, list[dict]]:
    if text is None:
        return "no_text", []
    if known and known.exceeds(text):
        return "regular_expression_timeout", []
    begun = [0]
    try:
        return "analyzed", _found(finder, ends, text, deadline, most, begun)
    except TimeoutError:
        if known:
            known.learn(text, begun[0])
        return "regular_expression_timeout", []


def _found(finder, ends, text: str, deadline: float, most: int | None, begun: list[int]) -> list[dict]:
    """The matches; ``begun`` tells where the search for the next one began."""
    edges, stops = [0, *[m.end() for m in ends.finditer(text)]], [*[m.start() for m in ends.finditer(text)], len(text)]
    units = lambda a, b: len(text[a:b].encode("utf-16-le", "surrogatepass")) // 2
    rows, k, passed, seen = [], 0, 0, 0
    for m in finder.finditer(text, timeout=deadline):
        if len(rows) == most:
            break
        a, b = m.span()
        begun[0] = b
        passed, seen = passed + units(seen, a), a
        while k + 1 < len(edges) and edges[k + 1] <= a:
            k += 1
        line, begin = (k + 2, a) if a > stops[k] else (k + 1, edges[k])  # between a carriage return and its line feed
        content = text[begin : max(begin, stops[k])]
        first = max(0, min(a - begin - PREVIEW // 2, len(content) - PREVIEW))
        shown = "…" if not content.strip(" ") else "…" * (first > 0) + content[first : first + PREVIEW] + "…" * (first + PREVIEW < len(content))
        rows.append({"line": line, "column": units(begin, a) + 1, "start": passed, "match": text[a:b], "preview": shown})
    return rows


def search_evidence(files: DataFrame, query: str, limit: int, regex: bool = False, case_sensitive: bool = False, deadline: float = 1.0, root: str = ".", paths: list[str] = ()) -> DataFrame:
    """One row: ``rows`` (path, line, column, match, preview) in order, ``total``, ``total_known``, ``truncated``, counts by status and ``evidence``; one job reads the files once.

    ``files`` may have a ``status`` of their reading ("success" where null or absent);
    those with another are excluded, unreadable ones failed, and counted as skipped by
    their status. Of a file at most ``limit`` + 1 matches are located, as a search that
    stops there would: the total is known only if no match is left out and no file
    exceeded its deadline.
    """
    if not query or limit < 0:
        raise ValueError("the query is empty or the limit negative")
    read = F.coalesce(F.col("status"), F.lit("success")) if "status" in files.columns else F.lit("success")
    read = F.when((read == "success") & F.col("text").isNull(), "unreadable").otherwise(read)
    given = files.select("path", read.alias("read"), F.when(read == "success", F.col("text")).alias("text"))
    if regex:
        found = regex_files(given, query, case_sensitive, deadline, limit + 1)
    else:
        found = located(given, quoted(query, case_sensitive), limit + 1).withColumn("status", F.lit("analyzed"))
    status = F.when(F.col("read") != "success", F.col("read")).otherwise(F.col("status"))
    opened = found.select("path", status.alias("status"), F.posexplode_outer("found").alias("k", "x"))
    rows = opened.select("path", "x.line", "x.column", "x.match", "x.preview", "status", F.coalesce("k", F.lit(0)).alias("k"))
    one = F.col("k") == 0  # a file's first row stands for the file
    states = {n: one & (F.col("status") == n) for n in ("analyzed", "binary", "undecodable", "unsupported", "unreadable", "regular_expression_timeout")}
    order = [utf16_order("path"), F.asc("line"), F.asc("column")]
    out = evidence.one_pass(rows, order, limit, {"considered": one, **states}, F.col("line").isNotNull())
    late = F.col("regular_expression_timeout") > 0
    reason = F.when(late, evidence.TIMEOUT_REASON).when(F.col("total") > limit, evidence.LIMIT_REASON)
    excluded = F.col("considered") - F.col("analyzed") - F.col("unreadable") - F.col("regular_expression_timeout")
    covered = evidence.coverage(F.col("considered"), F.col("analyzed"), F.lit(0), excluded, F.col("unreadable") + F.col("regular_expression_timeout"), F.coalesce(reason, F.when(F.col("unreadable") > 0, "One or more files could not be read.")))
    known = (F.col("total") <= limit) & ~late
    kept = F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in ("path", "line", "column", "match", "preview")]))
    out = evidence.envelope(out, covered, "text", "verified", "workspace paths", root, paths)
    return out.withColumns({"rows": kept, "truncated": F.col("total") > limit, "total_known": known}).withColumn("total", F.when(known, F.col("total")))


def match_counts(files: DataFrame, query: str, case_sensitive: bool = False) -> DataFrame:
    """(path, matches) of files that hold ``query``, a part of one line; no place is worked out."""
    pattern = quoted(query, case_sensitive)
    return holding(files, query, case_sensitive).select("path", F.size(F.regexp_extract_all("text", F.lit(pattern), 0)).cast("long").alias("matches"))


def first_matches(files: DataFrame, query: str, limit: int, case_sensitive: bool = False) -> DataFrame:
    """The first ``limit`` matches by path, line and column, with ``total`` and ``total_known``, from one reading of the files.

    Of a file at most ``limit`` + 1 matches are located, so the total is known only if no match is left out.
    """
    found = located(holding(files, query, case_sensitive).select("path", "text"), quoted(query, case_sensitive), limit + 1)
    return early_stop(_rows(found), [utf16_order("path"), F.col("line"), F.col("column")], limit)


def line_span(files: DataFrame, first: int, last: int, budget: int = 4000) -> DataFrame:
    """(path, status, first_line, last_line, text, omitted): lines ``first`` to ``last``, at most ``budget`` characters.

    A span that begins after the last line is an error state, not cut to fit.
    """
    parts = F.split("text", TERMINATOR, -1)
    n = F.size(parts)
    text = F.array_join(F.slice(parts, F.lit(first), F.lit(last - first + 1)), "\n")
    ok = F.col("text").isNotNull() & (n >= first)
    return files.select(
        "path", F.when(ok, "ok").otherwise("out_of_range").alias("status"), F.when(ok, F.lit(first)).alias("first_line"),
        F.when(ok, F.least(F.lit(last), n)).alias("last_line"), F.when(ok, F.left(text, F.lit(budget))).alias("text"),
        F.when(ok, F.greatest(F.length(text) - budget, F.lit(0))).alias("omitted"),
    )


def documents_read(files: DataFrame) -> DataFrame:
    """(path, byte_count, scalar_count, utf16_count, total_lines, content_hash) of decoded texts; an ending terminator opens no line."""
    t = F.col("text")
    n = F.size(F.split(t, TERMINATOR, -1)) - F.when(t.rlike("[\r\n]\\z"), 1).otherwise(0)
    return files.select("path", F.octet_length(t).cast("long").alias("byte_count"), F.length(t).cast("long").alias("scalar_count"), utf16_length(t).cast("long").alias("utf16_count"), F.when(F.length(t) == 0, 0).otherwise(n).cast("long").alias("total_lines"), F.sha2(t, 256).alias("content_hash"))


def status_counts(observed: DataFrame) -> DataFrame:
    """(status, n) of a column ``status``."""
    return observed.groupBy("status").agg(F.count("*").alias("n"))


def skip_details(observed: DataFrame, most: int = 50) -> DataFrame:
    """(status, n, path): the counts of all statuses but "searched", and the first ``most`` of those paths in order."""
    skipped = observed.where("status != 'searched'")
    first = skipped.select("status", "path").orderBy("path").limit(most)
    return status_counts(skipped).join(first, "status", "left").select("status", "n", "path")
