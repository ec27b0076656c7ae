"""Structural facts of C# sources: a lexer and a declaration and expression scanner, without compiler semantics.

``parse`` never fails: what it can't read it steps over, and counts as a
diagnostic. Facts are candidates; names are not bound.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions.identity import entity_id

LEXER = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|^[ \t]*\#[^\n]*)
    |(?P<text>\$*(?P<raw>\"{3,}).*?(?:(?P=raw)|\Z)|(?:\$@|@\$|@)\"(?:[^\"]|\"\")*(?:\"|\Z)|\$?\"(?:[^\"\\\n]|\\.)*(?:\"|$)|'(?:[^'\\\n]|\\.)*(?:'|$))
    |(?P<name>@?[^\W\d]\w*)
    |(?P<number>\d[\w.]*)
    |(?P<sign>=>|\?\.|::|\?\?|.)""",
    re.S | re.M | re.X,
)
TYPES = {"class", "struct", "interface", "enum", "record"}
MODIFIERS = set("public private protected internal static abstract sealed partial readonly virtual override async extern unsafe new ref const required volatile file implicit explicit".split())
# Words of the language that begin statements or expressions and so are no callee or declared type.
WORDS = set("if for foreach while switch return throw using lock catch fixed when nameof typeof sizeof default checked unchecked await base this new var in is as out ref else do try finally yield goto break continue case".split())
FACTS = "path string, kind string, name string, container string, attributes array<string>, modifiers array<string>, signature string, detail string, depth int, start int, length int, type_parameters int, bases array<string>, documentation string, namespace string, owner string, line int, column int, diagnostics int, overloads bigint, members bigint"
ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "array<string>": pa.list_(pa.string())}
#: Facts that leave a parser's task at once.
BATCH_ROWS = 10_000


def lex(text: str) -> list[tuple[str, str, int]]:
    """(kind, text, start) of all tokens but white space, comments and directives."""
    return [(m.lastgroup if m.lastgroup != "raw" else "text", m.group(), m.start()) for m in LEXER.finditer(text) if m.group("skip") is None]


def attribute_name(name: str) -> str:
    """The last part of a name, without an ending Attribute."""
    last = name.split(".")[-1].split("::")[-1]
    return last[: -len("Attribute")] if last.endswith("Attribute") and last != "Attribute" else last


class _Scanner:
    def __init__(self, text: str):
        self.text, self.tokens, self.facts, self.bad, self.space = text, lex(text), [], 0, ""
        self.close: dict[int, int] = {}
        stack: list[tuple[str, int]] = []
        pairs = {")": "(", "]": "[", "}": "{"}
        for i, (_, t, _) in enumerate(self.tokens):
            if t in "([{" and len(t) == 1:
                stack.append((t, i))
            elif t in pairs:
                while stack and stack[-1][0] != pairs[t]:
                    self.close[stack.pop()[1]] = i
                    self.bad += 1
                if stack:
                    self.close[stack.pop()[1]] = i
                else:
                    self.bad += 1
        for _, i in stack:
            self.close[i] = len(self.tokens)
            self.bad += 1

    def at(self, i: int) -> str:
        return self.tokens[i][1] if 0 <= i < len(self.tokens) else ""

    def kind(self, i: int) -> str:
        return self.tokens[i][0] if 0 <= i < len(self.tokens) else ""

    def add(self, kind, name, i, end, container=(), attributes=(), modifiers=(), signature="", detail="", depth=0, type_parameters=0, bases=(), begin=None, owner=""):
        start = self.tokens[i][2]
        last = self.tokens[min(end, len(self.tokens) - 1)]
        docs = "" if begin is None else self.documentation(self.tokens[begin][2])
        self.facts.append((kind, name, ".".join(container), list(attributes), sorted(modifiers), signature, detail, depth, start, last[2] + len(last[1]) - start, type_parameters, list(bases), docs, self.space if container else "", owner))

    def documentation(self, at: int) -> str:
        """The documentation comment that ends right before a place, without its signs."""
        out, end = [], self.text.rfind("\n", 0, at)
        while end >= 0:
            begin = self.text.rfind("\n", 0, end) + 1
            line = self.text[begin:end].strip()
            if not line.startswith("///"):
                break
            out.append(line[3:].strip())
            end = begin - 1
        return "\n".join(reversed(out))

    def parts_between(self, a: int, b: int) -> int:
        """How many parts commas make between two brackets, not counting those inside others."""
        if b - a < 2:
            return 0
        n, depth = 1, 0
        for i in range(a + 1, b):
            t = self.at(i)
            depth += (t in ("<", "(", "[")) - (t in (">", ")", "]"))
            n += t == "," and not depth
        return n

    def base_list(self, j: int, b: int) -> list[str]:
        """Names after the colon of a type, up to its constraints or body."""
        out = []
        while j < b and self.at(j) not in ("{", ";", "where"):
            name, after = self.dotted(j)
            if name:
                out.append(name)
                j = after
                if self.at(j) == "(":
                    j = self.close.get(j, j) + 1
            else:
                j += 1
        return out

    def generic_end(self, i: int) -> int:
        """The place after type arguments that begin at ``i``, or ``i`` where there are none."""
        if self.at(i) != "<":
            return i
        depth, j = 0, i
        while j < len(self.tokens) and (self.kind(j) in ("name", "number") or self.at(j) in ("<", ">", ",", ".", "?", "[", "]", "::", "(", ")")):
            depth += (self.at(j) == "<") - (self.at(j) == ">")
            j += 1
            if not depth:
                return j
        return i

    def dotted(self, i: int) -> tuple[str, int]:
        """A name with dots and type arguments from ``i``: its text without arguments, and the place after."""
        parts = []
        while self.kind(i) == "name":
            parts.append(self.at(i).lstrip("@"))
            i = self.generic_end(i + 1)
            if self.at(i) not in (".", "::"):
                break
            parts.append(self.at(i))
            i += 1
        return "".join(parts), i

    def expressions(self, a: int, b: int) -> None:
        """Calls, creations and catch clauses among tokens ``a`` to ``b``."""
        i = a
        while i < b:
            t, k = self.at(i), self.kind(i)
            if t == "new":
                if self.at(i + 1) == "(":
                    self.add("object_creation", "", i, self.close.get(i + 1, i), detail="implicit")
                elif self.kind(i + 1) == "name":
                    name, j = self.dotted(i + 1)
                    if self.at(j) in ("(", "[", "{"):
                        self.add("object_creation", name.split(".")[-1].split("::")[-1], i, self.close.get(j, j), detail="array" if self.at(j) == "[" else "explicit")
                    i = j
                    continue
            elif t == "catch":
                j, name = i + 1, ""
                if self.at(j) == "(":
                    name, _ = self.dotted(j + 1)
                    j = self.close.get(j, j) + 1
                if self.at(j) == "when":
                    j = self.close.get(j + 1, j + 1) + 1
                end = self.close.get(j, j)
                empty = self.at(j) == "{" and end == j + 1
                self.add("catch", name.split(".")[-1], i, end, detail="empty" if empty else "body")
            elif k == "name" and t not in WORDS and t not in TYPES and t not in MODIFIERS:
                j = self.generic_end(i + 1)
                if self.at(j) == "(" and self.at(i - 1) not in ("new",) and not (self.kind(i - 1) == "name" and self.at(i - 1) not in WORDS | {"await", "return"}):
                    self.add("invocation", t.lstrip("@"), i, self.close.get(j, j), detail="member" if self.at(i - 1) in (".", "?.") else "simple")
            i += 1

    def members(self, a: int, b: int, container: tuple, depth: int, inside: str) -> None:
        """Declarations among tokens ``a`` to ``b``."""
        i = a
        while i < b:
            attributes, modifiers, begin = [], set(), i
            if not depth:
                self.space = ".".join(container)  # a type's namespace is that of the outermost type around it
            while self.at(i) == "[":
                end = self.close.get(i, b)
                j = i + 1
                while j < end:
                    name, after = self.dotted(j)
                    if self.at(after) == ":":
                        name, after = self.dotted(after + 1)
                    if name:
                        attributes.append(attribute_name(name))
                    while after < end and self.at(after) != ",":
                        after = self.close.get(after, after) + 1
                    j = after + 1
                i = end + 1
            while self.at(i) in MODIFIERS and i < b:
                modifiers.add(self.at(i))
                i += 1
            t = self.at(i)
            if i >= b:
                break
            if t == "namespace":
                name, j = self.dotted(i + 1)
                if self.at(j) == "{":
                    self.members(j + 1, self.close.get(j, b), (*container, name), depth, "namespace")
                    i = self.close.get(j, b) + 1
                else:
                    container, i = (*container, name), j + 1
                continue
            if t == "using" or t == "extern":
                while i < b and self.at(i) != ";":
                    i += 1
                i += 1
                continue
            if t in TYPES and self.kind(i + 1) == "name":
                word = i
                if t == "record" and self.at(i + 1) in ("class", "struct"):
                    i += 1
                name, j = self.at(i + 1).lstrip("@"), self.generic_end(i + 2)
                n_types, signature, bases = self.parts_between(i + 2, j - 1), self.signature(j) if self.at(j) == "(" else "", []
                while j < b and self.at(j) not in ("{", ";"):
                    if self.at(j) == ":" and not bases:
                        bases = self.base_list(j + 1, b)
                    j = (self.close.get(j, j) if self.at(j) in "([" else j) + 1
                end = self.close.get(j, j) if self.at(j) == "{" else j
                self.add(t, name, word, end, container, attributes, modifiers, signature, depth=depth, type_parameters=n_types, bases=bases, begin=begin, owner=inside)
                if self.at(j) == "{":
                    if t == "enum":
                        self.enum_members(j + 1, end, (*container, name), depth + 1)
                    else:
                        self.members(j + 1, end, (*container, name), depth + 1, t)
                i = end + 1
                continue
            i = self.member(begin, i, b, container, depth, inside, attributes, modifiers)

    def enum_members(self, a: int, b: int, container: tuple, depth: int) -> None:
        i = a
        while i < b:
            while self.at(i) == "[":
                i = self.close.get(i, b) + 1
            if self.kind(i) == "name" and i < b:
                self.add("enum_member", self.at(i).lstrip("@"), i, i, container, depth=depth, owner="enum")
            while i < b and self.at(i) != ",":
                i = self.close.get(i, i) + 1
            i += 1

    def member(self, begin, i, b, container, depth, inside, attributes, modifiers) -> int:
        """One member from ``i``; gives the place after it."""
        j, last, open_at = i, -1, -1
        is_type_body = inside in TYPES
        kind0 = self.at(i)
        while j < b and self.at(j) not in (";", "{", "=", "=>"):
            if self.at(j) == "(":
                open_at = j if open_at < 0 and last >= 0 else open_at
                j = self.close.get(j, j)
            elif self.at(j) == "[":
                j = self.close.get(j, j)
            elif self.at(j) == "<" and (g := self.generic_end(j)) > j:
                j = g - 1
            elif self.kind(j) == "name" and open_at < 0:
                last = j
            elif self.at(j) in (":", "where") and open_at >= 0:
                pass
            j += 1
        stop, t = j, self.at(j)
        if t in ("=", "=>"):
            while j < b and self.at(j) != ";":
                j = self.close.get(j, j) + 1
            end = j
        elif t == "{":
            end = self.close.get(j, b)
            if self.at(end + 1) == "=" and open_at < 0:
                while end < b and self.at(end) != ";":
                    end = self.close.get(end + 1, end + 1)
        else:
            end = j
        name = self.at(last).lstrip("@") if last >= 0 else ""
        if is_type_body and name and end < len(self.tokens) + 1:
            if kind0 == "delegate":
                kind = "delegate"
            elif kind0 == "event":
                kind = "event"
            elif self.at(last) == "this" or name == "this":
                kind = "indexer"
            elif "operator" in (self.at(last), *[self.at(x) for x in range(i, stop)]):
                kind = "operator"
            elif open_at >= 0:
                kind = "destructor" if self.at(last - 1) == "~" else "constructor" if name == (container[-1] if container else "") and last == i else "method"
            else:
                kind = "property" if t in ("{", "=>") else "field"
            g = self.generic_end(last + 1)
            n_types = self.parts_between(last + 1, g - 1) if kind in ("method", "delegate") and g > last + 1 else 0
            self.add(kind, name, begin, end, container, attributes, modifiers, self.signature(open_at), depth=depth, type_parameters=n_types, begin=begin, owner=inside)
        elif not is_type_body and open_at < 0 and t == "":
            self.bad += 1
        self.expressions(max(stop, i) if is_type_body else i, min(end + 1, b))
        return max(end, i) + 1

    def signature(self, open_at: int) -> str:
        """Types of the parameters, in brackets; empty where there are none to have."""
        if open_at < 0:
            return ""
        end, out, part, j = self.close.get(open_at, open_at), [], [], open_at + 1
        while j < end:
            t = self.at(j)
            if t == ",":
                out.append(part)
                part, j = [], j + 1
            elif t == "=":
                while j < end and self.at(j) != ",":
                    j = self.close.get(j, j) + 1
            elif t == "[" and not part:
                j = self.close.get(j, j) + 1
            elif t == "<" and (g := self.generic_end(j)) > j:
                part[-1:] = [(part[-1] if part else "") + "".join(self.at(x) for x in range(j, g))]
                j = g
            else:
                part.append(t)
                j += 1
        if part:
            out.append(part)
        return "(" + ", ".join("".join(p[:-1]) if len(p) > 1 else "".join(p) for p in out) + ")"


def parse(text: str) -> tuple[list[tuple], int]:
    """Facts of a source, in order of place, and the number of diagnostics."""
    s = _Scanner(text)
    s.members(0, len(s.tokens), (), 0, "")
    return sorted(set_free(s.facts), key=lambda f: (f[8], -f[9])), s.bad


def set_free(facts: list[tuple]) -> list[tuple]:
    """Facts with one row for each kind, place and length."""
    return list({(f[0], f[8], f[9]): f for f in facts}.values())


def _qualified(container: str, name: str) -> str:
    return f"{container}.{name}" if container else name


def syntax_facts(files: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Facts of C# files (path, text), only those of ``kinds`` if given; a null text has none. Places count UTF-16 units from 1 in lines and columns.

    ``overloads`` of a declaration share file, container, kind and name, ``members``
    are one level below; ``owner`` is the kind of the type around it. Small tables
    come in few partitions, so the files are dealt over all cores before they are parsed.
    """
    session = files.sparkSession
    tasks = max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    columns = [c.split()[0] for c in FACTS.split(", ")]
    types = [ARROW[c.split()[1]] for c in FACTS.split(", ")]
    wanted = None if kinds is None else set(kinds)

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for path, text in zip(batch.column("path"), batch.column("text")):
                path, text = path.as_py(), text.as_py() or ""
                facts, bad = parse(text)
                declared = [f for f in facts if f[0] in DECLARED]
                overloads, members = Counter((f[2], f[0], f[1]) for f in declared), Counter(f[2] for f in declared)
                ends = [m.end() for m in re.finditer("\r\n|\n|\r", text)]
                for fact in facts:
                    if wanted is not None and fact[0] not in wanted:
                        continue
                    at = bisect_right(ends, fact[8])
                    before = text[ends[at - 1] if at else 0 : fact[8]]
                    counts = (overloads[(fact[2], fact[0], fact[1])], members[_qualified(fact[2], fact[1])]) if fact[0] in DECLARED else (0, 0)
                    rows.append((path, *fact, at + 1, len(before.encode("utf-16-le")) // 2 + 1, bad, *counts))
                if len(rows) >= BATCH_ROWS:
                    yield told(rows)
                    rows = []
        if rows:
            yield told(rows)

    return files.select("path", "text").repartition(tasks, "path").mapInArrow(run, FACTS)


def identified(facts: DataFrame, files: DataFrame, query: str) -> DataFrame:
    """Facts that a query found, with ``id``, once each: the identity changes with the file's text, the place and the query."""
    known = files.select("path", "text", F.sha2("text", 256).alias("content_hash"))
    body = F.col("text").substr(F.col("start") + 1, F.col("length"))
    place = {"path": F.col("path"), "external": F.lit("false"), "content_hash": F.col("content_hash"), "start": F.col("start"), "length": F.col("length"), "text": body}
    met = facts.join(known.hint("merge"), "path").withColumn("id", entity_id("syntax", kind=F.col("kind"), query=F.lit(query), **place))
    return met.drop("text", "content_hash").dropDuplicates(["id"])


def invocations(facts: DataFrame, name: str) -> DataFrame:
    return facts.where((F.col("kind") == "invocation") & (F.col("name") == name))


def classes_with(facts: DataFrame, attribute: str) -> DataFrame:
    """Classes with an attribute; an ending Attribute counts on neither side."""
    return facts.where((F.col("kind") == "class") & F.array_contains("attributes", attribute_name(attribute)))


def object_creations(facts: DataFrame, type_name: str) -> DataFrame:
    """Creations of a type, and every implicit one as unresolved."""
    implicit = F.col("detail") == "implicit"
    found = facts.where((F.col("kind") == "object_creation") & (implicit | (F.col("name") == type_name)))
    return found.withColumn("type_match", F.when(implicit, "unresolved").otherwise("exact"))


def catches(facts: DataFrame, type_name: str | None = None, empty: bool = False) -> DataFrame:
    """Catch clauses; a type leaves untyped ones out, ``empty`` those with statements."""
    out = facts.where("kind = 'catch'")
    if type_name is not None:
        out = out.where(F.col("name") == type_name)
    return out.where("detail = 'empty'") if empty else out


DECLARED = "class struct interface enum record delegate event indexer operator destructor constructor method property field enum_member".split()


def declarations(facts: DataFrame) -> DataFrame:
    """(path, kind, name, qualified, namespace, accessibility, signature, line, column) of declared facts; the kinds and accessibilities are those that a symbol search knows.

    Without an access word a type at the top is internal, a member of an interface or an enum public, all else private.
    """
    d = facts.where(F.col("kind").isin(DECLARED))
    m = F.col("modifiers")
    has = lambda x: F.array_contains(m, x)
    given = (
        F.when(has("protected") & has("internal"), "protected-internal").when(has("private") & has("protected"), "private-protected")
        .when(has("public"), "public").when(has("protected"), "protected").when(has("internal"), "internal").when(has("private"), "private").when(has("file"), "file")
    )
    default = F.when(F.col("kind") == "enum_member", "public").when(F.col("owner") == "interface", "public").when(F.col("depth") == 0, "internal").otherwise("private")
    kind = F.when((F.col("kind") == "operator") & F.array_contains("modifiers", "implicit"), "conversion-operator").otherwise(F.replace("kind", F.lit("_"), F.lit("-")))
    return d.select(
        "path", kind.alias("kind"), "name", F.concat_ws(".", F.when(F.col("container") != "", F.col("container")), "name").alias("qualified"), "namespace",
        F.coalesce(given, default).alias("accessibility"), "signature", "line", "column",
    )


def outline(facts: DataFrame, most: int = 100) -> DataFrame:
    """(path, seq, kind, name, signature, depth, total): the first declarations of each file in source order."""
    rows = F.array_sort(F.collect_list(F.struct("start", "kind", "name", "signature", "depth")))
    per = facts.where(F.col("kind").isin(DECLARED)).groupBy("path").agg(rows.alias("r"))
    each = per.select("path", F.size("r").alias("total"), F.posexplode(F.slice("r", 1, most)).alias("at", "x"))
    return each.select("path", (F.col("at") + 1).alias("seq"), "x.kind", "x.name", "x.signature", "x.depth", "total")
