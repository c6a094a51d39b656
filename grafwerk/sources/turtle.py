"""Turtle: a reader as a Spark data source, and a writer.

    spark.dataSource.register(TurtleDataSource)
    spark.read.format("turtle").load("graphs/*.ttl")

Read are prefixes, `a`, `;` and `,` lists, IRIs and prefixed names, plain, long, typed and tagged literals,
numbers, booleans, blank node labels and bracketed blank nodes, collections. Anything else is refused with the place in the file. Each file is a partition; a file is read by one task, statement by statement.
"""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from grafwerk.model import PREFIXES, RDF, TRIPLES, TYPE, XSD

_TOKEN = re.compile(
    r'(?P<long>"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*\'\'\')|(?P<str>"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')'
    r"|(?P<iri><[^<>\s]*>)|(?P<at>@[A-Za-z][\w-]*)|(?P<blank>_:[\w.-]*\w)|(?P<num>[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)"
    r"|(?P<name>(?:[^\W\d][\w.-]*)?:(?:(?:[\w%:]|\\[^\w\s])(?:[\w.%:-]|\\[^\w\s])*)?)|(?P<word>[A-Za-z]+)|(?P<op>\^\^|[.;,\[\]()])|(?P<skip>\s+|\#[^\n]*)",
    re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


class TurtleError(ValueError):
    """The text isn't Turtle of the covered kind."""


def _unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        x = m.group(1)
        return chr(int(x[1:], 16)) if x[0] in "uU" else _ESCAPES.get(x, x)

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, text, flags=re.S)


def parse(text: str) -> Iterator[tuple[str, str, str, str, str | None, str | None]]:
    """(s, p, o, o_kind, o_dtype, o_lang) of each statement."""
    tokens = _tokens(text)
    prefixes: dict[str, str] = {}
    base = ""
    kind, value = next(tokens)
    blanks = 0

    def move() -> tuple[str, str]:
        nonlocal kind, value
        got = (kind, value)
        kind, value = next(tokens)
        return got

    def want(op: str) -> None:
        if value != op:
            raise TurtleError(f"expected {op!r}, got {value!r}")
        move()

    def name(text_: str) -> str:
        head, _, tail = text_.partition(":")
        if head not in prefixes:
            raise TurtleError(f"unknown prefix {head!r}")
        return prefixes[head] + re.sub(r"\\(.)", r"\1", tail)

    out: list[tuple] = []

    def term() -> tuple[str, str, str | None, str | None]:
        nonlocal blanks
        k, v = move()
        if k == "iri":
            return (v[1:-1] if ":" in v else base + v[1:-1]), "iri", None, None
        if k == "name":
            return name(v), "iri", None, None
        if k == "blank":
            return v, "blank", None, None
        if v == "[":
            blanks += 1
            node = f"_:b{blanks}"
            if value != "]":
                predicates(node)
            want("]")
            return node, "blank", None, None
        if v == "(":
            items = []
            while value != ")":
                items.append(term())
            move()
            head: tuple = (f"{RDF}nil", "iri", None, None)
            for item in reversed(items):
                blanks += 1
                node = f"_:b{blanks}"
                out.append((node, f"{RDF}first", *item))
                out.append((node, f"{RDF}rest", *head))
                head = (node, "blank", None, None)
            return head
        if k in ("str", "long"):
            body = _unescape(v[3:-3] if k == "long" else v[1:-1])
            if kind == "at":
                return body, "literal", None, move()[1][1:]
            if value == "^^":
                move()
                return body, "literal", term()[0], None
            return body, "literal", None, None
        if k == "num":
            return v, "literal", XSD + ("double" if "e" in v.lower() else "decimal" if "." in v else "integer"), None
        if v in ("true", "false"):
            return v, "literal", f"{XSD}boolean", None
        if v == "a":
            return TYPE, "iri", None, None
        raise TurtleError(f"{v!r} is no term here")

    def predicates(s: str) -> None:
        while True:
            p, p_kind, _, _ = term()
            if p_kind != "iri":
                raise TurtleError(f"{p!r} is no predicate")
            while True:
                out.append((s, p, *term()))
                if value != ",":
                    break
                move()
            if value != ";":
                return
            while value == ";":
                move()
            if value in (".", "]"):
                return

    while kind != "end":
        if value.lower() in ("@prefix", "prefix", "@base", "base"):
            word = move()[1].lower()
            if word.endswith("prefix"):
                head = move()[1].rstrip(":")
                prefixes[head] = move()[1][1:-1]
            else:
                base = move()[1][1:-1]
            if word.startswith("@"):
                want(".")
            continue
        s, s_kind, _, _ = term()
        if s_kind == "literal":
            raise TurtleError(f"{s!r} is no subject")
        if value != ".":
            predicates(s)
        want(".")
        yield from out
        out.clear()


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise TurtleError(f"can't read line {text.count(chr(10), 0, at) + 1}: {text[at : at + 30]!r}")
        at = m.end()
        # A name may not end in the dot that ends its statement.
        if m.lastgroup in ("num", "name") and m.group().endswith("."):
            yield m.lastgroup, m.group()[:-1]
            yield "op", "."
        elif m.lastgroup != "skip":
            yield m.lastgroup or "", m.group()
    while True:
        yield "end", ""


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path.removeprefix("file://")

    def partitions(self) -> list[InputPartition]:
        found = sorted(glob.glob(os.path.join(self.path, "*.ttl") if os.path.isdir(self.path) else self.path))
        if not found:
            raise FileNotFoundError(self.path)
        return [_File(p) for p in found]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8") as f:  # type: ignore[attr-defined]
            yield from parse(f.read())


class TurtleDataSource(DataSource):
    """Format `turtle`: triples of the files of a path, a pattern or a folder that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "turtle"

    def schema(self):
        return TRIPLES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def lines(graph: DataFrame) -> DataFrame:
    """One line of Turtle for each triple, by subject and predicate, without prefixes."""

    def quoted(c: str):
        text = F.col(c)
        for raw, to in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            text = F.replace(text, F.lit(raw), F.lit(to))
        return F.concat(F.lit('"'), text, F.lit('"'))

    def node(c: str):
        return F.when(F.startswith(c, F.lit("_:")), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))

    literal = F.concat(quoted("o"), F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_dtype").isNotNull(), F.concat(F.lit("^^<"), "o_dtype", F.lit(">"))).otherwise(F.lit("")))
    text = F.concat_ws(" ", node("s"), node("p"), F.when(F.col("o_kind") == "literal", literal).otherwise(node("o")), F.lit("."))
    return graph.select("s", "p", "o", text.alias("value")).orderBy("s", "p", "o").select("value")


def write(graph: DataFrame, path: str) -> None:
    """Write the graph as Turtle text files."""
    lines(graph).write.mode("overwrite").text(path)


__all__ = ["PREFIXES", "TurtleDataSource", "TurtleError", "lines", "parse", "write"]
