"""SPARQL SELECT compiled to DataFrame joins over triples.

Covered: PREFIX, SELECT [DISTINCT] of variables, * and COUNT, basic graph patterns with `;`, `,` and `a`, path
alternation, OPTIONAL (also nested), UNION of any number of branches, FILTER, BIND, VALUES, GROUP BY, ORDER BY,
LIMIT and OFFSET. Anything else is refused. Solutions are bags of strings: duplicates stay unless DISTINCT.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafwerk.model import PREFIXES, TYPE

_TOKEN = re.compile(
    r"""(?P<iri><[^<>\s]*>)|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<var>[?$]\w+)|(?P<num>-?\d+(?:\.\d+)?)"""
    r"""|(?P<name>[A-Za-z_][\w-]*:[\w.-]*\w|[A-Za-z_][\w-]*:|:\w[\w.-]*)|(?P<word>[A-Za-z_]\w*)|(?P<op>\|\||&&|!=|<=|>=|\^\^|[{}().;,|=<>!*/+-])|(?P<skip>\s+|\#[^\n]*)"""
)
FORBIDDEN = ("insert", "delete", "update", "load", "clear", "drop", "create", "copy", "move", "add", "construct", "ask", "describe", "service")


class SparqlError(ValueError):
    """The query isn't a SELECT of the covered kind."""


def guard(text: str, default: int = 200, most: int = 200) -> str:
    """The query if it is a SELECT without a forbidden keyword, with a LIMIT of `most` at the highest.

    Keywords are looked for outside of literals and IRIs, so that a search for such a word is allowed.
    """
    bare = re.sub(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|<[^<>\s]*>|#[^\n]*', " ", text)
    words = re.findall(r"(?<![?$\w:])[A-Za-z]+(?![\w:])", bare)
    lower = [w.lower() for w in words]
    if "select" not in lower:
        raise SparqlError("only SELECT queries are allowed")
    for w in lower:
        if w in FORBIDDEN:
            raise SparqlError(f"{w.upper()} isn't allowed")
    found = list(re.finditer(r"(?i)\blimit\s+(\d+)", text))
    if not found:
        return f"{text.rstrip()}\nLIMIT {default}"
    m = found[-1]
    return text[: m.start(1)] + str(min(most, int(m.group(1)))) + text[m.end(1) :]


def extract(answer: str) -> str:
    """The query in a text that may fence it or talk before it."""
    m = re.search(r"```(?:sparql)?\s*(.*?)```", answer, re.S | re.I)
    body = (m.group(1) if m else answer).strip()
    at = re.search(r"(?i)\b(prefix|select)\b", body)
    return body[at.start() :].strip() if at else body


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SparqlError(f"can't read {text[at : at + 20]!r}")
        at = m.end()
        if m.lastgroup != "skip":
            out.append((m.lastgroup or "", m.group()))
    return out


def _unquote(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m.group(1), m.group(1)), text[1:-1])


class _Parser:
    def __init__(self, text: str) -> None:
        self.t = _tokens(text)
        self.i = 0
        self.prefixes = dict(PREFIXES)

    def peek(self, k: int = 0) -> str:
        return self.t[self.i + k][1] if self.i + k < len(self.t) else ""

    def kind(self) -> str:
        return self.t[self.i][0] if self.i < len(self.t) else ""

    def word(self) -> str:
        return self.peek().upper()

    def take(self, want: str | None = None) -> str:
        got = self.peek()
        if not got or want is not None and got.upper() != want.upper():
            raise SparqlError(f"expected {want or 'more'}, got {got or 'the end'!r}")
        self.i += 1
        return got

    def query(self) -> dict:
        while self.word() == "PREFIX":
            self.take()
            name = self.take()
            self.prefixes[name.rstrip(":")] = self.take()[1:-1]
        self.take("SELECT")
        q: dict = {"distinct": False, "vars": [], "counts": [], "group": [], "order": [], "limit": None, "offset": 0}
        if self.word() in ("DISTINCT", "REDUCED"):
            q["distinct"] = self.take().upper() == "DISTINCT"
        while self.word() not in ("WHERE", "{"):
            if self.kind() == "var":
                q["vars"].append(self.take()[1:])
            elif self.peek() == "*":
                self.take()
            elif self.peek() == "(":
                self.take("(")
                self.take("COUNT")
                self.take("(")
                distinct = self.word() == "DISTINCT"
                if distinct:
                    self.take()
                what = self.take()
                self.take(")")
                self.take("AS")
                q["counts"].append((what.lstrip("?$"), distinct, self.take()[1:]))
                self.take(")")
            else:
                raise SparqlError(f"can't select {self.peek()!r}")
        if self.word() == "WHERE":
            self.take()
        q["where"] = self.group()
        while self.peek():
            w = self.take().upper()
            if w == "GROUP":
                self.take("BY")
                while self.kind() == "var":
                    q["group"].append(self.take()[1:])
            elif w == "ORDER":
                self.take("BY")
                while self.kind() == "var" or self.word() in ("ASC", "DESC"):
                    down = False
                    if self.word() in ("ASC", "DESC"):
                        down = self.take().upper() == "DESC"
                        self.take("(")
                        q["order"].append((self.take()[1:], down))
                        self.take(")")
                    else:
                        q["order"].append((self.take()[1:], down))
            elif w in ("LIMIT", "OFFSET"):
                q[w.lower()] = int(self.take())
            else:
                raise SparqlError(f"{w} isn't covered")
        return q

    def group(self) -> list:
        self.take("{")
        out: list = []
        while self.peek() != "}":
            w = self.word()
            if w == "OPTIONAL":
                self.take()
                out.append(("optional", self.group()))
            elif w == "FILTER":
                self.take()
                out.append(("filter", self.expression() if self.peek() != "(" else self.bracketed()))
            elif w == "BIND":
                self.take()
                self.take("(")
                e = self.expression()
                self.take("AS")
                out.append(("bind", e, self.take()[1:]))
                self.take(")")
            elif w == "VALUES":
                self.take()
                out.append(self.values())
            elif self.peek() == "{":
                branches = [self.group()]
                while self.word() == "UNION":
                    self.take()
                    branches.append(self.group())
                out.append(("union", branches))
            elif w in ("MINUS", "GRAPH", "SERVICE"):
                raise SparqlError(f"{w} isn't covered")
            else:
                self.patterns(out)
            if self.peek() == ".":
                self.take()
        self.take("}")
        return out

    def values(self) -> tuple:
        many = self.peek() == "("
        if many:
            self.take()
        names = [self.take()[1:]]
        while many and self.kind() == "var":
            names.append(self.take()[1:])
        if many:
            self.take(")")
        self.take("{")
        rows = []
        while self.peek() != "}":
            if many:
                self.take("(")
            rows.append([self.term()[1] for _ in names])
            if many:
                self.take(")")
        self.take("}")
        return ("values", names, rows)

    def term(self) -> tuple[str, str]:
        kind, text = self.kind(), self.take()
        if kind == "var":
            return "var", text[1:]
        if kind == "iri":
            return "iri", text[1:-1]
        if kind == "name":
            head, _, tail = text.partition(":")
            if head not in self.prefixes:
                raise SparqlError(f"unknown prefix {head!r}")
            return "iri", self.prefixes[head] + tail
        if kind == "str":
            if self.peek() == "^^":
                self.take()
                self.term()
            return "literal", _unquote(text)
        if kind == "num" or text.lower() in ("true", "false"):
            return "literal", text
        if text == "a":
            return "iri", TYPE
        raise SparqlError(f"{text!r} is no term")

    def path(self) -> tuple[str, object]:
        bracket = self.peek() == "("
        if bracket:
            self.take()
        first = self.term()
        ways = [first[1]]
        while self.peek() == "|":
            self.take()
            ways.append(self.term()[1])
        if bracket:
            self.take(")")
        if self.peek() in ("/", "*", "+"):
            raise SparqlError("of paths only alternatives are covered")
        return ("path", ways) if len(ways) > 1 else first

    def patterns(self, out: list) -> None:
        s = self.term()
        while True:
            p = self.path()
            while True:
                out.append(("triple", s, p, self.term()))
                if self.peek() != ",":
                    break
                self.take()
            if self.peek() != ";":
                break
            while self.peek() == ";":
                self.take()
            if self.peek() in (".", "}"):
                break

    def bracketed(self):
        self.take("(")
        e = self.expression()
        self.take(")")
        return e

    def expression(self):
        left = self.conjunction()
        while self.peek() == "||":
            self.take()
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self):
        left = self.comparison()
        while self.peek() == "&&":
            self.take()
            left = ("and", left, self.comparison())
        return left

    def comparison(self):
        left = self.primary()
        if self.peek() in ("=", "!=", "<", ">", "<=", ">="):
            op = self.take()
            return (op, left, self.primary())
        return left

    def primary(self):
        if self.peek() == "!":
            self.take()
            return ("not", self.primary())
        if self.peek() == "(":
            return self.bracketed()
        if self.kind() == "word" and self.peek(1) == "(":
            name = self.take().upper()
            self.take("(")
            args = []
            while self.peek() != ")":
                args.append(self.expression())
                if self.peek() == ",":
                    self.take()
            self.take(")")
            return ("call", name, args)
        return ("term", self.term())


_CALLS = {
    "STR": lambda a: a[0],
    "LCASE": lambda a: F.lower(a[0]),
    "UCASE": lambda a: F.upper(a[0]),
    "CONTAINS": lambda a: F.contains(a[0], a[1]),
    "STRSTARTS": lambda a: F.startswith(a[0], a[1]),
    "STRENDS": lambda a: F.endswith(a[0], a[1]),
    "STRLEN": lambda a: F.length(a[0]),
    "BOUND": lambda a: a[0].isNotNull(),
    "COALESCE": lambda a: F.coalesce(*a),
    "CONCAT": lambda a: F.concat(*a),
    "IRI": lambda a: a[0],
    "URI": lambda a: a[0],
}


def _column(e, have: set[str]) -> Column:
    kind = e[0]
    if kind == "term":
        t, v = e[1]
        return (F.col(v) if v in have else F.lit(None).cast("string")) if t == "var" else F.lit(v)
    if kind == "call":
        args = [_column(x, have) for x in e[2]]
        if e[1] == "REGEX":
            flags = e[2][2][1][1] if len(e[2]) > 2 else ""
            return F.regexp_like(args[0], F.concat(F.lit(f"(?{flags})" if flags else ""), args[1]))
        if e[1] not in _CALLS:
            raise SparqlError(f"{e[1]} isn't covered")
        return _CALLS[e[1]](args)
    if kind == "not":
        return ~_column(e[1], have)
    a, b = _column(e[1], have), _column(e[2], have)
    return {"or": a | b, "and": a & b, "=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[kind]


def _scan(graph: DataFrame, s, p, o) -> DataFrame:
    """One pattern as a filtered and renamed scan; a variable that it holds twice must have one value."""
    rows = graph
    if p[0] == "path":
        rows = rows.where(F.col("p").isin(p[1]))
    elif p[0] == "iri":
        rows = rows.where(F.col("p") == p[1])
    if s[0] == "iri":
        rows = rows.where(F.col("s") == s[1])
    if o[0] == "iri":
        rows = rows.where((F.col("o") == o[1]) & (F.col("o_kind") == "iri"))
    elif o[0] == "literal":
        rows = rows.where((F.col("o") == o[1]) & (F.col("o_kind") == "literal"))
    cols: dict[str, str] = {}
    for (kind, v), c in ((s, "s"), (p if p[0] == "var" else ("", ""), "p"), (o, "o")):
        if kind == "var":
            if v in cols:
                rows = rows.where(F.col(c) == F.col(cols[v]))
            else:
                cols[v] = c
    return rows.select(*(F.col(c).alias(v) for v, c in cols.items()))


def _join(left: DataFrame | None, right: DataFrame, how: str = "inner") -> DataFrame:
    if left is None:
        return right
    shared = [c for c in left.columns if c in right.columns]
    if shared:
        return left.join(right, shared, how)
    return left.crossJoin(right) if how == "inner" else left.join(right, F.lit(True), how)


def _group(graph: DataFrame, items: list, start: DataFrame | None = None) -> DataFrame:
    out = start
    filters = [i[1] for i in items if i[0] == "filter"]
    # What is known before the optional parts, and whether a constant or a filter made it few.
    base, few, met = start, start is not None, {}
    # Patterns that share a variable with what is there come first, so that no product is built on the way.
    todo = [i for i in items if i[0] != "filter"]
    while todo:
        k = 0
        if todo[0][0] == "triple" and out is not None:
            have = set(out.columns)
            for n, item in enumerate(todo):
                if item[0] != "triple":
                    break
                if any(x[0] == "var" and x[1] in have for x in item[1:4]):
                    k = n
                    break
        item = todo.pop(k)
        kind = item[0]
        if kind == "triple":
            out = _join(out, _scan(graph, *item[1:]))
            few = few or item[1][0] != "var" or (item[3][0] != "var" and item[2] != ("iri", TYPE))
        elif kind == "optional":
            out = _optional(graph, out, item[1], lambda shared, base=base, few=few: _near(base, shared, filters, few, met))
            continue
        elif kind == "union":
            branches = [_group(graph, b) for b in item[1]]
            out = _join(out, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches))
        elif kind == "values":
            rows = graph.sparkSession.createDataFrame(item[2], ", ".join(f"`{n}` string" for n in item[1]))
            out = _join(out, rows)
            few = True
        elif kind == "bind":
            unbound = out if out is not None else graph.sparkSession.range(1).select()
            out = unbound.withColumn(item[2], _column(item[1], set(unbound.columns)).cast("string"))
        base, met = out, {}
    if out is None:
        raise SparqlError("an empty group")
    for f in filters:
        out = out.where(_column(f, set(out.columns)))
    return out


def _variables(e) -> set[str]:
    """The variables of an expression."""
    if e[0] == "term":
        return {e[1][1]} if e[1][0] == "var" else set()
    return set().union(*(_variables(x) for x in (e[2] if e[0] == "call" else e[1:])))


#: Rows whose values are told to a scan as constants.
FEW = 1000


def _near(base: DataFrame | None, shared: list[str], filters: list, few: bool, met: dict) -> list | DataFrame | None:
    """The rows of `base` that an optional part can meet: their values, if few; None if nothing bounds them."""
    if not shared or base is None or not set(shared) <= set(base.columns):
        return None
    early = [f for f in filters if _variables(f) <= set(base.columns)]
    if not few and not early:
        return None
    if tuple(shared) not in met:
        for f in early:
            base = base.where(_column(f, set(base.columns)))
        rows = base.select(*shared).distinct()
        some = rows.limit(FEW + 1).collect()
        met[tuple(shared)] = some if len(some) <= FEW else rows
    return met[tuple(shared)]


def _optional(graph: DataFrame, left: DataFrame | None, items: list, near: Callable[[list[str]], list | DataFrame | None]) -> DataFrame:
    """A left join. Filters of the optional part may look at variables of the other side: they are join conditions.

    Where constants or the group's filters leave few rows on the left, only what shares their values is joined: a
    filter by constants reaches the tables below a relation, which would be built in full for a single row else.
    """
    inner = [i for i in items if i[0] != "filter"]
    right = _group(graph, inner)
    if left is None:
        return right
    shared = [c for c in left.columns if c in right.columns]
    new = [c for c in right.columns if c not in shared]
    rows = near(shared)
    if isinstance(rows, list):
        for k, c in enumerate(shared):
            right = right.where(F.col(c).isin([v for v in {r[k] for r in rows} if v is not None]))
    elif rows is not None:
        right = right.join(rows, shared, "left_semi")
    renamed = right.withColumnsRenamed({c: f"__{c}" for c in shared})
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__{c}") for c in shared], F.lit(True))
    for f in (i[1] for i in items if i[0] == "filter"):
        on = on & _column(f, set(left.columns) | set(new))
    return left.join(renamed, on, "left").select(*left.columns, *new)


def select(graph: DataFrame, text: str, bindings: dict[str, str] | None = None) -> DataFrame:
    """The solutions of a SELECT over `graph`; `bindings` fix variables beforehand."""
    q = _Parser(text).query()
    start = None
    if bindings:
        start = graph.sparkSession.createDataFrame([tuple(bindings.values())], ", ".join(f"`{n}` string" for n in bindings))
    out = _group(graph, q["where"], start)
    if q["counts"] or q["group"]:
        aggs = []
        for what, distinct, name in q["counts"]:
            c = F.lit(1) if what == "*" else F.col(what)
            aggs.append((F.countDistinct(c) if distinct else F.count(c)).alias(name))
        out = out.groupBy(*q["group"]).agg(*aggs) if aggs else out.select(*q["group"]).distinct()
    wanted = [*q["vars"], *(c[2] for c in q["counts"])] or out.columns
    missing = [v for v in wanted if v not in out.columns]
    for v in missing:
        out = out.withColumn(v, F.lit(None).cast("string"))
    order = [F.col(v).desc() if down else F.col(v).asc() for v, down in q["order"]]
    hidden = [v for v, _ in q["order"] if v not in wanted]
    if q["distinct"]:
        out = out.select(*wanted).distinct()
    elif hidden:
        out = out.select(*wanted, *hidden)
    else:
        out = out.select(*wanted)
    if order:
        out = out.orderBy(*[o for o, (v, _) in zip(order, q["order"]) if v in out.columns])
    if q["offset"]:
        out = out.offset(q["offset"])
    if q["limit"] is not None:
        out = out.limit(q["limit"])
    return out.select(*wanted)
