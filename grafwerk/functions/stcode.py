"""Structured text and function-block code: assignments with guards, truth paths, calls, block diagrams.

The parsers are plain functions of one text; `*_table` functions apply them to a column as Arrow-batched maps.
`compat=True` keeps the oddities of older tools (operators found inside names, comparisons skipped, a false
condition read as all of its names true); by default expressions are read by their grammar.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

#: Paths of one condition at most; more are an error, not a silent cut.
MOST_PATHS = 4096


def strip_comments(code: str) -> str:
    """Code without comments; line breaks stay, so that line numbers do."""
    code = re.sub(r"\(\*.*?\*\)", lambda m: "\n" * m.group().count("\n"), code, flags=re.S)
    return re.sub(r"//[^\n]*", "", code)


def split_top(text: str, sep: str = ",") -> list[str]:
    """Parts between separators that stand in no brackets and no quotes."""
    out, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == sep and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    last = text[start:].strip()
    return [*out, last] if last or out else []


def _balanced(text: str, at: int) -> int:
    """The place after the bracket that closes the one at `at`, or -1."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if depth == 0:
            return i + 1
    return -1


def assignments(code: str, variable: str | None = None) -> list[tuple[int, str, str, list[str]]]:
    """(line, variable, right side, guards) of each assignment, of one variable or of all.

    A guard tells its branch and line: `IF@2: c`, `ELSIF@2: c` and `ELSE@2 (zu IF: c)` carry the line of the IF.
    """
    out: list[tuple[int, str, str, list[str]]] = []
    stack: list[tuple[int, str, str]] = []  # line, first condition, guard now
    clean = strip_comments(code)
    held, held_line = "", 0
    for no, line in enumerate(clean.split("\n"), 1):
        rest = (held + " " + line.strip()) if held else line.strip()
        first = held_line if held else no
        held = ""
        while rest:
            m = re.match(r"(?i)(IF|ELSIF)\b(.*?)\bTHEN\b(.*)$", rest, re.S)
            if m:
                cond = re.sub(r"\s+", " ", m.group(2)).strip()
                if m.group(1).upper() == "IF":
                    stack.append((first, cond, f"IF@{first}: {cond}"))
                elif stack:
                    stack[-1] = (stack[-1][0], stack[-1][1], f"ELSIF@{stack[-1][0]}: {cond}")
                rest = m.group(3).strip()
                continue
            if re.match(r"(?i)(IF|ELSIF)\b", rest):
                held, held_line = rest, first
                break
            m = re.match(r"(?i)ELSE\b(.*)$", rest, re.S)
            if m:
                if stack:
                    stack[-1] = (stack[-1][0], stack[-1][1], f"ELSE@{stack[-1][0]} (zu IF: {stack[-1][1]})")
                rest = m.group(1).strip()
                continue
            m = re.match(r"(?i)END_IF\s*;?(.*)$", rest, re.S)
            if m:
                if stack:
                    stack.pop()
                rest = m.group(1).strip()
                continue
            m = re.match(r"([A-Za-z_][\w.\[\]]*)\s*:=\s*([^;]*);(.*)$", rest, re.S)
            if m:
                if variable is None or m.group(1).lower() == variable.lower():
                    out.append((first, m.group(1), re.sub(r"\s+", " ", m.group(2)).strip(), [g for _, _, g in stack]))
                rest = m.group(3).strip()
                continue
            if re.match(r"[A-Za-z_][\w.\[\]]*\s*:=", rest):
                held, held_line = rest, first
                break
            m = re.match(r"[^;]*;(.*)$", rest, re.S)
            rest = m.group(1).strip() if m else ""
    return out


def later(found: list[tuple[int, str, str, list[str]]]) -> list[list[int]]:
    """For each assignment the lines of later ones of its variable."""
    return [[b[0] for b in found if b[1].lower() == a[1].lower() and b[0] > a[0]] for a in found]


# --- conditions --------------------------------------------------------------------------------------------

_NAME = re.compile(r"[A-Za-z_%][\w.\[\]#]*|[A-Za-z_]+#[\w.]+")
_WHOLE = re.compile(r"\s*(<>|<=|>=|:=|[()=<>+\-*/&]|\d[\w.#]*|'[^']*'|[A-Za-z_%][\w.\[\]#]*)")
_ODD = re.compile(r"(?i)AND|OR|NOT|\(|\)|[A-Za-z_][\w.]*")


def _words(text: str, compat: bool) -> list[str]:
    if compat:
        # The old scanner had no word boundaries: an operator at the start of a name is split off.
        out, at = [], 0
        while at < len(text):
            m = re.compile(r"(?i)(AND|OR|NOT)|([()])|([A-Za-z_][\w.]*)").match(text, at)
            if m and m.group(1) and text[at : at + 3].upper() in ("AND", "NOT") or m and m.group(1):
                out.append(m.group(1).upper())
            elif m:
                out.append(m.group())
            at = m.end() if m else at + 1
        return [w for w in out if w.upper() != "XOR"]
    return [m.group(1) for m in _WHOLE.finditer(text)]


class _Reader:
    """OR over XOR over AND over NOT over comparisons over names."""

    def __init__(self, words: list[str], compat: bool) -> None:
        self.w, self.i, self.compat = words, 0, compat

    def peek(self) -> str:
        return self.w[self.i].upper() if self.i < len(self.w) else ""

    def either(self):
        left = self.odd()
        while self.peek() == "OR":
            self.i += 1
            left = ("or", left, self.odd())
        return left

    def odd(self):
        left = self.both()
        while not self.compat and self.peek() == "XOR":
            self.i += 1
            left = ("xor", left, self.both())
        return left

    def both(self):
        left = self.negated()
        while self.peek() in ("AND", "&"):
            self.i += 1
            left = ("and", left, self.negated())
        return left

    def negated(self):
        if self.peek() == "NOT":
            self.i += 1
            return ("not", self.negated())
        if self.compat:
            return self.atom()
        left = self.atom()
        if self.peek() in ("=", "<>", "<", ">", "<=", ">="):
            op = self.w[self.i]
            self.i += 1
            right = self.atom()
            return ("name", f"{_shown(left)} {op} {_shown(right)}")
        return left

    def atom(self):
        if self.i >= len(self.w):
            return ("true",)
        w = self.w[self.i]
        self.i += 1
        if w == "(":
            inner = self.either()
            if self.peek() == ")":
                self.i += 1
            return inner
        up = w.upper()
        if up in ("TRUE", "BOOL#TRUE"):
            return ("true",)
        if up in ("FALSE", "BOOL#FALSE"):
            return ("false",)
        # A call, as in `ABS(x)`, is one name with its brackets.
        if not self.compat and self.peek() == "(" and _NAME.fullmatch(w):
            depth, text = 0, w
            while self.i < len(self.w):
                t = self.w[self.i]
                self.i += 1
                depth += (t == "(") - (t == ")")
                text += t
                if depth == 0:
                    break
            return ("name", text)
        while not self.compat and self.peek() in ("+", "-", "*", "/"):
            w += " " + self.w[self.i] + " " + (self.w[self.i + 1] if self.i + 1 < len(self.w) else "")
            self.i += 2
        return ("name", w)


def _shown(node) -> str:
    return node[1] if node[0] == "name" else node[0].upper()


def _ways(node, want: bool) -> list[dict[str, tuple[str, bool]]]:
    """The ways in which a node takes the wanted value: by upper-cased name, as the language has it, the name and what it needs."""
    kind, *parts = node
    if kind in ("true", "false"):
        return [{}] if want == (kind == "true") else []
    if kind == "name":
        return [{parts[0].upper(): (parts[0], want)}]
    if kind == "not":
        return _ways(parts[0], not want)
    if kind == "xor":
        out = [w for left in (True, False) for w in _together(_ways(parts[0], left), _ways(parts[1], left != want))]
    elif (kind == "and") == want:
        out = _together(*(_ways(p, want) for p in parts))
    else:
        out = [w for p in parts for w in _ways(p, want)]
    if len(out) > MOST_PATHS:
        raise ValueError(f"a condition has more than {MOST_PATHS} paths")
    return out


def _together(first: list[dict], second: list[dict]) -> list[dict]:
    """Every way of the first with every one of the second that asks for nothing else of the same name."""
    return [a | {k: v for k, v in b.items() if k not in a} for a in first for b in second if all(a[k][1] == b[k][1] for k in a.keys() & b.keys())]


def truth_paths(condition: str, compat: bool = False) -> list[list[tuple[str, bool]]]:
    """The ways in which a condition becomes true: names with the values that they need together."""
    words = _words(condition, compat)
    if not words:
        return []
    paths = [list(w.values()) for w in _ways(_Reader(words, compat).either(), True)]
    if not paths and compat:
        names = [w for w in words if w.upper() not in ("AND", "OR", "NOT", "(", ")", "TRUE", "FALSE")]
        return [[(n, True) for n in names]] if names else []
    return paths


def guard_condition(guard: str) -> str:
    """The condition that a guard of `assignments` stands for; an ELSE negates its IF."""
    m = re.match(r"ELSE@\d+ \(zu IF: (.*)\)$", guard, re.S)
    if m:
        return f"NOT ({m.group(1)})"
    return guard.split(": ", 1)[1] if ": " in guard else guard


# --- calls and declarations --------------------------------------------------------------------------------


def calls(code: str, instance: str | None = None) -> list[tuple[int, str, int, dict[str, str]]]:
    """(line, instance, how manieth call of it, parameters) of each call statement."""
    clean = strip_comments(code)
    out, count = [], {}
    for m in re.finditer(r"(?m)(?:^|;|\bTHEN\b|\bELSE\b|\bDO\b)\s*([A-Za-z_]\w*)\s*\(", clean, re.I):
        name = m.group(1)
        if name.upper() in ("IF", "ELSIF", "WHILE", "UNTIL", "NOT", "AND", "OR", "FOR", "CASE"):
            continue
        end = _balanced(clean, m.end() - 1)
        if end < 0 or not re.match(r"\s*;", clean[end:]):
            continue
        if instance is not None and name.lower() != instance.lower():
            continue
        count[name] = count.get(name, 0) + 1
        params = {}
        for part in split_top(clean[m.end() : end - 1]):
            key, sign, value = part.partition(":=")
            if sign:
                params[key.strip()] = re.sub(r"\s+", " ", value).strip()
        out.append((clean.count("\n", 0, m.start(1)) + 1, name, count[name], params))
    return out


def declarations(header: str) -> list[tuple[str, str, str, str, str]]:
    """(block, name, address, type, init) of each declared variable, by VAR block."""
    out = []
    for m in re.finditer(r"(?is)\b(VAR(?:_INPUT|_OUTPUT|_IN_OUT|_TEMP|_GLOBAL)?)\b(?:\s+(?:CONSTANT|RETAIN|PERSISTENT))*(.*?)\bEND_VAR\b", strip_comments(header)):
        for line in split_top(m.group(2), ";"):
            d = re.match(r"(?is)([\w\s,]+?)(?:\s+AT\s+(%\S+))?\s*:\s*(.*?)(?:\s*:=\s*(.*))?$", re.sub(r"\{.*?\}", "", line).strip())
            if d:
                for name in d.group(1).split(","):
                    out.append((m.group(1).upper(), name.strip(), d.group(2) or "", re.sub(r"\s+", " ", d.group(3)).strip(), (d.group(4) or "").strip()))
    return out


def language(xml: str) -> str | None:
    """The first of ST, FBD, LD, SFC and IL that an implementation has."""
    return next((x for x in ("ST", "FBD", "LD", "SFC", "IL") if re.search(rf"<(?:\w+:)?{x}[\s/>]", xml)), None)


# --- block diagrams ----------------------------------------------------------------------------------------


@dataclass
class Node:
    """A value of a block diagram, with the block that makes it."""

    name: str
    block: str | None = None
    args: list[Node] = field(default_factory=list)

    def shown(self) -> str:
        return f"{self.block}({', '.join(a.shown() for a in self.args)})" if self.block else self.name


def diagram(code: str) -> dict[str, tuple[str | None, list[str]]]:
    """`V = BLOCK(args)` and `X = V` lines: each name's block and arguments."""
    out: dict[str, tuple[str | None, list[str]]] = {}
    for line in strip_comments(code).split("\n"):
        m = re.match(r"\s*([\w.]+)\s*:?=\s*(.*?);?\s*$", line)
        if not m or not m.group(2):
            continue
        c = re.match(r"([A-Za-z_]\w*)\s*\((.*)\)$", m.group(2), re.S)
        out[m.group(1)] = (c.group(1), split_top(c.group(2))) if c else (None, [m.group(2).strip()])
    return out


def tree(blocks: dict[str, tuple[str | None, list[str]]], name: str, depth: int = 35) -> Node:
    """What a name is made of; a loop, or a depth beyond the limit, ends in the plain name."""

    def grow(n: str, left: int, above: frozenset[str]) -> Node:
        if n not in blocks or left == 0 or n in above:
            return Node(n)
        block, args = blocks[n]
        if block is None:
            return grow(args[0], left - 1, above | {n})
        return Node(n, block, [grow(a, left - 1, above | {n}) for a in args])

    return grow(name, depth, frozenset())


def set_and_reset(code: str, symbol: str) -> dict[str, str | None]:
    """The set and reset side of the latch (RS or SR) that a symbol comes from; without a latch all is the set side."""
    blocks = diagram(code)
    source = blocks.get(symbol, (None, [symbol]))[1][0] if blocks.get(symbol, (1,))[0] is None else symbol
    top = tree(blocks, symbol)
    if top.block and re.match(r"(?i)(RS|SR)(_|\d|$)", top.block) and len(top.args) >= 2:
        return {"from": source, "block": top.block, "set": top.args[0].shown(), "reset": top.args[1].shown()}
    return {"from": source, "block": top.block, "set": top.shown(), "reset": None}


def edges(code: str) -> list[tuple[str, str, int, str]]:
    """(name, block, argument's place, argument) of each block."""
    return [(n, b, k, a) for n, (b, args) in diagram(code).items() if b for k, a in enumerate(args)]


def state_branch(branches: list[list[str]], last_state: str | None = None) -> int:
    """Which branch of an OR a machine took: the one that names its last state, else the only best.

    Better is a branch with more states of automatic (A) or running (F) kind, then fewer stops (D), then fewer
    other names, then fewer names at all. If not exactly one is best, that is an error.
    """
    if last_state:
        hits = [k for k, b in enumerate(branches) if last_state.lower() in (x.split(".")[-1].lower() for x in b)]
        if len(hits) == 1:
            return hits[0]

    def rank(b: list[str]) -> tuple[int, int, int, int]:
        run = sum(bool(re.fullmatch(r"(?i)[AF]\d+", x)) for x in b)
        stop = sum(bool(re.fullmatch(r"(?i)D\d+", x)) for x in b)
        return (run, -stop, -(len(b) - run - stop), -len(b))

    ranks = [rank(b) for b in branches]
    best = [k for k, r in enumerate(ranks) if r == max(ranks)]
    if len(best) != 1:
        raise ValueError("no single branch is best")
    return best[0]


# --- tables ------------------------------------------------------------------------------------------------


def _table(df: DataFrame, key: str, code: str, rows: Callable[[str], Iterable[tuple]], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, *r) for k, c in zip(batch["k"], batch["c"]) if c is not None for r in rows(c)]
            yield pd.DataFrame(out, columns=[key, *names])

    kind = dict(df.dtypes)[key]
    return df.selectExpr(f"`{key}` as k", f"`{code}` as c").mapInPandas(run, f"`{key}` {kind}, {schema}")


def assignments_table(df: DataFrame, key: str, code: str) -> DataFrame:
    """(key, line, variable, rhs, guards) of all assignments in a column of code."""
    return _table(df, key, code, assignments, "line int, variable string, rhs string, guards array<string>")


def calls_table(df: DataFrame, key: str, code: str) -> DataFrame:
    return _table(df, key, code, calls, "line int, instance string, call_index int, params map<string,string>")


def declarations_table(df: DataFrame, key: str, code: str) -> DataFrame:
    return _table(df, key, code, declarations, "block string, name string, address string, type string, init string")


def paths_table(df: DataFrame, key: str, condition: str, compat: bool = False) -> DataFrame:
    """(key, path, place, token, required) of all truth paths of a column of conditions."""

    def rows(text: str) -> Iterator[tuple]:
        for p, path in enumerate(truth_paths(text, compat)):
            for k, (token, need) in enumerate(path):
                yield p, k, token, need

    return _table(df, key, condition, rows, "path int, place int, token string, required boolean")


def edges_table(df: DataFrame, key: str, code: str) -> DataFrame:
    return _table(df, key, code, edges, "node string, block string, place int, argument string")
