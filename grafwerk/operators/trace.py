"""Tracing of boolean logic: what must hold for a variable to take a value, back to its terminal sources."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grafwerk.functions import stcode
from grafwerk.model import AG
from grafwerk.operators.graph import cut, match

ROW = "path string, depth int, token string, value boolean, pou string, kind string, reason string, source string"
_TIMERS = {"R_TRIG": ("CLK",), "F_TRIG": ("CLK",), "TON": ("IN", "PT"), "TOF": ("IN", "PT"), "TP": ("IN", "PT")}


@dataclass
class Unit:
    """What tracing knows of a POU."""

    code: str
    types: dict[str, str]  # types of its variables, by lower-cased name
    defaults: dict[str, str]
    hardware: dict[str, str]


def trace(pous: dict[str, Unit], pou: str, token: str, value: bool = True, depth: int = 12, assumed_false: frozenset[str] = frozenset(), condition: bool = False) -> list[tuple]:
    """Requirement rows (path, depth, token, value, pou, kind, reason, source), depth first.

    An alternative of a condition adds `.i` to the path. A token that its own path has had before is a loop; a
    token may come again on a sibling branch. With `condition` the token is a whole expression of the POU. One with
    too many alternatives ends in a row `stop`.
    """
    out: list[tuple] = []

    def add(path: str, d: int, t: str, v: bool, p: str, kind: str, reason: str, source: str = "") -> None:
        out.append((path, d, t, v, p, kind, reason, source))

    def expression(text: str, v: bool, p: str, path: str, d: int, above: frozenset) -> None:
        try:
            paths = stcode.truth_paths(text if v else f"NOT ({text})")
        except ValueError as e:
            return add(path, d, text, v, p, "stop", str(e))
        for i, branch in enumerate(paths, 1):
            at = f"{path}.{i}" if len(paths) > 1 else path
            for t, need in branch:
                follow(t, need, p, at, d, above)

    def follow(t: str, v: bool, p: str, path: str, d: int, above: frozenset) -> None:
        key = (p, t.lower(), v)
        unit = pous.get(p)
        low = t.lower()
        if t.upper().startswith(("T#", "TIME#")):
            return add(path, d, t, v, p, "time_literal", "a time")
        if low in assumed_false or low.split(".")[-1] in assumed_false:
            return add(path, d, t, v, p, "assumption", "assumed false")
        if key in above:
            return add(path, d, t, v, p, "loop", "met before on this path")
        if d >= depth:
            return add(path, d, t, v, p, "stop", "depth")
        if unit is None:
            return add(path, d, t, v, p, "unknown", "no such POU")
        below = above | {key}
        head, dot, port = t.partition(".")
        if low in unit.hardware:
            return add(path, d, t, v, p, "terminal", "hardware", unit.hardware[low])
        if dot and head.lower() in unit.types:
            kind = unit.types[head.lower()]
            if kind.upper() in _TIMERS and port.upper() == "Q":
                add(path, d, t, v, p, "std_fb_dependency", kind)
                params = {k.upper(): e for _, _, _, ps in stcode.calls(unit.code, head) for k, e in ps.items()}
                for need in _TIMERS[kind.upper()]:
                    if need in params and need != "PT":
                        expression(params[need], v, p, path, d + 1, below)
                    elif need in params:
                        add(path, d + 1, params[need], True, p, "temporal_note", f"{head}.{need}")
                return None
            add(path, d, t, v, p, "instance_port", kind)
            if kind in pous:
                follow(port, v, kind, path, d + 1, below)
            return None
        if dot:
            return add(path, d, t, v, p, "global_variable", "global")
        found = stcode.assignments(unit.code, t)
        fits = [a for a in found if a[2].upper() == ("TRUE" if v else "FALSE")] or [a for a in found if a[2].upper() not in ("TRUE", "FALSE")]
        if fits:
            line, _, rhs, guards = fits[-1]  # the last one wins when all run
            add(path, d, t, v, p, "internal_assignment", f"line {line}", rhs)
            for g in guards:
                expression(stcode.guard_condition(g), True, p, path, d + 1, below)
            if rhs.upper() not in ("TRUE", "FALSE"):
                expression(rhs, v, p, path, d + 1, below)
            return None
        if low in unit.defaults:
            return add(path, d, t, v, p, "terminal", "default", unit.defaults[low])
        if low in unit.types:
            return add(path, d, t, v, p, "internal_variable", unit.types[low])
        return add(path, d, t, v, p, "unknown", "no source")

    if condition:
        expression(token, value, pou, "1", 1, frozenset())
    else:
        follow(token, value, pou, "1", 0, frozenset())
    return out


def units(graph: DataFrame) -> DataFrame:
    """(pou, code, types, defaults, hardware) of each named POU, as maps by lower-cased variable name."""
    name = match(graph, p="dp:hasPOUName").groupBy("s").agg(F.min("o").alias("pou"))
    code = match(graph, p="dp:hasPOUCode").groupBy("s").agg(F.min("o").alias("code"))
    var = match(graph, p=["op:hasInternalVariable", "op:usesVariable"]).select("s", F.col("o").alias("v")).distinct()
    facts = match(graph, p=["dp:hasVariableName", "dp:hasVariableType", "dp:hasDefaultValue", "dp:hasHardwareAddress"])

    def of(p: str):
        return F.max(F.when(F.col("p") == f"{AG}dp_{p}", F.col("o")))

    per = facts.groupBy(F.col("s").alias("v")).agg(of("hasVariableType").alias("t"), of("hasDefaultValue").alias("d"), of("hasHardwareAddress").alias("h"))
    names = facts.where(F.col("p") == f"{AG}dp_hasVariableName").select(F.col("s").alias("v"), F.lower("o").alias("n"))
    rows = var.join(names, "v").join(per, "v").groupBy("s", "n").agg(F.max("t").alias("t"), F.max("d").alias("d"), F.max("h").alias("h"))

    def mapped(c: str):
        return F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("n", c))))).alias({"t": "types", "d": "defaults", "h": "hardware"}[c])

    maps = rows.groupBy("s").agg(mapped("t"), mapped("d"), mapped("h"))
    return name.join(code, "s", "left").join(maps, "s", "left").select("pou", "code", "types", "defaults", "hardware")


def condition_rows(graph: DataFrame, incidents: DataFrame, depth: int = 12, assumed_false: Sequence[str] = ("d1", "d2", "d3")) -> DataFrame:
    """Requirement rows of incidents (incident, pou, token, value) whose `token` is an expression of the POU.

    States in `assumed_false` are taken as false and not followed.
    """
    return requirement_rows(graph, incidents, depth, assumed_false, condition=True)


def unified_rows(graph: DataFrame, incidents: DataFrame, state: str = "D2", depth: int = 12) -> DataFrame:
    """Requirement rows of what leads to a state in POUs (incident, pou): the guards of the last assignment that makes it true, and theirs."""
    return requirement_rows(graph, incidents.select("incident", "pou", F.lit(state).alias("token"), F.lit(True).alias("value")), depth)


def requirement_rows(graph: DataFrame, incidents: DataFrame, depth: int = 12, assumed_false: Sequence[str] = (), condition: bool = False) -> DataFrame:
    """Requirement rows of each incident (incident, pou, token, value).

    An incident is traced by one task. It sees the POUs of its own project only (all of them here: controller
    code is small, thousands of lines); the incidents are what grows, and they spread over the cluster.
    """
    known = [r.asDict(recursive=True) for r in units(graph).collect()]
    table = {r["pou"]: Unit(r["code"] or "", r["types"] or {}, r["defaults"] or {}, r["hardware"] or {}) for r in known}
    shared, false = graph.sparkSession.sparkContext.broadcast(table), frozenset(x.lower() for x in assumed_false)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r.incident, *x) for r in batch.itertuples() for x in trace(shared.value, r.pou, r.token, bool(r.value), depth, false, condition)]
            yield pd.DataFrame(rows, columns=["incident", *(c.split()[0] for c in ROW.split(", "))])

    kind = dict(incidents.dtypes)["incident"]
    return incidents.select("incident", "pou", "token", "value").mapInPandas(run, f"incident {kind}, {ROW}")


def requirement_table(rows: DataFrame) -> DataFrame:
    """The rows in the order of their paths, numbered."""
    order = Window.partitionBy("incident").orderBy("path", "depth", "token")
    return rows.withColumn("row", F.row_number().over(order))


def terminal_summary(rows: DataFrame) -> DataFrame:
    """(incident, hardware, defaults, loops, stops, unknown, assessment) by how its paths end."""
    per = rows.groupBy("incident").agg(
        F.count_if((F.col("kind") == "terminal") & (F.col("reason") == "hardware")).alias("hardware"),
        F.count_if((F.col("kind") == "terminal") & (F.col("reason") == "default")).alias("defaults"),
        F.count_if(F.col("kind") == "loop").alias("loops"),
        F.count_if(F.col("kind") == "stop").alias("stops"),
        F.count_if(F.col("kind") == "unknown").alias("unknown"),
    )
    text = F.when(F.col("hardware") > 0, "hardware").when(F.col("defaults") > 0, "default value").when(F.col("unknown") > 0, "unknown").otherwise("software")
    return per.withColumn("assessment", text)


def variable_paths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, path): the simple paths over `edges` (src, dst) that end where no edge goes on.

    A path carries what it has met, so that loops end it and the search, without a bound; the frontier is cut off after each step.
    """
    edges = cut(edges.select("src", "dst").distinct())
    frontier = cut(starts.select(F.col("start"), F.array("start").alias("path"), F.col("start").alias("last")))
    ends: DataFrame | None = None
    while True:
        joined = frontier.join(edges, F.col("last") == F.col("src"), "left")
        go = joined.where(F.col("dst").isNotNull() & ~F.expr("array_contains(path, dst)"))
        onward = cut(go.select("start", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("last")))
        done = cut(frontier.join(go.select(F.col("path").alias("kept")).distinct(), F.col("path") == F.col("kept"), "left_anti").select("start", "path"))
        ends = done if ends is None else ends.unionByName(done)
        frontier = onward
        if frontier.isEmpty():
            return ends


def investigate(graph: DataFrame, terms: list[str], iterations: int = 40, nodes: int = 240) -> DataFrame:
    """(step, s, p, o): triples met by walking out from the nodes that mention the terms, a ring at a time, within the caps."""
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(F.lower("o"), F.lit(t.lower())) | F.contains(F.lower("s"), F.lit(t.lower()))
    graph = cut(graph.select("s", "p", "o", "o_kind"))
    seen = cut(graph.where(hit).select(F.col("s").alias("node")).distinct().orderBy("node").limit(nodes))
    frontier, parts = seen, []
    for step in range(iterations):
        out_of, into = frontier.withColumnRenamed("node", "s"), frontier.withColumnRenamed("node", "o")
        near = graph.join(out_of, "s").unionByName(graph.join(into, "o"))
        near = cut(near.select("s", "p", "o", "o_kind").distinct())
        parts.append(near.select(F.lit(step).alias("step"), "s", "p", "o"))
        new = near.where("o_kind = 'iri'").select(F.explode(F.array("s", "o")).alias("node")).distinct().join(seen, "node", "left_anti")
        left = nodes - seen.count()
        if left <= 0:
            break
        frontier = cut(new.orderBy("node").limit(left))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("s", "p", "o").agg(F.min("step").alias("step")).select("step", "s", "p", "o")
