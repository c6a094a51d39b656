"""Diagnosis of incidents: what kind of signal a variable is, who sets a trigger, where a path is anchored, what led to it.

Rows of a path have (incident, nth, token, value, pou, kind, assignment, source, reason), `nth` in their order. All
work is by incident, so that any number of incidents spreads over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafwerk.functions.text import if_guards, scope_score
from grafwerk.operators.graph import match

#: Places in a controller's image, as addresses name them.
PLACES = tuple(f"%{area}{size}" for area in "iqm" for size in "xwd")
#: Tokens of the known way from a periodic fault to the request for a diagnosis, in their order.
CHAIN = ("periodicfaultperiod", "tper.pt", "tper.q", "rper.q", "pper.q", "stoerung_erkannt", "auto_stoerung", "d2", "diagnose_gefordert", "rtreq.q")
#: Tokens that tell of a period.
PERIODIC = ("periodicfaultperiod", "tper.pt", "tper.in", "tper.q", "rper.q", "pper.q")


def _low(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def _any_of(text: Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def classify_variables(variables: DataFrame) -> DataFrame:
    """(name, is_bool, is_input, is_output, is_sensor, has_simulation) of variables (name, types, addresses, sources), arrays of texts."""

    def at(letter: str) -> Column:
        return F.exists("addresses", lambda a: F.upper(F.trim(a)).rlike(rf"^%{letter}|(^|\s){letter}\s*\d"))

    is_bool = F.exists("types", lambda t: F.upper(F.trim(t)) == "BOOL")
    flags = {"is_bool": is_bool, "is_input": at("I"), "is_output": at("Q"), "is_sensor": at("I") & is_bool, "has_simulation": F.exists("sources", lambda s: F.contains(F.upper(s), F.lit("_SIM")))}
    return variables.select("name", *(F.coalesce(c, F.lit(False)).alias(k) for k, c in flags.items()))


def choose_setter(setters: DataFrame, hints: DataFrame) -> DataFrame:
    """(incident, pou, snippet, condition): of the setters (incident, nth, pou, snippet) of a trigger the best.

    One with a snippet that sets it TRUE has 50 points; the best fit of its name with one of the incident's hints
    (incident, hint) counts besides. Of equal ones the first. The condition is the snippet's first guard.
    """
    fit = setters.select("incident", "nth", "pou").join(hints, "incident").groupBy("incident", "nth").agg(F.max(scope_score(F.col("pou"), F.col("hint"))).alias("fit"))
    has = F.length(F.coalesce("snippet", F.lit(""))) > 0
    scored = setters.join(fit, ["incident", "nth"], "left").withColumn("score", F.when(has, 50).otherwise(0) + F.coalesce("fit", F.lit(0)))
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("incident").orderBy(F.desc("score"), "nth"))).where("rank = 1")
    return best.select("incident", "pou", F.coalesce("snippet", F.lit("")).alias("snippet"), F.coalesce(F.get(if_guards(F.col("snippet"), 1), F.lit(0)), F.lit("")).alias("condition"))


def anchor_scores(rows: DataFrame) -> DataFrame:
    """The rows with `score`: how well each could be a path's root.

    Places in the controller's image, wiring and defaults speak for it; inputs and calls of job methods against.
    """
    token, source, kind, reason, assignment = (_low(c) for c in ("token", "source", "kind", "reason", "assignment"))
    text = F.concat_ws(" | ", *(_low(c) for c in ("token", "pou", "value", "assignment", "source", "reason")))
    place = _any_of(text, ("hardware_address", "dp_hashardwareaddress", *PLACES))
    points = (
        (place, 180),
        (place & source.isin("global", "metadata"), 50),
        (source == "wiring", 70),
        (kind.isin("global_variable", "terminal"), 25),
        (F.contains(F.concat_ws(" ", assignment, source, reason), F.lit("default")), 30),
        (F.startswith(token, F.lit("gvl_")) | F.startswith(token, F.lit("opcua.")), 8),
        ((source == "job_method") | (kind == "job_method_input") | F.contains(reason, F.lit("job-method input")), -220),
        (F.contains(token, F.lit("methodcall")), -120),
        (token.isin("hdl", "start", "abort", "checkstate"), -80),
        (F.contains(token, F.lit("jobrunning")), -40),
    )
    score = F.least(F.lit(10), F.col("nth").cast("int"))
    for when, n in points:
        score = score + F.when(when, n).otherwise(0)
    return rows.withColumn("score", score)


def anchors(rows: DataFrame) -> DataFrame:
    """The row of each incident that its path is best anchored at; of equal ones the first."""
    order = Window.partitionBy("incident").orderBy(F.desc("score"), "nth")
    return anchor_scores(rows).withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def bridges(rows: DataFrame, most: int = 10) -> DataFrame:
    """(incident, pou, assignment, place): the first different assignments with an arrow, up to their `[`."""
    arrow = rows.where(F.contains("assignment", F.lit("<=")) | F.contains("assignment", F.lit("=>")))
    named = arrow.select("incident", "nth", F.coalesce(F.nullif(F.trim("pou"), F.lit("")), F.lit("-")).alias("pou"), F.trim(F.substring_index("assignment", "[", 1)).alias("assignment"))
    first = named.groupBy("incident", "pou", "assignment").agg(F.min("nth").alias("nth"))
    place = F.row_number().over(Window.partitionBy("incident").orderBy("nth"))
    return first.withColumn("place", place).where(F.col("place") <= most).drop("nth")


def causal_chain(rows: DataFrame, end: str = "OPCUA.TriggerD2") -> DataFrame:
    """(incident, chain): the anchor's token, the known tokens that the path has, in their order and as first written, and the end."""
    nth = F.coalesce(*(F.when(_low("token") == t, k) for k, t in enumerate(CHAIN)))
    known = rows.withColumn("k", nth).where("k IS NOT NULL").groupBy("incident", "k").agg(F.min_by(F.trim("token"), "nth").alias("token"))
    listed = known.groupBy("incident").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "token"))), lambda x: x["token"]).alias("known"))
    root = anchors(rows).select("incident", F.trim("token").alias("root"))
    head = F.filter(F.array("root"), lambda x: x != "")
    whole = F.concat(head, F.coalesce("known", F.array().cast("array<string>")), F.array(F.lit(end)))
    return root.join(listed, "incident", "left").select("incident", F.array_distinct(whole).alias("chain"))


def periodicity(rows: DataFrame, most: int = 12) -> DataFrame:
    """(incident, place, evidence): the first different rows that tell of a period, as `token=… | value=… | pou=…`."""
    token, assignment, source, reason = (_low(c) for c in ("token", "assignment", "source", "reason"))
    default = F.contains(F.concat_ws(" ", assignment, source, reason), F.lit("default"))
    timer = F.contains(F.concat_ws(" ", assignment, source), F.lit("tper(")) | F.contains(F.concat_ws(" ", assignment, source), F.lit("not tper.q"))
    keep = token.isin(*PERIODIC) | timer | (default & token.isin("periodicfaultperiod", "faultpulse"))

    def part(name: str, c: Column) -> Column:
        return F.when(c != "", F.concat(F.lit(f"{name}="), c))

    t, v, p, a, s = (F.trim(F.coalesce(c, F.lit(""))) for c in ("token", "value", "pou", "assignment", "source"))
    text = F.concat_ws(" | ", part("token", F.when(t == "", "?").otherwise(t)), part("value", v), part("pou", F.when(p == "", "-").otherwise(p)), part("assignment", a), part("source", s))
    first = rows.where(keep).groupBy("incident", text.alias("evidence")).agg(F.min("nth").alias("nth"))
    place = F.row_number().over(Window.partitionBy("incident").orderBy("nth"))
    return first.withColumn("place", place).where(F.col("place") <= most).select("incident", "place", "evidence")


def runtime_functions(graph: DataFrame, skills: DataFrame) -> DataFrame:
    """(skill, function) of skills (skill): the functions of that runtime name; where there are none, the function of that very name."""
    named = match(graph, p="dp:hasRuntimeSkillName").select(F.col("o").alias("skill"), F.col("s").alias("function")).distinct()
    found = skills.select("skill").distinct().join(named, "skill")
    typed = match(graph, p="http://www.w3.org/1999/02/22-rdf-syntax-ns#type").where(F.col("o").rlike(r"class_(Process)?Function$")).select(F.col("s").alias("function")).distinct()
    by_name = typed.withColumn("skill", F.regexp_extract("function", "([^/#]*)$", 1))
    rest = skills.select("skill").distinct().join(found.select("skill").distinct(), "skill", "left_anti")
    return found.select("skill", "function").unionByName(rest.join(by_name, "skill").select("skill", "function"))


def bundle(sections: dict[str, DataFrame]) -> DataFrame:
    """(section, nth, item): the rows of several answers as JSON, numbered in each: what a diagnosis is made from."""
    out: DataFrame | None = None
    for name, rows in sections.items():
        item = rows.select(F.lit(name).alias("section"), F.to_json(F.struct(*rows.columns)).alias("item"))
        out = item if out is None else out.unionByName(item)
    if out is None:
        raise ValueError("a bundle has one section at least")
    return out.withColumn("nth", F.row_number().over(Window.partitionBy("section").orderBy("item"))).select("section", "nth", "item")


def diagnosis(rows: DataFrame, setters: DataFrame, hints: DataFrame, variables: DataFrame) -> DataFrame:
    """(section, nth, item): setter, anchor, chain, bridges, periods and signals of all incidents in one table."""
    return bundle(
        {
            "setter": choose_setter(setters, hints),
            "anchor": anchors(rows).select("incident", "token", "pou", "score"),
            "chain": causal_chain(rows),
            "bridge": bridges(rows),
            "period": periodicity(rows),
            "signal": classify_variables(variables),
        }
    )
