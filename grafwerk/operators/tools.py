"""The named query tools over a graph, and their registry.

Each takes the triples and keyword arguments and returns a DataFrame of strings. Where a limit cuts, the order
before it is total, so that the answer is one and the same every time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafwerk.model import iri
from grafwerk.operators.graph import infer_types, match, overlap, pairs, schema_card, search_terms, signatures, similar
from grafwerk.plans import sparql


def _text(value: str) -> str:
    return '"' + value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def list_programs(graph: DataFrame) -> DataFrame:
    """Names of all programs, sorted."""
    return sparql.select(graph, "SELECT ?program WHERE { ?p a ag:class_Program ; dp:hasProgramName ?program } ORDER BY ?program")


def called_pous(graph: DataFrame, program: str) -> DataFrame:
    """Names of what a program calls, once for each call."""
    return sparql.select(
        graph,
        f"SELECT ?callee WHERE {{ ?p dp:hasProgramName {_text(program)} . ?p op:containsPOUCall ?c . ?c op:callsPOU ?t . ?t dp:hasPOUName ?callee }} ORDER BY ?callee",
    )


def pou_callers(graph: DataFrame, pou: str) -> DataFrame:
    """Names of the programs and types that call a POU."""
    return sparql.select(
        graph,
        f"SELECT DISTINCT ?caller WHERE {{ ?t dp:hasPOUName {_text(pou)} . ?c op:callsPOU ?t . ?p op:containsPOUCall ?c . ?p (dp:hasProgramName|dp:hasPOUName) ?caller }} ORDER BY ?caller",
    )


def pou_code(graph: DataFrame, pou: str) -> DataFrame:
    return sparql.select(graph, f"SELECT ?code WHERE {{ ?t (dp:hasPOUName|dp:hasProgramName) {_text(pou)} ; dp:hasPOUCode ?code }}")


def search_variables(graph: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Typed variables whose name contains the text in any case."""
    return sparql.select(
        graph,
        f"SELECT DISTINCT ?name ?type WHERE {{ ?v dp:hasVariableName ?name ; dp:hasVariableType ?type . FILTER(CONTAINS(LCASE(STR(?name)), LCASE({_text(text)}))) }} ORDER BY ?name ?type LIMIT {limit}",
    )


def variable_trace(graph: DataFrame, name: str, limit: int = 30) -> DataFrame:
    """What is known of a variable, or of a port instance whose expression has that name."""
    return sparql.select(
        graph,
        f"""SELECT DISTINCT ?kind ?pou ?type ?address WHERE {{
          {{ ?v dp:hasVariableName ?n . FILTER(LCASE(?n) = LCASE({_text(name)})) BIND("variable" AS ?kind)
             OPTIONAL {{ ?v dp:hasVariableType ?type }} OPTIONAL {{ ?v dp:hasHardwareAddress ?address }}
             OPTIONAL {{ ?u (op:hasInternalVariable|op:usesVariable) ?v . ?u (dp:hasProgramName|dp:hasPOUName) ?pou }} }}
          UNION
          {{ ?i dp:hasExpressionText ?n . FILTER(LCASE(?n) = LCASE({_text(name)})) BIND("port" AS ?kind)
             OPTIONAL {{ ?i op:isPortOfInstance ?f . OPTIONAL {{ ?f op:isInstanceOfFBType ?t . ?t dp:hasPOUName ?type }} }} }}
        }} ORDER BY ?kind ?pou ?type ?address LIMIT {limit}""",
    )


def general_search(graph: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """POUs, programs, variables and ports whose name, or encoded IRI, contains the text."""
    branches = " UNION ".join(
        f'{{ ?s dp:{p} ?name . BIND("{kind}" AS ?kind) }}' for kind, p in (("pou", "hasPOUName"), ("program", "hasProgramName"), ("variable", "hasVariableName"), ("port", "hasPortName"))
    )
    by_iri = text.replace(".", "__dot__")
    return sparql.select(
        graph,
        f"SELECT DISTINCT ?kind ?name WHERE {{ {branches} FILTER(CONTAINS(LCASE(?name), LCASE({_text(text)})) || CONTAINS(LCASE(STR(?s)), LCASE({_text(by_iri)}))) }} ORDER BY ?kind ?name LIMIT {limit}",
    )


def string_triple_search(graph: DataFrame, text: str, limit: int = 30) -> DataFrame:
    return search_terms(graph, text, limit)


def code_search(graph: DataFrame, text: str) -> DataFrame:
    """Names of the POUs whose code contains the text in any case."""
    return sparql.select(graph, f"SELECT ?pou WHERE {{ ?t dp:hasPOUCode ?code ; dp:hasPOUName ?pou . FILTER(CONTAINS(LCASE(?code), LCASE({_text(text)}))) }} ORDER BY ?pou")


def text2sparql_select(graph: DataFrame, answer: str, most: int = 200) -> DataFrame:
    """Run a query that a model wrote: taken out of its text, guarded and limited."""
    return sparql.select(graph, sparql.guard(sparql.extract(answer), most, most))


def variable_context(graph: DataFrame, name: str) -> DataFrame:
    """Type, address and the sources that are assigned to the ports of a variable's name."""
    return sparql.select(
        graph,
        f"""SELECT DISTINCT ?type ?address ?source WHERE {{ ?v dp:hasVariableName {_text(name)} .
          OPTIONAL {{ ?v dp:hasVariableType ?type }} OPTIONAL {{ ?v dp:hasHardwareAddress ?address }}
          OPTIONAL {{ ?a op:assignsToPort ?port . ?port dp:hasPortName {_text(name)} . ?a op:assignsFrom ?x . ?x dp:hasExpressionText ?source }} }} ORDER BY ?type ?address ?source""",
    )


def input_wiring(graph: DataFrame, pou: str) -> DataFrame:
    """(port, source) of each input of a POU, once in any case of letters."""
    rows = sparql.select(
        graph,
        f"SELECT ?port ?source WHERE {{ ?t dp:hasPOUName {_text(pou)} ; op:hasPort ?q . ?q dp:hasPortName ?port ; dp:hasPortDirection \"Input\" . ?a op:assignsToPort ?q ; op:assignsFrom ?x . ?x dp:hasExpressionText ?source }}",
    )
    return rows.groupBy(F.lower("port").alias("k"), F.lower("source").alias("l")).agg(F.min("port").alias("port"), F.min("source").alias("source")).select("port", "source").orderBy("port", "source")


METHODS = ("op:hasStartMethod", "op:hasAbortMethod", "op:hasCheckStateMethod", "op:hasMethod")


def method_contexts(graph: DataFrame, owner: str) -> DataFrame:
    """(role, method, code) of an owner's methods; a method of several roles has the first."""
    rank = F.coalesce(*(F.when(F.col("p") == iri(p), k) for k, p in enumerate(METHODS)))
    have = match(graph, p=METHODS).select("s", F.col("o").alias("m"), rank.alias("k"))
    of = match(graph, p=["dp:hasPOUName"], o=owner, literal=True).select("s")
    rows = have.join(of, "s").groupBy("m").agg(F.min("k").alias("k"))
    name, code = pairs(graph, "dp:hasMethodName", "m", "method"), pairs(graph, "dp:hasPOUCode", "m", "code")
    role = F.element_at(F.array(*(F.lit(p.removeprefix("op:has").removesuffix("Method") or "Method") for p in METHODS)), F.col("k") + 1)
    return rows.join(name, "m", "left").join(code, "m", "left").orderBy("k", "method").select(role.alias("role"), "method", "code")


def failure_mode_params(graph: DataFrame, runtime_name: str) -> DataFrame:
    """Parameters of failure modes of the function with this runtime name, or of the node of this IRI."""
    return sparql.select(
        graph,
        f"""SELECT DISTINCT ?mode ?params WHERE {{
          {{ ?f dp:hasRuntimeName {_text(runtime_name)} . ?f op:hasFailureMode ?mode . ?mode dp:hasParams ?params }}
          UNION {{ VALUES ?f {{ {_text(runtime_name)} }} ?f op:hasFailureMode ?mode . ?mode dp:hasParams ?params }} }} ORDER BY ?mode ?params""",
    )


def actions(graph: DataFrame, mode: str, kind: str = "op:hasMonitoringAction") -> DataFrame:
    """Monitoring actions or system reactions of a failure mode, but those that only check parameters."""
    return sparql.select(
        graph,
        f"SELECT DISTINCT ?action ?params WHERE {{ <{iri(mode)}> {kind} ?action . ?action dp:hasParams ?params . FILTER(?action != IRI(<{iri('ag:checkParameters')}>)) }} ORDER BY ?action ?params",
    )


def signature_of(graph: DataFrame, program: str) -> DataFrame:
    return signatures(graph).where(F.col("name") == program)


def exception_prep(graph: DataFrame, program: str, sensors: list[str], k: int = 5) -> DataFrame:
    """The routines most similar to a program's, and which of the sensors each could check."""
    sigs = signatures(graph)
    near = similar(sigs, sigs.where(F.col("name") == program), k)
    wanted = F.array(*(F.lit(s) for s in sensors)) if sensors else F.array().cast("array<string>")
    have = sigs.select("name", F.concat_ws(",", F.array_sort(F.array_intersect(wanted, F.array_union("vars", "hw")))).alias("checkable"))
    return near.join(have, "name").select("probe", "name", "score", "rank", "checkable")


TOOLS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (
        list_programs,
        called_pous,
        pou_callers,
        pou_code,
        search_variables,
        variable_trace,
        general_search,
        string_triple_search,
        code_search,
        text2sparql_select,
        variable_context,
        input_wiring,
        method_contexts,
        failure_mode_params,
        actions,
        signature_of,
        exception_prep,
        schema_card,
        infer_types,
    )
}


def run(graph: DataFrame, tool: str, **args) -> DataFrame:
    """The answer of a tool; a wrong name or argument is told in a column `error`."""
    try:
        return TOOLS[tool](graph, **args)
    except (KeyError, TypeError, ValueError) as e:
        return graph.sparkSession.createDataFrame([(f"{type(e).__name__}: {e}",)], "error string")


def run_plan(graph: DataFrame, steps: list[dict]) -> dict[str, DataFrame]:
    """The answers of a plan's steps `{tool, args}`, by number and tool."""
    return {f"{k}:{s['tool']}": run(graph, s["tool"], **s.get("args", {})) for k, s in enumerate(steps)}


__all__ = ["TOOLS", "overlap", "run", "run_plan"]
