import pytest

from grafwerk.functions import text
from grafwerk.model import AG, iri, triples
from grafwerk.operators import enrich, graph, tools, trace
from grafwerk.plans import sparql

MAIN = "IF start AND t1.Q THEN\n  motor := TRUE;\nELSE\n  motor := FALSE;\nEND_IF;\nt1(IN := sensor, PT := T#2s);\nfb(go := GVL.run);\nlamp := fb.done;\n"


@pytest.fixture(scope="module")
def plant(spark):
    rows = [
        ("ag:Program_MAIN", "rdf:type", "ag:class_Program"),
        ("ag:Program_MAIN", "dp:hasProgramName", '"MAIN"'),
        ("ag:Program_MAIN", "dp:hasPOUName", '"MAIN"'),
        ("ag:Program_MAIN", "dp:hasPOUCode", f'"{MAIN}"'),
        ("ag:FBType_FB_X", "rdf:type", "ag:class_FBType"),
        ("ag:FBType_FB_X", "dp:hasPOUName", '"FB_X"'),
        ("ag:FBType_FB_X", "op:hasPort", "ag:Port_go"),
        ("ag:Port_go", "dp:hasPortName", '"go"'),
        ("ag:Port_go", "dp:hasPortDirection", '"Input"'),
        ("ag:L", "op:listsGlobalVariable", "ag:GVL__dot__run"),
        ("ag:GVL__dot__run", "dp:hasVariableName", '"GVL.run"'),
    ]
    for name, kind, more in (("start", "BOOL", None), ("motor", "BOOL", '"Q 0.1"'), ("sensor", "BOOL", '"I 0.0"'), ("t1", "TON", None), ("fb", "FB_X", None), ("lamp", "BOOL", '"Q 0.2"'), ("idle", "INT", None)):
        v = f"ag:Var_{name}"
        rows += [("ag:Program_MAIN", "op:hasInternalVariable", v), (v, "rdf:type", "ag:class_Variable"), (v, "dp:hasVariableName", f'"{name}"'), (v, "dp:hasVariableType", f'"{kind}"')]
        if more:
            rows.append((v, "dp:hasHardwareAddress", more))
    return triples(spark, rows)


@pytest.fixture(scope="module")
def full(plant):
    return graph.cut(enrich.analyze(plant))


def values(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def test_calls_and_wiring(full):
    assert values(tools.called_pous(full, "MAIN"), "callee") == {("FB_X",), ("TON",)}
    assert values(tools.pou_callers(full, "FB_X"), "caller") == {("MAIN",)}
    assert values(tools.input_wiring(full, "FB_X"), "port", "source") == {("go", "GVL.run")}


def test_flags_of_enrichment(full):
    flagged = values(graph.match(full, p="dp:isUnused"), "s")
    assert flagged == {(iri("ag:Var_idle"),)}
    assert values(graph.match(full, p="dp:isOutputLayer"), "s") == {(iri("ag:FBType_FB_X"),)}
    assert (iri("ag:class_CustomFBType"),) in values(graph.match(full, s="ag:FBType_FB_X", p="rdf:type"), "o")
    assert (iri("ag:class_POU"),) in values(graph.match(full, s="ag:FBType_TON", p="rdf:type"), "o")
    assert values(graph.match(full, s="ag:Program_MAIN", p="op:usesVariable"), "o") == {(iri("ag:GVL__dot__run"),)}
    report = graph.match(full, s="ag:Program_MAIN", p="dp:hasConsistencyReport").first()["o"]
    assert report == "POU MAIN | calls: FB_X, TON | unused: idle"


def test_analysis_twice_is_the_same(full):
    again = enrich.analyze(full)
    assert again.exceptAll(full).isEmpty() and full.exceptAll(again).isEmpty()


def test_trace_to_terminals(spark, full):
    inc = spark.createDataFrame([(1, "MAIN", "motor", True), (2, "MAIN", "nothing", True)], "incident int, pou string, token string, value boolean")
    rows = graph.cut(trace.requirement_rows(graph.remove_nodes(full, spark.createDataFrame([("none",)], "s string")), inc))
    got = {(r["incident"], r["token"], r["kind"]) for r in rows.collect()}
    assert (1, "motor", "terminal") in got and (2, "nothing", "unknown") in got
    unit = trace.Unit(MAIN, {"t1": "TON"}, {"start": "FALSE"}, {"sensor": "I 0.0"})
    traced = [(r[2], r[5]) for r in trace.trace({"MAIN": unit}, "MAIN", "motor")]
    assert traced == [("motor", "internal_assignment"), ("start", "terminal"), ("t1.Q", "std_fb_dependency"), ("sensor", "terminal"), ("T#2s", "temporal_note")]
    summary = {r["incident"]: r["assessment"] for r in trace.terminal_summary(rows).collect()}
    assert summary == {1: "hardware", 2: "unknown"}


def test_loops_end():
    unit = trace.Unit("a := b;\nb := a;", {}, {}, {})
    assert [r[5] for r in trace.trace({"P": unit}, "P", "a")] == ["internal_assignment", "internal_assignment", "loop"]


def test_simple_paths(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "a"), ("a", "d")], "src string, dst string")
    got = trace.variable_paths(e, spark.createDataFrame([("a",)], "start string"))
    assert {tuple(r["path"]) for r in got.collect()} == {("a", "b", "c"), ("a", "d")}


def test_variable_paths_of_long_chains(spark):
    e = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(24)] + [("n24", "n3")], "src string, dst string")
    got = trace.variable_paths(e, spark.createDataFrame([("n0",)], "start string"))
    assert [r["path"] for r in got.collect()] == [[f"n{k}" for k in range(25)]]


def test_investigate_walks_in_rings(full):
    rows = trace.investigate(full, ["GVL.run"], iterations=2)
    assert {r["step"] for r in rows.collect()} == {0, 1}


def test_simulation_mirror(spark):
    g = triples(spark, [("ag:r", "dp:hasVariableName", '"G.x"'), ("ag:r", "dp:hasHardwareAddress", '"I 0.0"'), ("ag:s", "dp:hasVariableName", '"G_Sim.x"'), ("ag:s", "dp:hasHardwareAddress", '"old"'), ("ag:t", "dp:hasVariableName", '"G_Sim.y"')])
    new, missing = enrich.mirror_simulation(g)
    assert values(graph.match(new, s="ag:s", p="dp:hasHardwareAddress"), "o") == {("I 0.0",)}
    assert values(missing, "name") == {("G_Sim.y",)}


def test_ingest(spark):
    io = "struct<internal:string,external:string,internal_type:string,opcua_da:boolean,opcua_write:boolean>"
    p = spark.createDataFrame(
        [("MAIN", "program", "ST", "x := 1;", [("a", "NOT (G.x)", "BOOL", True, False)], [], [], [("t", "INT")], [("Start", "BOOL", "y := 2;")])],
        f"Programm_Name string, pou_type string, programming_lang string, program_code string, inputs array<{io}>, outputs array<{io}>, inouts array<{io}>, temps array<struct<name:string,type:string>>, methods array<struct<method_name:string,return_type:string,code:string>>",
    )
    g = enrich.ingest_programs(p)
    assert values(tools.list_programs(g), "program") == {("MAIN",)}
    assert values(graph.match(g, p="dp:hasExternalExpression"), "o") == {("G.x",)}
    assert values(tools.method_contexts(g, "MAIN"), "role", "method") == {("Start", "Start")}
    gv = spark.createDataFrame([("G", [("x", "BOOL", "TRUE", "%I0.0", True, True)])], "name string, globals array<struct<name:string,type:string,init:string,address:string,opcua_da:boolean,opcua_write:boolean>>")
    both = enrich.ingest_gvls(gv)
    assert values(graph.match(both, p="dp:hasVariableName"), "o") == {("x",), ("G.x",)}
    link = spark.createDataFrame([("G.x", "D^Ch 1", "I", "I 0.0")], "plc_var string, io_path string, direction string, ea_address string")
    assert values(graph.match(enrich.ingest_io(both, link), p="dp:hasHardwareAddress"), "o") == {("I 0.0",)}
    head = spark.createDataFrame([(iri("ag:Program_MAIN"), "VAR\n t : INT := 7;\n u : BOOL := TRUE;\nEND_VAR")], "pou string, header string")
    d = enrich.default_values(g, head)
    assert values(graph.match(d, p="dp:hasDefaultValue"), "o") == {("7",), ("TRUE",)}


def test_sparql_shapes(plant):
    q = "SELECT DISTINCT ?n ?h WHERE { ?v dp:hasVariableName ?n . OPTIONAL { ?v dp:hasHardwareAddress ?h . FILTER(CONTAINS(?h, \"Q\")) } FILTER(REGEX(?n, \"^[ms]\")) } ORDER BY DESC(?n)"
    assert [tuple(r) for r in sparql.select(plant, q).collect()] == [("start", None), ("sensor", None), ("motor", "Q 0.1")]
    q = "SELECT ?n WHERE { { ?v dp:hasPOUName ?n } UNION { ?v dp:hasPortName ?n } } ORDER BY ?n LIMIT 2 OFFSET 1"
    assert [r["n"] for r in sparql.select(plant, q).collect()] == ["MAIN", "go"]
    q = 'SELECT ?k ?n WHERE { VALUES (?n ?k) { ("MAIN" "one") ("zzz" "two") } ?v (dp:hasPOUName|dp:hasProgramName) ?n }'
    assert len(sparql.select(plant, q).collect()) == 2
    assert sparql.select(plant, "SELECT ?n WHERE { ?v dp:hasVariableType ?t ; dp:hasVariableName ?n }", {"t": "TON"}).collect()[0]["n"] == "t1"


def test_guard():
    assert sparql.guard("SELECT ?s WHERE { ?s ?p ?o }").endswith("LIMIT 200")
    assert "LIMIT 200" in sparql.guard("SELECT ?s WHERE { ?s ?p ?o } LIMIT 9999")
    assert sparql.guard('SELECT ?s WHERE { ?s ?p "drop it" } LIMIT 5').endswith("LIMIT 5")
    for bad in ("DELETE WHERE { ?s ?p ?o }", "ASK { ?s ?p ?o }", "SELECT ?s WHERE { SERVICE <x:y> { ?s ?p ?o } }"):
        with pytest.raises(sparql.SparqlError):
            sparql.guard(bad)
    assert sparql.extract("Sure:\n```sparql\nSELECT ?x WHERE {}\n```") == "SELECT ?x WHERE {}"


def test_registry_tells_errors(plant):
    assert tools.run(plant, "no_such_tool").columns == ["error"]
    assert tools.run(plant, "pou_code", wrong=1).columns == ["error"]
    assert set(tools.run_plan(plant, [{"tool": "list_programs"}])) == {"0:list_programs"}


def test_scalar_functions(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("ns=3;s=OPCUA.x", "TRUE", "job 12", "FB_Job_1")], "a string, b string, c string, d string")
    r = df.select(
        text.node_id(F.col("a")).alias("n"), text.node_id(F.lit("OPCUA.y")).alias("m"), text.as_bool(F.col("b")).alias("b"), text.as_bool(F.lit("x")).alias("x"), text.safe_int(F.col("c")).alias("i"),
        text.scope_score(F.col("d"), F.lit("FB_Job")).alias("s"), text.hardware_kind(F.lit("%I0.0")).alias("h"), text.hardware_kind_loose(F.lit("AQ")).alias("q"), text.gemma_state(F.lit("F1")).alias("g"),
        text.humanize(F.lit("moveToBin_2")).alias("u"), text.sanitize_id(F.lit("a b-c!")).alias("z"), text.has_symbol(F.lit("x := a.b;"), "a.b").alias("y"), text.if_guards(F.lit("IF a\n AND b THEN x:=1; END_IF")).alias("f"),
        text.symbols(F.lit("IF foo AND g.h THEN // no\n x := 3; END_IF")).alias("k"), text.repaired_json(F.lit('{"jobId": J1}')).alias("j"), text.counterpart(F.lit("s_aussen")).alias("p"), text.declared_type(F.lit("UInt16")).alias("t"), text.preview(F.lit("ab  cd"), 4).alias("v"),
    ).first()
    assert tuple(r["n"]) == (3, "s", "OPCUA.x") and tuple(r["m"]) == (4, "s", "OPCUA.y")
    assert (r["b"], r["x"], r["i"], r["s"], r["h"], r["q"], r["g"]) == (True, None, 12, 60, "sensor", "actor", True)
    assert (r["u"], r["z"], r["y"], r["f"], r["k"]) == ("move To Bin 2", "a_b_c", True, ["a AND b"], ["foo", "g.h"])
    assert (r["j"], r["p"], r["t"], r["v"]) == ('{"jobId": "J1"}', "s_innen", "uint16", "a...")


def test_iri():
    assert iri("op:x") == f"{AG}op_x" and iri("plain") == "plain"


def test_closure_has_no_bound_of_depth(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(130)] + [(130, 40)], "src long, dst long")
    got = {r["dst"] for r in graph.closure(e, spark.createDataFrame([(0,)], "src long")).collect()}
    assert got == set(range(131))
    loops = graph.closure(e, spark.createDataFrame([(45,)], "src long"), reflexive=False).collect()
    assert {r["dst"] for r in loops} == set(range(40, 131))


def test_too_many_alternatives_are_told(spark):
    from grafwerk.operators import trace

    unit = trace.Unit("", {}, {}, {})
    rows = trace.trace({"P": unit}, "P", " AND ".join(f"(a{i} OR b{i})" for i in range(14)), condition=True)
    assert [r[5] for r in rows] == ["stop"]


@pytest.mark.parametrize("fit", [True, False])
@pytest.mark.parametrize("text_nodes", [True, False])
def test_closure_of_strong_components_in_either_way(spark, monkeypatch, fit, text_nodes):
    import random

    rng = random.Random(5)
    # A large component with nodes before and after it, a lesser ring apart, a loop, and a seed without edges.
    e = {(i, (i + 1) % 30) for i in range(30)} | {(rng.randrange(30), rng.randrange(30)) for _ in range(20)}
    e |= {(40, 41), (41, 3), (42, 41), (7, 50), (50, 51), (60, 61), (61, 60), (51, 52), (70, 70), (61, 50)}
    seeds = [0, 40, 42, 60, 50, 70, 99]
    want, proper = set(), set()
    for s in seeds:
        seen, ahead = set(), {s}
        while ahead:
            ahead = {b for a, b in e if a in ahead} - seen
            seen |= ahead
        proper |= {(s, d) for d in seen}
        want |= {(s, d) for d in seen | {s}}
    cast = (lambda v: f"n{v}") if text_nodes else int
    kind = "string" if text_nodes else "long"
    edges = spark.createDataFrame([(cast(a), cast(b)) for a, b in sorted(e)] + [(None, cast(1))], f"src {kind}, dst {kind}")
    start = spark.createDataFrame([(cast(s),) for s in seeds] * 2, f"src {kind}")
    if not fit:
        monkeypatch.setattr(graph, "EDGE_BYTES", 0)
    for reflexive, pairs in ((True, want), (False, proper)):
        got = [(r["src"], r["dst"]) for r in graph.closure(edges, start, reflexive).collect()]
        assert len(got) == len(set(got)) and set(got) == {(cast(a), cast(b)) for a, b in pairs}


def test_closure_neither_shuffles_nor_stores_its_pairs(spark, monkeypatch):
    stored = []
    real = graph.cut

    def counted(df):
        out = real(df)
        stored.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    e = spark.range(300).selectExpr("id AS src", "(id + 1) % 300 AS dst").unionByName(spark.range(300).selectExpr("id AS src", "id * 7 % 300 AS dst"))
    for most in (graph.EDGE_BYTES, 0):
        monkeypatch.setattr(graph, "EDGE_BYTES", most)
        stored.clear()
        assert graph.closure(e).count() == 300 * 300
        assert max(stored) <= 600


def test_optional_part_of_one_row_is_not_built_in_full(spark):
    left = triples(spark, [(f"ag:V{k}", "dp:hasVariableName", f'"v{k}"') for k in range(3)])
    n = 20_000
    # A relation of tables: a filter on its key reaches the table, so that no other row is joined.
    keys = spark.range(n).selectExpr(f"'{AG}P' AS s", f"concat('{AG}V', cast(id AS string)) AS o").where("o IS NOT NULL")
    uses = keys.selectExpr("s", f"'{iri('op:usesVariable')}' AS p", "o", "'iri' AS o_kind", "cast(null AS string) AS o_dtype", "cast(null AS string) AS o_lang")
    q = 'SELECT ?n ?u WHERE { ?v dp:hasVariableName ?n . OPTIONAL { ?u op:usesVariable ?v } FILTER(?n = "v1") }'
    out = sparql.select(left.unionByName(uses), q)
    assert [tuple(r) for r in out.collect()] == [("v1", iri("ag:P"))]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert f"= {AG}V1" in plan or f"IN ({AG}V1)" in plan


def _groups(spark):
    """A plant, and variables that its POUs use in groups: as products and as triples."""
    rows = [(f"ag:P{k}", "dp:hasPOUName", f'"P{k}"') for k in range(4)]
    rows += [(f"ag:V{k}", "dp:hasVariableName", f'"v{k // 2}"') for k in range(6)] + [("ag:V1", "dp:hasHardwareAddress", '"I 0.1"')]
    rows += [("ag:P0", "op:containsPOUCall", "ag:c"), ("ag:c", "op:callsPOU", "ag:P1"), ("ag:P3", "op:hasInternalVariable", "ag:V5"), ("ag:P0", "rdf:type", "ag:class_Program")]
    members, of = [(0, "a"), (1, "b"), (2, "b"), (2, "a"), (3, "none")], [("a", 0), ("a", 1), ("b", 2), ("b", 3), ("b", 4), ("lost", 5)]
    whole = rows + [(f"ag:P{p}", "op:usesVariable", f"ag:V{v}") for p, g in members for h, v in of if g == h]
    products = (
        spark.createDataFrame([(iri(f"ag:P{p}"), g) for p, g in members], "dst string, via string"),
        spark.createDataFrame([(g, iri(f"ag:V{v}")) for g, v in of], "via string, var string"),
    )
    return triples(spark, rows), products, triples(spark, whole)


def test_signatures_of_groups_equal_those_of_triples(spark):
    g, products, whole = _groups(spark)
    want = {r["name"]: r for r in graph.signatures(whole).collect()}
    assert want["P0"]["vars"] == ["v0", "v1", "v2"] and want["P0"]["hw"] == ["I 0.1"] and want["P3"]["vars"] == ["v2"]
    assert {r["name"]: r for r in graph.signatures(g, products).collect()} == want
    for r in graph.signatures(g, products, sizes=True).collect():
        assert all(r[c] == len(want[r["name"]][c]) for c in ("reachable", "called", "vars", "hw", "ports"))


def test_schema_card_counts_products(spark):
    g, products, whole = _groups(spark)
    want = [tuple(r) for r in graph.schema_card(whole).collect()]
    assert ("predicate", iri("op:usesVariable"), 2 + 3 + 3 + 2) in want
    assert [tuple(r) for r in graph.schema_card(g, products={"op:usesVariable": products}).collect()] == want


def test_types_are_inferred_in_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(graph, "TRIPLES_EACH", 50)
    rows = [(f"ag:x{k}", "rdf:type", f"ag:C{k % 2}") for k in range(200)] * 2 + [("ag:x0", "rdf:type", "ag:C1"), ("ag:x1", "dp:hasName", '"n"')]
    rows += [("ag:C0", "rdfs:subClassOf", "ag:B"), ("ag:C1", "rdfs:subClassOf", "ag:B"), ("ag:B", "rdfs:subClassOf", "ag:A")]
    out = graph.infer_types(triples(spark, rows))
    got = [(r["s"], r["p"], r["o"]) for r in out.collect()]
    want = {(iri(s), iri(p), o[1:-1] if o[0] == '"' else iri(o)) for s, p, o in rows}
    want |= {(s, p, iri(c)) for s, p, _ in want if p == iri("rdf:type") for c in ("ag:A", "ag:B")}
    assert sorted(got) == sorted(want)
    # A part of 50 triples each, of 406, in which duplicates go without another exchange.
    assert out.rdd.getNumPartitions() == 9
