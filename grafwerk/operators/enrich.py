"""Enrichment of a plant graph: passes that take triples and give triples, in the order of `analyze`.

Each pass returns what it adds; `analyze` joins the additions to the graph between passes, as a set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafwerk.functions import stcode, text
from grafwerk.model import AG, RDFS, TYPE, as_set, encode_name, iri, shaped, triples, union
from grafwerk.operators.graph import cut, first_object, infer_types, instances, match, pairs, remove_nodes

#: The blocks that every controller has: inputs, outputs.
STANDARD = {
    "TON": (("IN", "PT"), ("Q", "ET")),
    "TOF": (("IN", "PT"), ("Q", "ET")),
    "TP": (("IN", "PT"), ("Q", "ET")),
    "R_TRIG": (("CLK",), ("Q",)),
    "F_TRIG": (("CLK",), ("Q",)),
    "RS": (("SET", "RESET1"), ("Q1",)),
    "SR": (("SET1", "RESET"), ("Q1",)),
    "CTU": (("CU", "RESET", "PV"), ("Q", "CV")),
    "CTD": (("CD", "LOAD", "PV"), ("Q", "CV")),
    "CTUD": (("CU", "CD", "RESET", "LOAD", "PV"), ("QU", "QD", "CV")),
}
SUBCLASSES = (("ag:class_StandardFBType", "ag:class_FBType"), ("ag:class_CustomFBType", "ag:class_FBType"), ("ag:class_FBType", "ag:class_POU"), ("ag:class_Program", "ag:class_POU"))
HARDWARE = ("dp:hasHardwareAddress", "dp:hasHardwareDirection", "op:isBoundToChannel")


def _node(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{AG}{prefix}_"), F.concat_ws("_", *(encode_name(p, strict=True) for p in parts)))


def _flag(df: DataFrame, s: Column, p: str, value: str = "true") -> DataFrame:
    return shaped(df, s, p, F.lit(value))


def standard_blocks(graph: DataFrame) -> DataFrame:
    """The standard block types with their ports."""
    rows = []
    for name, sides in STANDARD.items():
        rows += [(f"ag:FBType_{name}", TYPE, "ag:class_StandardFBType"), (f"ag:FBType_{name}", "dp:hasPOUName", f'"{name}"')]
        for side, ports in zip(("Input", "Output"), sides):
            for p in ports:
                port = f"ag:Port_{name}_{p}"
                rows += [(f"ag:FBType_{name}", "op:hasPort", port), (port, TYPE, "ag:class_Port"), (port, "dp:hasPortName", f'"{p}"'), (port, "dp:hasPortDirection", f'"{side}"')]
    return triples(graph.sparkSession, rows)


def ingest_programs(programs: DataFrame) -> DataFrame:
    """Programs of a mapping (Programm_Name, pou_type, program_code, inputs, outputs, inouts, temps, methods) as triples."""
    name = F.col("Programm_Name")
    is_program = F.lower("pou_type") == "program"
    pou = F.when(is_program, _node("Program", name)).otherwise(_node("FBType", name))
    base = programs.withColumn("pou", pou)
    cls = F.when(is_program, iri("ag:class_Program")).otherwise(iri("ag:class_FBType"))
    out = [
        shaped(base, F.col("pou"), TYPE, cls, "iri"),
        shaped(base.where(is_program), F.col("pou"), "dp:hasProgramName", name),
        shaped(base, F.col("pou"), "dp:hasPOUName", name),
        shaped(base, F.col("pou"), "dp:hasPOUCode", F.col("program_code")),
        shaped(base, F.col("pou"), "dp:hasPOULanguage", F.col("programming_lang")),
    ]
    for column, side in (("inputs", "Input"), ("outputs", "Output"), ("inouts", "InOut")):
        each = base.select("pou", "Programm_Name", F.explode(column).alias("v"))
        port = _node("Port", name, F.col("v.internal"))
        var = _node("Var", name, F.col("v.internal"))
        out += [
            shaped(each, F.col("pou"), "op:hasPort", port, "iri"),
            shaped(each, port, TYPE, F.lit(iri("ag:class_Port")), "iri"),
            shaped(each, port, "dp:hasPortName", F.col("v.internal")),
            shaped(each, port, "dp:hasPortDirection", F.lit(side)),
            shaped(each, port, "dp:hasPortType", F.col("v.internal_type")),
            shaped(each, var, "op:implementsPort", port, "iri"),
            shaped(each, var, TYPE, F.lit(iri("ag:class_Variable")), "iri"),
            shaped(each, var, "dp:hasVariableName", F.col("v.internal")),
            shaped(each, var, "dp:hasVariableType", F.col("v.internal_type")),
            shaped(each, F.col("pou"), "op:hasInternalVariable", var, "iri"),
            shaped(each, port, "dp:hasExternalExpression", text.clean_expression(F.col("v.external"))),
        ]
    temp = base.select("pou", "Programm_Name", F.explode("temps").alias("v"))
    var = _node("Var", name, F.col("v.name"))
    out += [
        shaped(temp, F.col("pou"), "op:hasInternalVariable", var, "iri"),
        shaped(temp, var, TYPE, F.lit(iri("ag:class_Variable")), "iri"),
        shaped(temp, var, "dp:hasVariableName", F.col("v.name")),
        shaped(temp, var, "dp:hasVariableType", F.col("v.type")),
    ]
    meth = base.select("pou", "Programm_Name", F.explode("methods").alias("v"))
    m = _node("Method", name, F.col("v.method_name"))
    role = F.when(F.lower("v.method_name") == "start", iri("op:hasStartMethod")).when(F.lower("v.method_name") == "abort", iri("op:hasAbortMethod")).when(F.lower("v.method_name") == "checkstate", iri("op:hasCheckStateMethod")).otherwise(iri("op:hasMethod"))
    out += [
        shaped(meth, F.col("pou"), "op:hasMethod", m, "iri").withColumn("p", F.lit(iri("op:hasMethod"))),
        meth.select(F.col("pou").alias("s"), role.alias("p"), m.alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_dtype"), F.lit(None).cast("string").alias("o_lang")),
        shaped(meth, m, TYPE, F.lit(iri("ag:class_Method")), "iri"),
        shaped(meth, m, "dp:hasMethodName", F.col("v.method_name")),
        shaped(meth, m, "dp:hasPOUCode", F.col("v.code")),
    ]
    return as_set(union(*out))


def ingest_gvls(gvls: DataFrame) -> DataFrame:
    """Global variable lists (name, globals) as triples; each variable has its short and its full name."""
    lst = _node("GVLList", F.col("name"))
    each = gvls.select("name", F.explode("globals").alias("g"))
    full = F.concat_ws(".", "name", "g.name")
    var = F.concat(F.lit(AG), encode_name(full, strict=True))
    out = [
        shaped(gvls, lst, TYPE, F.lit(iri("ag:class_GlobalVariableList")), "iri"),
        shaped(gvls, lst, "dp:hasGlobalVariableListName", F.col("name")),
        shaped(each, lst, "op:listsGlobalVariable", var, "iri"),
        shaped(each, var, TYPE, F.lit(iri("ag:class_Variable")), "iri"),
        shaped(each, var, "dp:hasVariableName", F.col("g.name")),
        shaped(each, var, "dp:hasVariableName", full),
        shaped(each, var, "dp:hasVariableType", F.col("g.type")),
        shaped(each, var, "dp:hasDefaultValue", F.col("g.init")),
        shaped(each, var, "dp:hasHardwareAddress", F.col("g.address")),
        shaped(each, var, "dp:hasOPCUADataAccess", F.col("g.opcua_da")),
        shaped(each, var, "dp:hasOPCUAWriteAccess", F.col("g.opcua_write")),
    ]
    return as_set(union(*out))


def ingest_io(graph: DataFrame, io: DataFrame) -> DataFrame:
    """Hardware addresses and channels (plc_var, io_path, direction, ea_address) of the variables that they name."""
    named = pairs(graph, "dp:hasVariableName", "var", "name")
    hit = io.join(named, F.lower("plc_var") == F.lower("name"))
    ch = _node("IOChannel", F.col("io_path"))
    return as_set(
        union(
            shaped(hit, F.col("var"), "dp:hasHardwareAddress", F.col("ea_address")),
            shaped(hit, F.col("var"), "dp:hasHardwareDirection", F.col("direction")),
            shaped(hit, F.col("var"), "op:isBoundToChannel", ch, "iri"),
            shaped(io, ch, TYPE, F.lit(iri("ag:class_IOChannel")), "iri"),
            shaped(io, ch, "dp:hasChannelPath", F.col("io_path")),
        )
    )


def mirror_simulation(graph: DataFrame, suffix: str = "_Sim") -> tuple[DataFrame, DataFrame]:
    """The graph in which `X_Sim.v` has the hardware triples of `X.v` instead of its own; and names without a counterpart."""
    names = pairs(graph, "dp:hasVariableName", "sim", "name")
    sims = names.where(F.col("name").rlike(rf"^[^.]+{suffix}\.")).withColumn("real_name", F.regexp_replace("name", rf"^([^.]+){suffix}\.", "$1."))
    real = names.select(F.col("sim").alias("real"), F.col("name").alias("real_name"))
    both = sims.join(real, "real_name", "left")
    missing = both.where("real IS NULL").select("name")
    hw = match(graph, p=HARDWARE)
    old = hw.join(both.where("real IS NOT NULL").select(F.col("sim").alias("s")), "s", "left_semi")
    new = hw.join(both.select("real", "sim"), hw["s"] == F.col("real")).select(F.col("sim").alias("s"), "p", "o", "o_kind", "o_dtype", "o_lang")
    kept = graph.join(old.select("s", "p").distinct(), ["s", "p"], "left_anti").select(graph.columns)
    return as_set(kept.unionByName(new)), missing


def default_values(graph: DataFrame, headers: DataFrame) -> DataFrame:
    """Initial values from declaration headers (pou, header), for internal variables of those names and the ports that they implement."""
    decl = stcode.declarations_table(headers, "pou", "header").where("init <> ''")
    var = pairs(graph, "op:hasInternalVariable", "pou", "var").join(pairs(graph, "dp:hasVariableName", "var", "vname"), "var")
    hit = decl.join(var, (decl["pou"] == var["pou"]) & (F.lower("name") == F.lower("vname"))).select(decl["pou"], "var", "init", "name")
    ports = hit.join(pairs(graph, "op:implementsPort", "var", "port"), "var")
    known = hit.select("pou", F.lower("name").alias("k"))
    lost = decl.join(known, (decl["pou"] == known["pou"]) & (F.lower("name") == F.col("k")), "left_anti")
    made = F.concat(F.col("pou"), F.lit("_"), encode_name(F.col("name"), strict=True))
    return as_set(
        union(
            shaped(hit, F.col("var"), "dp:hasDefaultValue", F.col("init")),
            shaped(ports, F.col("port"), "dp:hasDefaultValue", F.col("init")),
            shaped(lost, F.col("pou"), "op:hasInternalVariable", made, "iri"),
            shaped(lost, made, TYPE, F.lit(iri("ag:class_Variable")), "iri"),
            shaped(lost, made, "dp:hasVariableName", F.col("name")),
            shaped(lost, made, "dp:hasVariableType", F.col("type")),
            shaped(lost, made, "dp:hasDefaultValue", F.col("init")),
        )
    )


def custom_types(graph: DataFrame) -> DataFrame:
    """Block types that aren't standard ones."""
    types = instances(graph, "ag:class_FBType", "s").join(instances(graph, "ag:class_StandardFBType", "s"), "s", "left_anti")
    return shaped(types, F.col("s"), TYPE, F.lit(iri("ag:class_CustomFBType")), "iri")


def gemma_layers(graph: DataFrame) -> DataFrame:
    """Types whose ports are states of the operating-mode graph: two at least on both sides mark a state machine."""
    port = pairs(graph, "op:hasPort", "pou", "port").join(pairs(graph, "dp:hasPortName", "port", "name"), "port").join(pairs(graph, "dp:hasPortDirection", "port", "dir"), "port")
    state = text.gemma_state(F.col("name"))
    per = port.groupBy("pou").agg(F.count_if(state & (F.col("dir") == "Input")).alias("i"), F.count_if(state & (F.col("dir") == "Output")).alias("o")).where("i >= 2 AND o >= 2")
    return _flag(per, F.col("pou"), "dp:isGEMMAStateMachine")


def instance_names(graph: DataFrame) -> DataFrame:
    """The name of each block instance: that of its variable, else what follows the last `_` of its IRI."""
    inst = instances(graph, "ag:class_FBInstance", "s")
    named = first_object(graph, "dp:hasFBInstanceName", "s", "have")
    var = pairs(graph, "op:isRepresentedBy", "s", "v").join(first_object(graph, "dp:hasVariableName", "v", "name"), "v").groupBy("s").agg(F.min("name").alias("name"))
    rows = inst.join(named, "s", "left_anti").join(var, "s", "left")
    return shaped(rows, F.col("s"), "dp:hasFBInstanceName", F.coalesce("name", F.regexp_extract("s", "([^_]+)$", 1)))


def _instances_of(graph: DataFrame) -> DataFrame:
    """(pou, inst, type): the block instances that a POU's variables are, by name and type."""
    var = pairs(graph, "op:hasInternalVariable", "pou", "var").join(pairs(graph, "dp:hasVariableName", "var", "inst"), "var").join(pairs(graph, "dp:hasVariableType", "var", "type_name"), "var")
    typ = pairs(graph, "dp:hasPOUName", "type", "tname")
    return var.join(typ, F.lower("type_name") == F.lower("tname")).select("pou", "inst", "type").distinct()


def code_of(graph: DataFrame) -> DataFrame:
    """(pou, code) of all POUs, with one code each."""
    return first_object(graph, "dp:hasPOUCode", "pou", "code")


def resolve_sources(rows: DataFrame, graph: DataFrame) -> DataFrame:
    """Give each row (pou, expr) the `source` node that its expression stands for, and its `kind`.

    In this order: a literal, a known global path, a port of an instance, a local variable, another expression.
    """
    glob = pairs(graph, "op:listsGlobalVariable", "l", "gvar").join(pairs(graph, "dp:hasVariableName", "gvar", "gname"), "gvar").groupBy(F.lower("gname").alias("gname")).agg(F.min("gvar").alias("gvar"))
    local = pairs(graph, "op:hasInternalVariable", "pou", "lvar").join(pairs(graph, "dp:hasVariableName", "lvar", "lname"), "lvar").groupBy("pou", F.lower("lname").alias("lname")).agg(F.min("lvar").alias("lvar"))
    e = F.trim("expr")
    literal = e.rlike(r"(?i)^(true|false|-?\d[\d_.]*|[a-z]+#\S+|'[^']*')$")
    port = e.rlike(r"^[A-Za-z_]\w*\.[A-Za-z_]\w*$")
    name = e.rlike(r"^[A-Za-z_]\w*$")
    out = rows.join(glob, F.lower(e) == F.col("gname"), "left").join(local, (rows["pou"] == local["pou"]) & (F.lower(e) == F.col("lname")), "left").drop(local["pou"])
    kind = F.when(literal, "literal").when(F.col("gvar").isNotNull() & F.contains(e, F.lit(".")), "global").when(port, "port").when(F.col("lvar").isNotNull(), "local").when(F.col("gvar").isNotNull(), "global").when(name, "local").otherwise("expression")
    node = (
        F.when(kind == "literal", _node("Literal", e))
        .when(kind == "global", F.col("gvar"))
        .when(kind == "port", F.concat(F.lit(f"{AG}PortInstance_"), F.regexp_extract("pou", "([^/]*)$", 1), F.lit("_"), F.replace(e, F.lit("."), F.lit("_"))))
        .when(kind == "local", F.coalesce("lvar", F.concat(F.col("pou"), F.lit("_"), encode_name(e, strict=True))))
        .otherwise(F.concat(F.lit(f"{AG}Expression_"), text.expression_id(F.col("pou"), e)))
    )
    return out.select(*rows.columns, node.alias("source"), kind.alias("kind"))


def _source_triples(rows: DataFrame) -> DataFrame:
    cls = F.when(F.col("kind") == "literal", iri("ag:class_SourceLiteral")).when(F.col("kind") == "port", iri("ag:class_PortInstance")).when(F.col("kind") == "expression", iri("ag:class_Expression")).otherwise(iri("ag:class_Variable"))
    return union(shaped(rows, F.col("source"), TYPE, cls, "iri"), shaped(rows, F.col("source"), TYPE, F.lit(iri("ag:class_SignalSource")), "iri"), shaped(rows, F.col("source"), "dp:hasExpressionText", F.trim("expr")))


def pou_calls(graph: DataFrame) -> DataFrame:
    """Calls of block instances in code: a node for each, its callee, and its parameters' assignments to ports."""
    # Cut off where several additions come from the same rows.
    found = cut(_calls(graph))
    call = F.concat(F.lit(f"{AG}Call_"), F.regexp_extract("pou", "([^/]*)$", 1), F.lit("_"), F.col("instance"), F.lit("_"), F.col("call_index").cast("string"))
    params = found.select("pou", "instance", "call_index", "type", F.explode("params").alias("port_name", "expr"))
    ports = pairs(graph, "op:hasPort", "type", "port").join(pairs(graph, "dp:hasPortName", "port", "pname"), "port")
    wired = params.join(ports, (params["type"] == ports["type"]) & (F.lower("port_name") == F.lower("pname"))).drop(ports["type"])
    solved = cut(resolve_sources(wired, graph))
    a = F.concat(call, F.lit("_"), F.col("port_name"))
    return as_set(
        union(
            shaped(found, call, TYPE, F.lit(iri("ag:class_POUCall")), "iri"),
            shaped(found, F.col("pou"), "op:containsPOUCall", call, "iri"),
            shaped(found, call, "op:callsPOU", F.col("type"), "iri"),
            shaped(solved, a, TYPE, F.lit(iri("ag:class_ParameterAssignment")), "iri"),
            shaped(solved, call, "op:hasAssignment", a, "iri"),
            shaped(solved, a, "op:assignsToPort", F.col("port"), "iri"),
            shaped(solved, a, "op:assignsFrom", F.col("source"), "iri"),
            _source_triples(solved),
        )
    )


def _calls(graph: DataFrame) -> DataFrame:
    found = stcode.calls_table(code_of(graph), "pou", "code")
    inst = _instances_of(graph).select(F.col("pou").alias("p"), F.lower("inst").alias("i"), "type")
    return found.join(inst, (found["pou"] == F.col("p")) & (F.lower("instance") == F.col("i"))).select("pou", "instance", "call_index", "params", "type")


def st_assignments(graph: DataFrame) -> DataFrame:
    """`lhs := instance.port;` in programs: the variable is written from the port instance."""
    programs = instances(graph, "ag:class_Program", "pou")
    found = stcode.assignments_table(code_of(graph).join(programs, "pou", "left_semi"), "pou", "code").where(F.col("rhs").rlike(r"^[A-Za-z_]\w*\.[A-Za-z_]\w*$"))
    rows = cut(resolve_sources(found.select("pou", F.col("variable"), F.col("rhs").alias("expr")), graph))
    target = resolve_sources(rows.select("pou", F.col("variable").alias("expr"), F.col("source").alias("from_source")), graph)
    return as_set(union(shaped(target, F.col("source"), "op:isWrittenFrom", F.col("from_source"), "iri"), _source_triples(rows)))


def condition_ports(graph: DataFrame) -> DataFrame:
    """`instance.port` in IF, ELSIF, WHILE and UNTIL conditions, of instances that belong to the POU."""
    code = code_of(graph).select("pou", text.strip_comments(F.col("code")).alias("code"))
    cond = F.regexp_extract_all("code", F.lit(r"(?is)\b(?:IF|ELSIF|WHILE|UNTIL)\b(.*?)(?:\bTHEN\b|\bDO\b|;)"), 1)
    dotted = F.regexp_extract_all("c", F.lit(r"([A-Za-z_]\w*\.[A-Za-z_]\w*)"), 1)
    each = code.select("pou", F.explode(cond).alias("c")).select("pou", F.explode(dotted).alias("expr")).distinct()
    inst = _instances_of(graph).select(F.col("pou").alias("p"), F.lower("inst").alias("i"))
    own = each.join(inst, (each["pou"] == F.col("p")) & (F.lower(F.split("expr", "[.]")[0]) == F.col("i")), "left_semi")
    return as_set(_source_triples(cut(resolve_sources(own, graph))))


def output_layer(graph: DataFrame) -> DataFrame:
    """Types that a program calls and that drive a hardware variable, directly or through a port instance."""
    called = pairs(graph, "op:containsPOUCall", "p", "c").join(instances(graph, "ag:class_Program", "p"), "p").join(pairs(graph, "op:callsPOU", "c", "type"), "c")
    assigned = called.join(pairs(graph, "op:hasAssignment", "c", "a"), "c").join(pairs(graph, "op:assignsFrom", "a", "v"), "a")
    hw = pairs(graph, "dp:hasHardwareAddress", "v", "addr").where(F.col("addr").rlike(r"(?i)^(%?Q)"))
    direct = assigned.join(hw, "v").select("type")
    written = pairs(graph, "op:isWrittenFrom", "v", "pi").join(hw, "v").join(pairs(graph, "dp:hasExpressionText", "pi", "expr"), "pi")
    inst = _instances_of(graph).select("inst", "type").distinct()
    through = written.join(inst, F.lower(F.split("expr", "[.]")[0]) == F.lower("inst")).select("type").join(called.select("type").distinct(), "type", "left_semi")
    return _flag(direct.union(through).distinct(), F.col("type"), "dp:isOutputLayer")


def unused(graph: DataFrame, compat: bool = False) -> DataFrame:
    """Internal variables whose name no code of their POU uses. `inst.port` uses `inst`, unless in compat mode."""
    words = code_of(graph).select("pou", F.explode(text.identifiers(F.col("code"))).alias("w"))
    heads = words if compat else words.select("pou", F.explode(F.array_distinct(F.array("w", F.split("w", "[.]")[0]))).alias("w"))
    var = pairs(graph, "op:hasInternalVariable", "pou", "var").join(pairs(graph, "dp:hasVariableName", "var", "name"), "var")
    with_code = var.join(words.select("pou").distinct(), "pou", "left_semi")
    used = heads.select(F.col("pou").alias("p"), F.lower("w").alias("w")).distinct()
    return _flag(with_code.join(used, (F.col("pou") == F.col("p")) & (F.lower("name") == F.col("w")), "left_anti").select("var").distinct(), F.col("var"), "dp:isUnused")


def reports(graph: DataFrame) -> DataFrame:
    """A text for each POU: what it calls and what it doesn't use, in sorted sections."""
    name = pairs(graph, "dp:hasPOUName", "pou", "name").groupBy("pou").agg(F.min("name").alias("name"))
    callee = pairs(graph, "op:containsPOUCall", "pou", "c").join(pairs(graph, "op:callsPOU", "c", "t"), "c").join(name.withColumnsRenamed({"pou": "t", "name": "callee"}), "t")
    calls = callee.groupBy("pou").agg(F.concat_ws(", ", F.sort_array(F.collect_set("callee"))).alias("calls"))
    idle = pairs(graph, "dp:isUnused", "var", "x").join(pairs(graph, "op:hasInternalVariable", "pou", "var"), "var").join(pairs(graph, "dp:hasVariableName", "var", "vname"), "var")
    idle = idle.groupBy("pou").agg(F.concat_ws(", ", F.sort_array(F.collect_set("vname"))).alias("idle"))
    rows = name.join(calls, "pou", "left").join(idle, "pou", "left")
    line = F.concat_ws(" | ", F.concat(F.lit("POU "), "name"), F.concat(F.lit("calls: "), "calls"), F.concat(F.lit("unused: "), "idle"))
    return shaped(rows, F.col("pou"), "dp:hasConsistencyReport", line)


def link_globals(graph: DataFrame) -> DataFrame:
    """POUs whose code names a global variable as `LIST.name` use it."""
    full = pairs(graph, "op:listsGlobalVariable", "l", "var").join(pairs(graph, "dp:hasVariableName", "var", "gname"), "var").where(F.contains("gname", F.lit(".")))
    words = code_of(graph).select("pou", F.explode(text.identifiers(F.col("code"))).alias("w"))
    return as_set(shaped(words.join(full, F.lower("w") == F.lower("gname")), F.col("pou"), "op:usesVariable", F.col("var"), "iri"))


def clean(graph: DataFrame) -> DataFrame:
    """The graph without what an analysis before has added."""
    kinds = ("ag:class_POUCall", "ag:class_ParameterAssignment", "ag:class_Expression", "ag:class_SourceLiteral")
    nodes = union(*(instances(graph, k, "s") for k in kinds))
    kept = remove_nodes(graph, nodes)
    flags = [iri(p) for p in ("dp:isUnused", "dp:hasConsistencyReport", "dp:isOutputLayer", "dp:isGEMMAStateMachine")]
    return kept.where(~F.col("p").isin(flags))


PASSES = (custom_types, gemma_layers, instance_names, pou_calls, st_assignments, condition_ports, output_layer, unused)


def analyze(graph: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """All passes in their order, then type inference, reports and links to global variables."""
    g = as_set(clean(graph).unionByName(standard_blocks(graph)))
    sub = triples(graph.sparkSession, [(a, f"{RDFS}subClassOf", b) for a, b in SUBCLASSES])
    g = cut(as_set(g.unionByName(sub)))
    if headers is not None:
        g = cut(as_set(g.unionByName(default_values(g, headers))))
    for step in PASSES:
        # Cut off: the next pass reads the graph several times.
        g = cut(as_set(g.unionByName(step(g))))
    g = cut(infer_types(g))
    return as_set(g.unionByName(reports(g)).unionByName(link_globals(g)))


def record_failure(graph: DataFrame, failures: DataFrame) -> DataFrame:
    """Triples of occurred failures (correlation_id, mode, reaction, monitoring, ts); one without a mode is unknown."""
    node = _node("OccuredFailure", F.col("correlation_id"))
    nth = F.row_number().over(Window.partitionBy("correlation_id").orderBy("ts"))
    rows = failures.withColumn("nth", nth).where("nth = 1")
    return union(
        shaped(rows, node, TYPE, F.lit(iri("ag:class_OccuredFailure")), "iri"),
        shaped(rows, node, "dp:hasCorrelationId", F.col("correlation_id")),
        shaped(rows, node, "op:isFailureMode", F.col("mode"), "iri"),
        shaped(rows, node, "op:executedSystemReaction", F.col("reaction"), "iri"),
        shaped(rows, node, "op:executedMonitoringAction", F.col("monitoring"), "iri"),
        shaped(rows, node, "dp:isUnknown", F.col("mode").isNull()),
    )


def skill_hypotheses(rows: DataFrame, most: int = 6) -> DataFrame:
    """(id, pou, skill, confidence, evidence) of rows (pou, skill, confidence, evidence): the best of each pair, with a few evidences."""
    per = rows.groupBy("pou", "skill").agg(F.max("confidence").alias("confidence"), F.slice(F.sort_array(F.collect_set("evidence")), 1, most).alias("evidence"))
    return per.select(F.sha1(F.concat_ws("|", "pou", "skill")).alias("id"), "pou", "skill", "confidence", F.concat_ws("; ", "evidence").alias("evidence"))
