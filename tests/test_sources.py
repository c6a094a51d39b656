import json

import pytest

from grafwerk.model import AG, XSD
from grafwerk.sources import plc, turtle

TEXT = '''@prefix ag: <%s> .
@prefix dp: <%sdp_> .
# a comment
ag:x a ag:C, ag:D ; dp:n "a \\"q\\"\\n"@de, 5, 1.5, true ; dp:long """two
lines""" ; dp:list ( 1 "b" ) .
[] dp:of ag:Term\\(1\\) .
''' % (AG, AG)


def test_parse():
    rows = list(turtle.parse(TEXT))
    objects = {r[2]: r for r in rows if r[0] == f"{AG}x"}
    assert objects['a "q"\n'][5] == "de"
    assert objects["5"][4] == f"{XSD}integer" and objects["1.5"][4] == f"{XSD}decimal" and objects["true"][4] == f"{XSD}boolean"
    assert "two\nlines" in objects
    assert any(r[2] == f"{AG}Term(1)" for r in rows)
    with pytest.raises(turtle.TurtleError):
        list(turtle.parse("ag:x ag:y ag:z ."))
    with pytest.raises(turtle.TurtleError):
        list(turtle.parse("<a:x> <a:y> { <a:z> } ."))


def test_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.ttl").write_text(TEXT)
    spark.dataSource.register(turtle.TurtleDataSource)
    g = spark.read.format("turtle").load(str(tmp_path / "in"))
    turtle.write(g, str(tmp_path / "out"))
    again = [r for f in sorted((tmp_path / "out").glob("part-*")) for r in turtle.parse(f.read_text())]
    assert sorted(map(str, again)) == sorted(str(tuple(r)) for r in g.collect())


def test_artifacts_and_projects(spark, tmp_path):
    (tmp_path / "A.TcPOU").write_text('<TcPlcObject><POU Name="A" Id="1"><Declaration><![CDATA[PROGRAM A\nVAR x:BOOL; END_VAR]]></Declaration><Implementation><ST><![CDATA[x := TRUE;]]></ST></Implementation></POU></TcPlcObject>')
    (tmp_path / "B.TcPOU").write_text("broken")
    rows = {r["name"]: r for r in plc.artifacts(plc.whole(spark, str(tmp_path), "*.TcPOU")).collect()}
    assert rows["A"]["implementation"] == "x := TRUE;" and rows["A"]["lang"] == "ST" and rows["A"]["error"] is None
    assert rows[""]["error"] == "no artifact"
    sln = spark.createDataFrame([("p", 'Project("{B}") = "X", "X\\\\X.tsproj", "{C}"')], "path string, text string")
    assert [r["project"] for r in plc.solution_projects(sln).collect()] == ["X\\\\X.tsproj"]


def test_pous_of_export(spark, tmp_path):
    (tmp_path / "e.xml").write_text('<project><pou name="M" pouType="program"><interface><inputVars><variable name="a"><type><BOOL/></type></variable><variable name="b"><type><INT/></type></variable></inputVars></interface></pou></project>')
    rows = plc.pous(spark, str(tmp_path / "e.xml")).collect()
    assert {(r["name"], r["section"], r["variable"]) for r in rows} == {("M", "inputVars", "a"), ("M", "inputVars", "b")}


def test_flags_links_channels(spark):
    a = spark.createDataFrame([("v", "OPC.UA.DA", "1"), ("w", "OPC.UA.DA", "1"), ("w", "OPC.UA.DA.Access", "1"), ("x", "OPC.UA.DA", "0")], "variable string, name string, value string")
    assert {tuple(r) for r in plc.opcua_flags(a).collect()} == {("v", True, True), ("w", True, False), ("x", False, False)}
    m = spark.createDataFrame([("TIPC^P", "TIID^D", "PlcTask Inputs^G.x", "Ch 1^Input"), ("TIID^D", "TIPC^P", "Ch 2^Output", "PlcTask Outputs^G.y")], "owner_a string, owner_b string, var_a string, var_b string")
    assert {(r["plc_path"], r["plc_var"], r["io_var"]) for r in plc.links(m).collect()} == {("TIPC^P", "G.x", "Ch 1^Input"), ("TIPC^P", "G.y", "Ch 2^Output")}
    c = spark.createDataFrame([("Ch^Input", '<V VarBitSize="1" VarBitAddr="19" IndexGroup="#xF030"/>', ""), ("Ch", "<V/>", "")], "name string, xml string, plc_path string")
    rows = plc.channel_meta(c).collect()
    assert (rows[0]["ea_address"], rows[0]["byte"], rows[0]["index_group"]) == ("I 2.3", 2, 0xF030)
    assert rows[1]["bit_addr"] is None


def test_incident_and_snapshot(spark):
    snap = {"rows": [{"id": "ns=4;s=OPCUA.a", "t": "bool", "nodeClass": "Variable"}], "vars": [{"id": "OPCUA.a", "t": "bool", "v": "true"}, {"id": "OPCUA.n", "t": "uint64", "v": "18446744073709551615"}]}
    event = {"type": "evD2", "payload": {"ingestion": {"correlationId": "c1"}, "processName": "P", "plcSnapshot": snap}}
    df = spark.createDataFrame([(json.dumps(event),), ("no json",)], "value string")
    rows = plc.incident(df)
    assert rows.collect()[0]["correlation_id"] == "c1" and rows.collect()[1]["correlation_id"] is None
    values = {r["id"]: r for r in plc.snapshot_values(rows, "correlation_id", "snapshot").collect()}
    assert values["OPCUA.a"]["v_bool"] is True and int(values["OPCUA.n"]["v_long"]) == 18446744073709551615
