"""Readers of controller projects: PLCopen and TwinCAT XML, mapping and snapshot JSON.

Files are read whole (`binaryFile` or `wholetext`) and taken apart by column expressions; what can't be read
becomes a row with an error instead of ending the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grafwerk.operators.decide import direction, ea_address

_VAR = "array<struct<_name:string,type:string,initialValue:string>>"
#: One variable side of a program mapping.
IO = "internal string, external string, internal_type string, opcua_da boolean, opcua_write boolean"
PROGRAM = (
    f"Programm_Name string, pou_type string, programming_lang string, program_code string, inputs array<struct<{IO.replace(' ', ':').replace(',:', ',')}>>, "
    f"outputs array<struct<{IO.replace(' ', ':').replace(',:', ',')}>>, inouts array<struct<{IO.replace(' ', ':').replace(',:', ',')}>>, "
    "temps array<struct<name:string,type:string>>, subcalls array<struct<SubNetwork_Name:string,instanceName:string>>, "
    "methods array<struct<method_name:string,return_type:string,code:string>>"
)
GVL = "name string, globals array<struct<name:string,type:string,init:string,address:string,opcua_da:boolean,opcua_write:boolean>>"
IO_LINK = "plc_path string, plc_var string, io_path string, direction string, ea_address string"
SNAPSHOT = "rows array<struct<id:string,t:string,nodeClass:string>>, vars array<struct<id:string,t:string,v:string>>"


def whole(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, text) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def solution_projects(files: DataFrame) -> DataFrame:
    """(path, project): the project files that each solution names."""
    found = F.regexp_extract_all("text", F.lit(r'"([^"]+\.(?:tsproj|plcproj))"'), 1)
    return files.select("path", F.explode(F.array_distinct(found)).alias("project"))


def artifacts(files: DataFrame) -> DataFrame:
    """(path, kind, name, declaration, implementation, lang, error) of TwinCAT files."""
    t = F.col("text")

    def body(tag: str) -> Column:
        raw = F.regexp_extract(t, rf"(?s)<{tag}>\s*(?:<ST>\s*)?(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*(?:</ST>\s*)?</{tag}>", 1)
        return F.when(raw != "", raw)

    kind = F.regexp_extract(t, r"<(POU|DUT|GVL|Visualization|VIS)\b", 1)
    name = F.regexp_extract(t, r'(?s)<(?:POU|DUT|GVL|Visualization|VIS)\b[^>]*\bName="([^"]*)"', 1)
    lang = F.when(kind == "POU", F.coalesce(*(F.when(t.rlike(rf"<(?:\w+:)?{x}[\s/>]"), x) for x in ("ST", "FBD", "LD", "SFC", "IL"))))
    bad = (kind == "") | (name == "")
    return files.select("path", kind.alias("kind"), name.alias("name"), body("Declaration").alias("declaration"), body("Implementation").alias("implementation"), lang.alias("lang"), F.when(bad, "no artifact").alias("error"))


def pous(spark: SparkSession, path: str) -> DataFrame:
    """(name, pou_type, section, variable, type): interface variables of a PLCopen export."""
    var = "struct<variable:array<struct<_name:string,type:string>>>"
    schema = f"_name string, _pouType string, interface struct<inputVars:{var},outputVars:{var},inOutVars:{var},localVars:{var}>"
    rows = spark.read.format("xml").option("rowTag", "pou").schema(schema).load(path)
    parts = []
    for section in ("inputVars", "outputVars", "inOutVars", "localVars"):
        kind = F.regexp_extract(F.regexp_replace("v.type", r"\s+", " "), r"<?(\w[\w.]*)", 1)
        parts.append(rows.select(F.col("_name").alias("name"), F.col("_pouType").alias("pou_type"), F.lit(section).alias("section"), F.explode(f"interface.{section}.variable").alias("v")).select("name", "pou_type", "section", F.col("v._name").alias("variable"), kind.alias("type")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def wiring(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(pou, block, formal, external): what is wired to each parameter of a block.

    `nodes` are (pou, local_id, expression), `blocks` (pou, block, formal, ref); a reference without a node is
    told as `localId:n`.
    """
    n = nodes.select("pou", F.col("local_id").alias("ref"), "expression")
    return blocks.join(n, ["pou", "ref"], "left").select("pou", "block", "formal", F.coalesce("expression", F.concat(F.lit("localId:"), F.col("ref").cast("string"))).alias("external"))


def opcua_flags(attributes: DataFrame) -> DataFrame:
    """(variable, opcua_da, opcua_write) from attributes (variable, name, value); one that is published without an access is writable."""
    access = F.col("name") == "OPC.UA.DA.Access"
    writes = access & (F.contains(F.lower("value"), F.lit("write")) | F.trim("value").isin("2", "3"))
    per = attributes.groupBy("variable").agg(
        F.coalesce(F.bool_or((F.col("name") == "OPC.UA.DA") & (F.trim("value") == "1")), F.lit(False)).alias("opcua_da"),
        F.bool_or(access).alias("told"),
        F.coalesce(F.bool_or(writes), F.lit(False)).alias("writes"),
    )
    return per.select("variable", "opcua_da", F.when(F.col("told"), F.col("writes")).otherwise(F.col("opcua_da")).alias("opcua_write"))


def links(mapping: DataFrame) -> DataFrame:
    """(plc_path, plc_var, io_path, io_var) from links (owner_a, owner_b, var_a, var_b): the PLC side is that of the `plctask` variable."""
    a = F.startswith(F.lower("var_a"), F.lit("plctask "))
    pick = lambda x, y: F.when(a, F.col(x)).otherwise(F.col(y))
    var = F.regexp_replace(pick("var_a", "var_b"), r"(?i)^plctask (?:in|out)puts\^", "")
    return mapping.select(pick("owner_a", "owner_b").alias("plc_path"), var.alias("plc_var"), pick("owner_b", "owner_a").alias("io_path"), pick("var_b", "var_a").alias("io_var"))


def channel_meta(channels: DataFrame) -> DataFrame:
    """(name, bit_size, bit_addr, byte, bit, index_group, ea_address) of channels (name, xml, plc_path)."""

    def attr(n: str) -> Column:
        return F.regexp_extract("xml", rf'\b{n}="([^"]*)"', 1)

    def hexed(n: str) -> Column:
        raw = F.lower(attr(n))
        return F.when(raw.rlike("^(#x|0x)"), F.conv(F.regexp_replace(raw, "^(#x|0x)", ""), 16, 10).try_cast("long")).otherwise(raw.try_cast("long"))

    addr = attr("VarBitAddr").try_cast("long")
    letter = direction(F.col("name"), F.col("plc_path"))
    return channels.select("name", attr("VarBitSize").try_cast("int").alias("bit_size"), addr.alias("bit_addr"), F.floor(addr / 8).alias("byte"), (addr % 8).alias("bit"), hexed("IndexGroup").alias("index_group"), ea_address(letter, addr).alias("ea_address"))


def snapshot_values(events: DataFrame, key: str, snapshot: str) -> DataFrame:
    """(key, id, tag, v_bool, v_long, v_double, v_str): the typed values of a snapshot in JSON."""
    v = events.select(key, F.explode(F.from_json(F.col(snapshot), SNAPSHOT)["vars"]).alias("x")).select(key, "x.*")
    t = F.lower("t")
    return v.select(
        key,
        F.col("id"),
        t.alias("tag"),
        F.when(F.contains(t, F.lit("bool")), F.col("v").try_cast("boolean")).alias("v_bool"),
        F.when(F.contains(t, F.lit("int")), F.col("v").try_cast("decimal(20,0)")).alias("v_long"),
        F.when(t.rlike("float|double|number"), F.col("v").try_cast("double")).alias("v_double"),
        F.col("v").alias("v_str"),
    )


def incident(events: DataFrame) -> DataFrame:
    """(correlation_id, process, summary, trigger, snapshot) of event JSON (a column `value`), wherever its payload nests them."""
    v = F.try_parse_json("value")

    def pick(*paths: str) -> Column:
        return F.coalesce(*(F.try_variant_get(v, p, "string") for p in paths))

    return events.select(
        pick("$.payload.correlationId", "$.payload.ingestion.correlationId", "$.correlationId").alias("correlation_id"),
        pick("$.payload.processName", "$.processName").alias("process"),
        pick("$.payload.summary", "$.summary").alias("summary"),
        pick("$.payload.triggerEvent", "$.type").alias("trigger"),
        pick("$.payload.plcSnapshot", "$.plcSnapshot").alias("snapshot"),
    )


def outputs_exist(spark: SparkSession, *paths: str) -> bool:
    """Whether a step's outputs are all there, so that it can be skipped."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return all(jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(p)) for p in paths)
