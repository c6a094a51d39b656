"""The data model: triples, terms and their helpers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The vocabulary's own namespace; graphs that use another one are brought to it by `rebase`.
AG = "http://example.org/plant/"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
TYPE, SUBCLASS = f"{RDF}type", f"{RDFS}subClassOf"

PREFIXES = {"ag": AG, "op": f"{AG}op_", "dp": f"{AG}dp_", "rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD}

TRIPLES = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("s", "p", "o", "o_kind", "o_dtype", "o_lang")],
)


def iri(name: str, prefixes: dict[str, str] = PREFIXES) -> str:
    """`op:callsPOU` in full; other names as they are."""
    head, colon, tail = name.partition(":")
    return prefixes[head] + tail if colon and head in prefixes else name


def triples(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """Triples from (s, p, o) of prefixed names, where an `o` in double quotes is a literal."""
    out = []
    for s, p, o in rows:
        literal = o.startswith('"')
        out.append((iri(s), iri(p), o[1:-1] if literal else iri(o), "literal" if literal else "iri", None, None))
    return spark.createDataFrame(out, TRIPLES)


def shaped(df: DataFrame, s: Column, p: str, o: Column, kind: str = "literal") -> DataFrame:
    """Triples with the predicate `p` from columns of `df`; rows with a null end give none."""
    none = F.lit(None).cast("string")
    out = df.select(s.cast("string").alias("s"), F.lit(iri(p)).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), none.alias("o_dtype"), none.alias("o_lang"))
    return out.where("s IS NOT NULL AND o IS NOT NULL")


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def as_set(df: DataFrame) -> DataFrame:
    """Triples with the duplicates gone: a graph is a set."""
    return df.dropDuplicates(["s", "p", "o", "o_kind", "o_dtype", "o_lang"])


def rebase(graph: DataFrame, base: str) -> DataFrame:
    """The graph with IRIs below `base` moved to the vocabulary's own namespace."""

    def moved(c: str) -> Column:
        return F.when(F.startswith(c, F.lit(base)), F.concat(F.lit(AG), F.substring(F.col(c), F.lit(len(base) + 1), F.length(c)))).otherwise(F.col(c)).alias(c)

    o = F.when(F.col("o_kind") == "iri", moved("o")).otherwise(F.col("o")).alias("o")
    return graph.select(moved("s"), moved("p"), o, "o_kind", "o_dtype", "o_lang")


def local_name(term: Column) -> Column:
    """What follows the last `/` or `#` of an IRI."""
    return F.regexp_extract(term, r"([^/#]*)$", 1)


def encode_name(name: Column, strict: bool = False) -> Column:
    """A name as the end of an IRI; `strict` also drops quotes and angle brackets."""
    out = F.replace(F.replace(F.replace(name, F.lit("^"), F.lit("__dach__")), F.lit("."), F.lit("__dot__")), F.lit(" "), F.lit("__leerz__"))
    return F.translate(out, "'<>", "") if strict else out
