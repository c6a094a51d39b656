"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEYWORDS = (
    "and or not xor if then else elsif end_if while do end_while for to by end_for repeat until end_repeat case of end_case "
    "true false var var_input var_output var_in_out var_temp var_global end_var program end_program function function_block "
    "end_function end_function_block return exit bool int dint real lreal string time mod"
).split()


def strip_comments(code: Column) -> Column:
    """Code without `(* *)` and `//` comments."""
    return F.regexp_replace(F.regexp_replace(code, r"(?s)\(\*.*?\*\)", " "), r"//[^\n]*", "")


def identifiers(code: Column) -> Column:
    """The distinct identifiers of code; dotted ones stay whole and what begins with a digit is none."""
    words = F.split(strip_comments(code), r"[^A-Za-z0-9_.]+")
    trimmed = F.transform(words, lambda w: F.regexp_replace(w, r"^\.+|\.+$", ""))
    return F.array_distinct(F.filter(trimmed, lambda w: w.rlike("^[A-Za-z_]")))


def symbols(code: Column) -> Column:
    """Identifiers that are no keyword, of two letters or more unless dotted."""
    return F.filter(identifiers(code), lambda w: ~F.lower(w).isin(KEYWORDS) & ((F.length(w) > 1) | F.contains(w, F.lit("."))))


def if_guards(code: Column, most: int = 3) -> Column:
    """The first conditions between IF (or ELSIF) and THEN."""
    return F.slice(F.transform(F.regexp_extract_all(code, F.lit(r"(?is)\b(?:ELS)?IF\b(.*?)\bTHEN\b"), 1), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), 1, most)


def node_id(text: Column) -> Column:
    """`ns=4;s=OPCUA.x`, or the short `OPCUA.x`, as (ns, kind, id)."""
    ns = F.regexp_extract(text, r"(?i)ns=(\d+)", 1).try_cast("int")
    kind = F.regexp_extract(text, r"(?i)(?:^|;)([sigb])=", 1)
    ident = F.regexp_extract(text, r"(?i)(?:^|;)[sigb]=(.*)$", 1)
    short = kind == ""
    return F.struct(F.coalesce(ns, F.lit(4)).alias("ns"), F.when(short, "s").otherwise(F.lower(kind)).alias("kind"), F.when(short, text).otherwise(ident).alias("id"))


def as_bool(text: Column) -> Column:
    """true or false from what logs and snapshots write for it; null if it is neither."""
    t = F.upper(F.trim(text))
    return F.when(t.isin("1", "TRUE", "BOOL#TRUE", "BOOL#1") | F.contains(t, F.lit("#TRUE")), True).when(t.isin("0", "FALSE", "BOOL#FALSE", "BOOL#0") | F.contains(t, F.lit("#FALSE")), False)


def safe_int(text: Column) -> Column:
    """The first whole number in a text."""
    return F.regexp_extract(text, r"(-?\d+)", 1).try_cast("long")


def tolerant_equal(a: Column, b: Column, relative: float = 1e-6, absolute: float = 1e-9) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(absolute), F.lit(relative) * F.greatest(F.abs(a), F.abs(b)))


def hardware_kind(address: Column) -> Column:
    """sensor for inputs (`%I`, `I n`), actor for outputs (`%Q`, `Q n`)."""
    t = F.upper(F.trim(address))
    return F.when(t.rlike(r"^(%I|I\s*\d)"), "sensor").when(t.rlike(r"^(%Q|Q\s*\d)"), "actor")


def hardware_kind_loose(address: Column) -> Column:
    t = F.upper(address)
    return F.when(F.contains(t, F.lit("Q")), "actor").when(F.contains(t, F.lit("I")), "sensor")


def scope_token(text: Column) -> Column:
    """What stands before the first `_` or `.`."""
    return F.regexp_extract(text, r"^([^_.]+)", 1)


def scope_score(name: Column, hint: Column) -> Column:
    """How well a name fits a scope: equal 100 (in any case 90), prefix 60 (50), start 40, part 20."""
    n, h = F.lower(name), F.lower(hint)
    return F.when(F.length(F.trim(hint)) == 0, 0).otherwise(
        F.greatest(
            F.when(name == hint, 100).otherwise(0),
            F.when(n == h, 90).otherwise(0),
            F.when(F.startswith(name, F.concat(hint, F.lit("_"))), 60).otherwise(0),
            F.when(F.startswith(n, F.concat(h, F.lit("_"))), 50).otherwise(0),
            F.when(F.startswith(n, h), 40).otherwise(0),
            F.when(F.contains(n, h), 20).otherwise(0),
        )
    )


def gemma_state(name: Column) -> Column:
    return name.rlike(r"(?i)^[AFD]\d+$")


def expression_id(caller: Column, text: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", caller, text)), 1, 10)


def clean_expression(text: Column) -> Column:
    return F.trim(F.translate(F.regexp_replace(text, r"(?i)\bNOT\s+", ""), "()", ""))


def humanize(text: Column) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "[_.]+", " ")
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def sanitize_id(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_]+", "_"), "^_+|_+$", "")


def has_symbol(code: Column, symbol: str) -> Column:
    return code.rlike(rf"(?i)(?<![\w.]){_quote(symbol)}(?![\w.])")


def _quote(text: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "\\" + c for c in text)


def verdict(text: Column) -> Column:
    """correct, partially_correct or incorrect, whatever the words around it."""
    t = F.lower(F.trim(text))
    return F.when(F.contains(t, F.lit("partial")), "partially_correct").when(F.contains(t, F.lit("incorrect")) | F.contains(t, F.lit("wrong")), "incorrect").when(F.contains(t, F.lit("correct")), "correct").otherwise("unknown")


def preview(text: Column, most: int = 160) -> Column:
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 3), F.lit("..."))).otherwise(t)


def repaired_json(text: Column) -> Column:
    """Event JSON whose `jobId` value may lack its quotes."""
    return F.regexp_replace(text, r'("jobId"\s*:\s*)([A-Za-z_][\w.-]*)', '$1"$2"')


def counterpart(name: Column) -> Column:
    """The inner sensor of an outer one, and the other way round."""
    return F.when(F.contains(name, F.lit("_aussen")), F.replace(name, F.lit("_aussen"), F.lit("_innen"))).when(F.contains(name, F.lit("_innen")), F.replace(name, F.lit("_innen"), F.lit("_aussen")))


def declared_type(text: Column) -> Column:
    """The value type that a declared type stands for, by the first part that it contains."""
    t = F.lower(text)
    out = F.lit("string")
    for part, kind in reversed((("bool", "bool"), ("uint16", "uint16"), ("int16", "int16"), ("uint32", "uint32"), ("int32", "int32"), ("uint64", "uint64"), ("int64", "int64"), ("float", "double"), ("double", "double"), ("string", "string"))):
        out = F.when(F.contains(t, F.lit(part)), kind).otherwise(out)
    return out
