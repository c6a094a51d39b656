"""Matching snapshots against expectations, and the decision that follows."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafwerk.functions.text import repaired_json, tolerant_equal


def same_value(kind: Column, want: Column, have: Column) -> Column:
    """Whether two values as text agree, numbers of kind double within tolerance; false where either lacks or can't be read."""
    numbers = tolerant_equal(want.try_cast("double"), have.try_cast("double"))
    whole = want.try_cast("decimal(20,0)") == have.try_cast("decimal(20,0)")
    flags = want.try_cast("boolean") == have.try_cast("boolean")
    out = F.when(kind == "bool", flags).when(kind.isin("double", "float"), numbers).when(F.contains(kind, F.lit("int")), whole).otherwise(want == have)
    return F.coalesce(out, F.lit(False))


def expectation_match(candidates: DataFrame, expected: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(candidate, matches): whether all that a candidate expects (candidate, id, kind, want) is in the snapshot (id, have).

    A missing value fails; a candidate without expectations passes.
    """
    seen = snapshot.groupBy("id").agg(F.max("have").alias("have"))
    checked = expected.join(seen, "id", "left").select("candidate", same_value(F.col("kind"), F.col("want"), F.col("have")).alias("ok"))
    all_ok = checked.groupBy("candidate").agg(F.bool_and("ok").alias("ok"))
    return candidates.select("candidate").distinct().join(all_ok, "candidate", "left").select("candidate", F.coalesce("ok", F.lit(True)).alias("matches"))


def monitoring_winners(candidates: DataFrame, outputs: DataFrame) -> DataFrame:
    """Candidates that have no payload, or whose calls all succeeded with matching outputs (candidate, ok, matches)."""
    per = outputs.groupBy("candidate").agg(F.bool_and(F.coalesce("ok", F.lit(False)) & F.coalesce("matches", F.lit(False))).alias("good"))
    return candidates.join(per, "candidate", "left").where(F.coalesce("good", F.lit(True))).select(*candidates.columns)


def system_winners(candidates: DataFrame, outputs: DataFrame) -> DataFrame:
    """As for monitoring, but a candidate without payload fails."""
    per = outputs.groupBy("candidate").agg(F.bool_and(F.coalesce("ok", F.lit(False)) & F.coalesce("matches", F.lit(False))).alias("good"))
    return candidates.join(per.where("good"), "candidate", "left_semi")


def decision(incidents: DataFrame, winners: DataFrame) -> DataFrame:
    """(incident, winners, action, winner): the reaction of the only winner, else an unknown failure."""
    per = winners.groupBy("incident").agg(F.count("*").alias("n"), F.min("candidate").alias("only"))
    n = F.coalesce("n", F.lit(0))
    one = n == 1
    return incidents.select("incident").join(per, "incident", "left").select(
        "incident",
        n.cast("long").alias("winners"),
        F.when(one, "SystemReaction").otherwise("UnknownFM").alias("action"),
        F.when(one, F.col("only").cast("string")).otherwise("").alias("winner"),
    )


def output_match(calls: DataFrame, outputs: DataFrame) -> DataFrame:
    """(call, matches) of calls (call, name, kind, want) against what came back (call, name, have): every wanted output must be there and agree."""
    seen = outputs.groupBy("call", "name").agg(F.max("have").alias("have"))
    ok = same_value(F.col("kind"), F.col("want"), F.col("have"))
    return calls.join(seen, ["call", "name"], "left").groupBy("call").agg(F.bool_and(ok).alias("matches"))


def summaries(incidents: DataFrame, candidates: DataFrame, winners: DataFrame) -> DataFrame:
    """(incident, considered, won, lost): the candidates (incident, candidate) of each, those that won and the others, as sorted lists."""
    marked = candidates.select("incident", "candidate").distinct().join(winners.select("incident", "candidate", F.lit(True).alias("won")).distinct(), ["incident", "candidate"], "left")

    def listed(when: Column) -> Column:
        return F.concat_ws(",", F.sort_array(F.collect_list(F.when(when, F.col("candidate").cast("string")))))

    won = F.coalesce("won", F.lit(False))
    per = marked.groupBy("incident").agg(listed(F.lit(True)).alias("considered"), listed(won).alias("w"), listed(~won).alias("lost"))
    return incidents.select("incident").join(per, "incident", "left").select("incident", *(F.coalesce(c, F.lit("")).alias(n) for n, c in (("considered", "considered"), ("won", "w"), ("lost", "lost"))))


#: The rest of a line with the white space behind it; strings and braces of JSON.
_LINE, _BRACES = re.compile(r"([^\r\n]*)\s*"), re.compile(r'"(?:[^"\\]|\\.)*"?|[{}]', re.S)


def iri_pairs(text: str | None) -> list[dict[str, str]] | None:
    """The pairs of a line with an IRI and the JSON object that follows it; a line that none follows is left out."""
    if text is None:
        return None
    if len(text) > 1 and text[0] == text[-1] == '"':
        text = text[1:-1]
    out, at = [], 0
    while at < len(text):
        line = _LINE.match(text, at)
        name, at = line.group(1).strip(" \t"), line.end()
        if not name or text[at : at + 1] != "{":
            continue
        begin, depth, at = at, 0, len(text)
        for token in _BRACES.finditer(text, begin):
            depth += {"{": 1, "}": -1}.get(token.group(), 0)
            if not depth:
                at = token.end()
                break
        out.append({"iri": name, "payload": text[begin:at]})
    return out


def pair_rows(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, nth, iri, payload) of texts in which IRIs and JSON objects alternate."""

    def parted(column: pd.Series) -> pd.Series:
        return column.map(iri_pairs)

    taken = F.pandas_udf(parted, "array<struct<iri:string,payload:string>>")
    return texts.select(key, F.posexplode(taken(F.col(text))).alias("nth", "x")).select(key, "nth", "x.*")


PLAN_ROWS = "rows array<struct<step:int, g:string, k:string, i:int, t:string, v:string>>"


def plan_rows(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, step, object, method, inputs, outputs) from JSON rows of step, group, key, index, type and value.

    A step without an object or a method is dropped. Inputs and outputs are `index:type=value` by index.
    """
    rows = payloads.select(key, F.explode(F.from_json(repaired_json(F.col(payload)), PLAN_ROWS)["rows"]).alias("r")).select(key, "r.*")

    def listed(group: str) -> Column:
        item = F.when(F.col("g") == group, F.struct("i", F.concat(F.col("i").cast("string"), F.lit(":"), F.col("t"), F.lit("="), F.col("v")).alias("x")))
        return F.concat_ws(",", F.transform(F.sort_array(F.collect_list(item)), lambda s: s["x"]))

    def value(k: str) -> Column:
        return F.max(F.when((F.col("g") == "method") & (F.col("k") == k), F.col("v")))

    per = rows.groupBy(key, "step").agg(value("object").alias("object"), value("method").alias("method"), listed("input").alias("inputs"), listed("output").alias("outputs"))
    return per.where("object IS NOT NULL AND method IS NOT NULL")


def direction(channel: Column, path: Column) -> Column:
    """The letter of an IO direction, from the channel's ending, else from the PLC path, else `?`."""
    c, p = F.lower(channel), F.lower(path)
    return F.when(c.rlike(r"(output|\bout)s?$"), "Q").when(c.rlike(r"(input|\bin)s?$"), "I").when(F.contains(p, F.lit("plctask outputs")), "Q").when(F.contains(p, F.lit("plctask inputs")), "I").otherwise("?")


def ea_address(letter: Column, bits: Column) -> Column:
    """`I 2.3` from a letter and a bit address."""
    return F.concat(letter, F.lit(" "), F.floor(bits / 8).cast("string"), F.lit("."), (bits % 8).cast("string"))


def cost(prompt: Column, answer: Column, price_in: float, price_out: float) -> Column:
    """Price of a run at prices for 1000 tokens."""
    return F.round(prompt / 1000 * price_in + answer / 1000 * price_out, 6)


def rollup(runs: DataFrame) -> DataFrame:
    """(agent, runs, correct, partial, incorrect, mean_s, tokens, usd) of evaluated runs (agent, verdict, seconds, tokens, usd)."""
    return runs.groupBy("agent").agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("verdict") == "correct").alias("correct"),
        F.count_if(F.col("verdict") == "partially_correct").alias("partial"),
        F.count_if(F.col("verdict") == "incorrect").alias("incorrect"),
        F.round(F.avg("seconds"), 4).alias("mean_s"),
        F.sum("tokens").alias("tokens"),
        F.round(F.sum("usd"), 6).alias("usd"),
    )


def path_scores(rows: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(incident, path, possible, score, rank) of requirement rows (incident, path, token, value, exact) against a snapshot (token, now).

    A token that reads as required counts 6 (3 where it was only inferred) besides 2 (1) for being required at
    all; one that reads otherwise costs as much, and makes the path impossible.
    """
    seen = rows.join(snapshot, "token", "left")
    own = F.when(F.col("exact"), 2).otherwise(1)
    weight = F.when(F.col("exact"), 6).otherwise(3)
    against = F.col("now").isNotNull() & (F.col("now") != F.col("value"))
    points = own + F.when(F.col("now").isNull(), 0).when(against, -weight - own).otherwise(weight)
    per = seen.groupBy("incident", "path").agg(~F.bool_or(against), F.sum(points)).toDF("incident", "path", "possible", "score")
    rank = F.row_number().over(Window.partitionBy("incident").orderBy(F.desc("possible"), F.desc("score"), "path"))
    return per.withColumn("rank", rank)
