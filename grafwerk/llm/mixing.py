"""Mixing sources to target weights by pivotal dependent rounding.

A source's rate is the number of copies each of its documents should get; its whole part is given to all, and
the fraction is rounded so that every document keeps its own probability while the source's total stays fixed:
two fractional documents are paired and mass moves from one to the other, at random, until one of them is
integral. Buckets of a source are rounded side by side; each leaves one fractional document at most, and the
leftovers meet in a tree of further rounds until one per source is left, which a last draw decides.

Rates follow target weights: with `weights`, a weight for each source, a source's share of the characters is its
weight's share; sources without one are left out. Without `weights` they follow `temperature`: a source's target share of characters is its own share to that power, and the
whole is scaled so that the least-repeated source gets `least` copies of each document, or so that all copies
have `chars` characters together.

Defined cases: documents are told apart by (source, doc_id); rows that repeat both are one unit of mass and
each get its copies. A null source is a source of its own; a null doc_id is one unit. A null n_chars counts as
0; a source without characters gets `least`. Weights are 0 or more; null is the null source's key. Copies of a text
of any length count by n_chars alone. Equal fractions are paired in the order of doc_id. Columns other than source,
doc_id and n_chars may have any names. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafwerk.llm.common import cut, fresh, small, unit

TEMPERATURE = 0.7
LEAST = 1.0
#: Documents that one task rounds, and leftovers that meet in one group of the tree.
LEAF, FAN = 50_000, 256
_EPS = 1e-9


def pivot(items: Iterable[tuple[object, float]], seed: str) -> tuple[list[tuple[object, int]], tuple[object, float] | None]:
    """Round fractions by pairs: those decided as (id, 0 or 1), and the one left fractional, if any."""
    done: list[tuple[object, int]] = []
    held: tuple[object, float] | None = None
    for step, (b, q) in enumerate(items):
        if q <= _EPS or q >= 1 - _EPS:
            done.append((b, int(q > 0.5)))
            continue
        if held is None:
            held = (b, q)
            continue
        a, p = held
        draw = unit(seed, step, b if isinstance(b, int) else str(b))
        if p + q < 1:
            win, lose, rest, low = ((a, b) if draw * (p + q) < p else (b, a)) + (p + q, 0)
        else:
            # One of the two becomes 1: each with the odds that keep its own probability.
            lose, win = (a, b) if draw * (2 - p - q) < 1 - q else (b, a)
            rest, low = p + q - 1, 1
        done.append((lose, low))
        held = (win, rest)
        if rest <= _EPS or rest >= 1 - _EPS:
            done.append((win, int(rest > 0.5)))
            held = None
    return done, held


def _round(seed: str, level: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", na_position="last")
        null = rows["doc_id"].isna()
        items = [(None if z else int(i), float(p)) for i, p, z in zip(rows["doc_id"].where(~null, 0), rows["part"], null)]
        done, held = pivot(items, f"{seed}/{level}/{key[0]}/{key[1]}")
        ids = [i for i, _ in done] + ([held[0]] if held else [])
        parts = [float(v) for _, v in done] + ([held[1]] if held else [])
        return pd.DataFrame(
            {
                "source": pd.Series([key[0]] * len(ids), dtype=object),
                "doc_id": pd.array(ids, dtype="Int64"),
                "bucket": pd.Series([int(key[1])] * len(ids), dtype="int64"),
                "part": pd.Series(parts, dtype="float64"),
            }
        )

    return run


_SHAPE = "source string, doc_id long, bucket long, part double"


def rates(docs: DataFrame, temperature: float = TEMPERATURE, least: float = LEAST, weights: Mapping[str | None, float] | None = None, chars: float | None = None) -> DataFrame:
    """(source, n, rate): units of each source and the copies that each should get. One row a source."""
    one = docs.groupBy("source", "doc_id").agg(F.max(F.coalesce(F.col("n_chars"), F.lit(0))).alias("n_chars"))
    per = one.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").cast("double").alias("mass"))
    # With shares s to the power t, copies a document are s**t / s up to a factor; the least is that of the largest source.
    raw = F.when(F.col("mass") > 0, F.pow("mass", F.lit(temperature - 1.0)))
    fallback = F.lit(float(least))
    if weights is not None:
        if any(not 0 <= w < math.inf for w in weights.values()):
            raise ValueError("weights are numbers of 0 or more")
        given = docs.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], "of string, weight double")
        per = per.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("of")), "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
        raw = F.when(F.col("mass") > 0, F.col("weight") / F.col("mass"))
        fallback = F.when(F.col("weight") > 0, fallback).otherwise(0.0)
    scale = F.lit(float(least)) / F.min(F.when(raw > 0, raw)) if chars is None else F.lit(float(chars)) / F.sum(raw * F.col("mass"))
    return per.crossJoin(F.broadcast(per.agg(scale.alias("scale")))).select("source", "n", F.coalesce(F.col("scale") * raw, fallback).alias("rate"))


def copies(docs: DataFrame, temperature: float = TEMPERATURE, least: float = LEAST, seed: str = "mix", weights: Mapping[str | None, float] | None = None, chars: float | None = None) -> DataFrame:
    """(source, doc_id, copies) for each unit of `docs`; see the module for `weights` and `chars`."""
    docs = docs.select(F.col("source").cast("string").alias("source"), "doc_id", "n_chars")
    per = cut(rates(docs, temperature, least, weights, chars))
    sources, most = per.agg(F.count("*"), F.max("n")).first()
    units = docs.select("source", "doc_id").distinct()
    same = units["source"].eqNullSafe(per["source"])
    units = units.join(small(per, sources), same).select(units["source"], "doc_id", "rate", "n")
    whole = F.floor(F.col("rate") + _EPS)
    part = F.greatest(F.lit(0.0), F.col("rate") - whole)
    buckets = F.ceil(F.col("n") / F.lit(LEAF)).cast("long")
    base = units.select("source", "doc_id", whole.cast("int").alias("whole"), part.alias("part"), F.pmod(F.xxhash64("doc_id"), buckets).alias("bucket"))
    level, wide = 0, max(1, math.ceil((most or 0) / LEAF))
    state = cut(base.select("source", "doc_id", "bucket", "part").groupBy("source", "bucket").applyInPandas(_round(seed, level), _SHAPE))
    fractional = (F.col("part") > _EPS) & (F.col("part") < 1 - _EPS)
    decided = state.where(~fractional)
    left = state.where(fractional)
    while wide > 1:
        level, wide = level + 1, math.ceil(wide / FAN)
        left = left.withColumn("bucket", F.floor(F.col("bucket") / F.lit(FAN)).cast("long"))
        state = cut(left.groupBy("source", "bucket").applyInPandas(_round(seed, level), _SHAPE))
        decided = decided.unionByName(state.where(~fractional))
        left = state.where(fractional)
    # The last of a source: its total was no whole number, and one draw rounds it up or down.
    draw = F.pmod(F.xxhash64(F.lit(seed), "source", "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    decided = decided.unionByName(left.withColumn("part", F.when(draw < F.col("part"), 1.0).otherwise(0.0)))
    extra = decided.select("source", "doc_id", F.round("part").cast("int").alias("extra"))
    per_whole = per.select(F.col("source").alias("of"), F.floor(F.col("rate") + _EPS).cast("int").alias("whole"))
    return extra.join(small(per_whole, sources), extra["source"].eqNullSafe(F.col("of"))).select("source", "doc_id", (F.col("whole") + F.col("extra")).alias("copies"))


def mixed(docs: DataFrame, temperature: float = TEMPERATURE, least: float = LEAST, seed: str = "mix", weights: Mapping[str | None, float] | None = None, chars: float | None = None) -> DataFrame:
    """The rows of `docs`, each as often as its copies say, with all their columns."""
    n, s, i, again = fresh(docs, "copies", "of_source", "of_id", "again")
    given = copies(docs, temperature, least, seed, weights, chars).select(F.col("source").alias(s), F.col("doc_id").alias(i), F.col("copies").alias(n))
    # Units of one copy, mostly the large sources', need no row of the join's small side.
    joined = docs.join(given, F.col("doc_id").eqNullSafe(F.col(i)) & F.col("source").cast("string").eqNullSafe(F.col(s)))
    return joined.withColumn(again, F.explode(F.array_repeat(F.lit(1), F.col(n)))).drop(n, s, i, again)
