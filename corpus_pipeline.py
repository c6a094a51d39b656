"""Documents from raw to token ids, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns the rows that it keeps; all but the last return the columns
of `documents`. Drawing copies, the classifier and the tokenizer have no SQL, so that there is none for the
whole. Tests hold the copies of `exact_dedup` and the groups of `jaccard_join` against brute force, the draws of
`mixing` against plain steps and the ids of `sentencepiece` against the library; the classifier is held to labels.

Defined cases, in all stages: rows with a null doc_id or text stay, but they are no copies; empty texts are copies of
each other; texts of any length are used whole; rows that repeat go as copies; other columns stay, whatever their
names, up to the last stage; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grafwerk.llm import exact, jaccard, mixing, pieces, toxicity
from grafwerk.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counterfactually regularised classifier doesn't reject."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents of one text the first."""
    return exact.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that n-gram Jaccard pairs connect the first."""
    return jaccard.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's weight gives it copies, once at least."""
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each document."""
    return pieces.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
