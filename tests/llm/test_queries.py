import pytest

import corpus_pipeline
from conftest import DATA, against_sql
from grafwerk.llm import queries, sql


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_equals_sql(spark, name):
    against_sql(spark, name, queries.queries(), sql.oracle_sql())


def test_ten_queries():
    assert {int(n[2:].split("_")[0]) for n in queries.queries()} == set(range(1, 11))


def test_pipeline(spark, tmp_path):
    sf = str(DATA / "sf0.001")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    whole = corpus_pipeline.run(spark, sf)
    assert sorted((r["doc_id"], r["n_ids"]) for r in whole.collect()) == sorted((r["doc_id"], r["n_ids"]) for r in docs.collect())
    assert docs.where("not round_trip").count() == 0


def test_stages_with_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeats, an empty table and columns of clashing names through every stage."""
    sf = str(DATA / "sf0.001")
    words = [f"word{i}" for i in range(60)]
    rows = [
        (1, " ".join(words), "en", "a", 400),
        (1, " ".join(words), "en", "a", 400),
        (2, " ".join([*words[:-1], "other"]), "en", "a", 400),
        (2, "nothing like the others at all here", None, None, None),
        (None, " ".join(words), "en", "b", 400),
        (3, None, "de", "a", None),
        (4, "", "de", "b", 0),
        (5, "", "de", "b", 0),
        (6, "long " * 40_000, "fr", "b", 200_000),
        (7, "x" * 50_000, "fr", "b", 50_000),
    ]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, gone int, copies int")
    for turn, docs in enumerate((df, df.limit(0))):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == df.columns, name
            path = str(tmp_path / f"{turn}-{k}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            if docs.count() and name == "jaccard_join":
                # Of equal texts one stays, near copies go by text, not by doc_id.
                got = sorted((r["doc_id"] or 0, (r["text"] or "")[:8]) for r in docs.collect())
                assert got == [(1, "word0 wo"), (2, "nothing "), (3, ""), (4, ""), (6, "long lon"), (7, "xxxxxxxx")]
        if docs.count():
            assert {r["doc_id"] for r in docs.collect()} == {1, 2, 3, 4, 6, 7}
