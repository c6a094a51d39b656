import random

from grafwerk.llm import exact

DOCS = "doc_id long, text string, source string, more map<string,string>, copy_of long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, {"k": "v"}, 1) for i, t, s in rows], DOCS)


def test_cuckoo_index_follows_a_set():
    r = random.Random(3)
    index, live = exact.CuckooIndex(1), {}
    keys = [r.getrandbits(64) for _ in range(3000)]
    for _ in range(20_000):
        k = r.choice(keys)
        if r.random() < 0.6:
            assert index.insert(k) == (k not in live)
            live[k] = live.get(k, 0) + 1
        else:
            assert index.delete(k) == (k in live)
            if k in live:
                live[k] -= 1
                if not live[k]:
                    del live[k]
    assert index.resizes > 0
    assert all(k in index for k in live) and not any(k in index for k in keys if k not in live)


def test_copies_and_rows_that_stay(spark):
    rows = [(5, "a", "s"), (2, "a", "t"), (2, "a", "t"), (9, "b", None), (None, "a", "n"), (7, None, "x"), (8, None, "x"), (1, "", "e"), (3, "", "e"), (4, "x" * 200_000, None)]
    d = docs(spark, rows)
    got = sorted((r["doc_id"] is None, r["doc_id"], r["copy_of"]) for r in exact.copies(d).collect())
    assert got == [(False, 2, 2), (False, 3, 1), (False, 5, 2), (True, None, 2)]
    kept = exact.dedup(d)
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 7, 8, 9]


def test_withdrawn_rows_take_no_part(spark):
    from pyspark.sql import functions as F

    d = docs(spark, [(1, "a", "s"), (2, "a", "s"), (3, "b", "s"), (4, "b", "s"), (5, "b", "s")])
    got = {tuple(r) for r in exact.copies(d, withdrawn=F.col("doc_id").isin(1, 3)).collect()}
    assert got == {(5, 4)}


def test_empty_table(spark):
    d = docs(spark, [])
    assert exact.copies(d).count() == 0 and exact.dedup(d).count() == 0
