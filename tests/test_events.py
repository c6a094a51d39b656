import os

import pytest
from pyspark.sql import functions as F

from conftest import DATA, same_rows
from grafwerk.operators import decide, search
from grafwerk.streaming import events as ev


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(str(DATA / "sf0.001/events.parquet")).withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.fixture
def stream(spark, table, tmp_path):
    # Two files in the order of time: two batches.
    middle = table.orderBy("ts").limit(table.count() // 2)
    middle.coalesce(1).write.parquet(str(tmp_path / "in"))
    for f in (tmp_path / "in").iterdir():
        os.utime(f, (1_700_000_000, 1_700_000_000))  # the first to be read
    table.join(middle.select("event_id"), "event_id", "left_anti").select(table.columns).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(spark, df, name):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_stream_edges(spark, table, stream):
    flag = F.col("event_type") == "error"
    got = run(spark, ev.stream_rising_edges(stream, "user_id", flag), "edges").select("event_id").collect()
    assert same_rows(got, ev.rising_edges(table, "user_id", flag).select("event_id").collect())
    assert len(got) > 0


def test_stream_first_only(spark, table, stream):
    got = run(spark, ev.stream_first_only(stream, "user_id", "event_type", "purchase", "60 days"), "gate")
    assert got.count() == ev.first_only(table, "user_id", "event_type", "purchase").count()


@pytest.mark.parametrize("kind", ["durations", "coordinated", "sessions"])
def test_stream_equals_batch(spark, table, tmp_path, kind):
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    if kind == "durations":
        got = run(spark, ev.stream_durations(stream, "user_id"), "d").select("event_id", "duration_ms", "sum_ms")
        want = ev.durations(table, "user_id").select("event_id", "duration_ms", "sum_ms")
    elif kind == "coordinated":
        got = run(spark, ev.stream_coordinated(stream, "user_id", "event_type", "error", "signup"), "c")
        want = ev.coordinated(table, "user_id", "event_type", "error", "signup")
    else:
        got = run(spark, ev.stream_sessions(stream, "user_id", "event_type", ("signup", "error"), "purchase"), "s").select("user_id", "session", "n")
        want = ev.sessions(table, "user_id", "event_type", ("signup", "error"), "purchase").where("closed").select("user_id", "session", "n")
    assert same_rows([tuple(r) for r in got.collect()], [tuple(r) for r in want.collect()])


def test_csv_sink(spark, table, tmp_path):
    write = ev.append_csv(str(tmp_path / "csv"))
    for _ in range(2):
        write(table.limit(3).select("event_id", "event_type"), 0)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 6


def test_lexical_topk(spark):
    c = spark.createDataFrame([("pou:A", "POU", "Motor_A", "motor motor start motor motor motor motor"), ("gvl:B", "GVL", "B", "start stop alarm"), ("pou:C", "POU", "Alarm", "alarm handler")], "chunk_id string, kind string, name string, text string")
    q = spark.createDataFrame([(1, "motor start alarm")], "question_id int, question string")
    got = [(r["chunk_id"], r["score"], r["overlap"]) for r in search.lexical_topk(c, q, 3).orderBy("rank").collect()]
    assert got == [("pou:A", 23.5, 2), ("pou:C", 6.5, 1), ("gvl:B", 2.0, 2)]


def test_xml_chunks(spark):
    body = "x := 1; " * 30
    df = spark.createDataFrame([(1, f'<p><pou name="A"><ST>{body}</ST></pou></p>'), (2, body)], "id int, xml string")
    assert {(r["id"], r["kind"], r["name"]) for r in search.chunks_of_xml(df, "id", "xml").collect()} == {(1, "pou", "A"), (2, "text", "")}


def test_skill_candidates(spark):
    s = spark.createDataFrame([("move bin", "S1"), ("zzz", "S2")], "skill string, station string")
    n = spark.createDataFrame([("move_bin", "S1"), ("move bin", "S2"), ("aaa", "S2")], "candidate string, station string")
    assert {(r["skill"], r["candidate"]) for r in search.skill_candidates(s, n).collect()} == {("move bin", "move bin"), ("zzz", "aaa")}


def test_winners_and_scores(spark):
    c = spark.createDataFrame([("a",), ("b",), ("c",)], "candidate string")
    o = spark.createDataFrame([("a", True, True), ("b", True, False)], "candidate string, ok boolean, matches boolean")
    assert {r[0] for r in decide.monitoring_winners(c, o).collect()} == {"a", "c"}
    assert {r[0] for r in decide.system_winners(c, o).collect()} == {"a"}
    rows = spark.createDataFrame([(1, "p", "x", True, True), (1, "q", "x", False, True), (1, "r", "y", True, False)], "incident int, path string, token string, value boolean, exact boolean")
    now = spark.createDataFrame([("x", True)], "token string, now boolean")
    assert [(r["path"], r["possible"], r["score"]) for r in decide.path_scores(rows, now).orderBy("rank").collect()] == [("p", True, 8), ("r", True, 1), ("q", False, -6)]


def test_lexical_topk_sends_only_the_best(spark, monkeypatch):
    rows = [(k, "POU" if k % 2 else "GVL", f"n{k % 5} alarm" if k % 7 == 0 else None if k == 4 else f"n{k}", f"motor start {'alarm ' * (k % 9)} x{k}" if k != 3 else None) for k in range(200)]
    rows += [(7, "POU", "n2 alarm", "motor alarm alarm"), (None, "POU", "motor", "motor start alarm")]
    c = spark.createDataFrame(rows, "chunk_id long, kind string, name string, text string").repartition(3)
    q = spark.createDataFrame([(1, "motor start alarm"), (2, "ALARM"), (3, "nothing"), (4, None)], "question_id int, question string")
    found = search.lexical_topk(c, q, 4)
    got = sorted(tuple(r) for r in found.collect() if r["chunk_id"] != 7)
    monkeypatch.setattr(search, "BROADCAST_BYTES", -1)
    want = sorted(tuple(r) for r in search.lexical_topk(c, q, 4).collect() if r["chunk_id"] != 7)
    assert got == want and {r[0] for r in got} == {1, 2}
    monkeypatch.undo()
    once = search.lexical_topk(c.where("chunk_id <> 7"), q, 4)
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "token" not in plan and "hashpartitioning(chunk_id" not in plan
