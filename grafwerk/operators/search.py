"""Text and vector retrieval."""

from __future__ import annotations

import re
from bisect import insort
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafwerk.operators.graph import BROADCAST_BYTES, cut, small

WINDOW, OVERLAP, LEAST = 3200, 240, 80


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and `_` of two characters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]{2,}"), 0)


def term_frequency(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, tf)."""
    return docs.select(key, F.explode(tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


def lexical_topk(chunks: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(question_id, chunk_id, score, overlap, rank) from chunks (chunk_id, kind, name, text) and questions (question_id, question).

    A token of the question scores its frequency in the chunk, 5 at most, four times that if the chunk's name
    holds it; the whole question as a phrase adds 6, a POU whose name holds a token 2.5. Of equal scores the one
    with more tokens in common is first, then the shorter, then the smaller id. Chunks without an id aren't found.

    Few questions go to the chunks as a whole: each task sends its `k` best of every question and nothing else.
    Chunks whose id repeats count as one, and for those, or for many questions, tokens are joined and shuffled.
    """
    chunks = chunks.where("chunk_id IS NOT NULL")
    asked = cut(questions.select("question_id", F.explode(F.array_distinct(tokens(F.col("question")))).alias("token")))
    n = asked.count()
    if n * 200 <= BROADCAST_BYTES:
        repeated = cut(chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").select("chunk_id"))
        again = repeated.count()
        best = _best_of_tasks(chunks if again == 0 else chunks.join(small(repeated, again), "chunk_id", "left_anti"), questions, asked, k)
        if again:
            best = best.unionByName(_joined(chunks.join(small(repeated, again), "chunk_id", "left_semi"), questions, asked, n, k))
    else:
        best = _joined(chunks, questions, asked, n, k)
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), F.desc("overlap"), "size", "chunk_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("question_id", "chunk_id", "score", "overlap", "rank")


def _best_of_tasks(chunks: DataFrame, questions: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(question_id, chunk_id, score, overlap, size): of each task the `k` best chunks of every question."""
    ids: dict = {}
    askers: dict[str, list[int]] = {}
    for r in asked.collect():
        askers.setdefault(r["token"], []).append(ids.setdefault(r["question_id"], len(ids)))
    phrases: list[list[str]] = [[] for _ in ids]
    for r in questions.select("question_id", F.lower(F.trim("question")).alias("phrase")).where("phrase IS NOT NULL").collect():
        if r["question_id"] in ids:
            phrases[ids[r["question_id"]]].append(r["phrase"])
    kinds = dict(questions.dtypes)["question_id"], dict(chunks.dtypes)["chunk_id"]
    shape = f"question_id {kinds[0]}, chunk_id {kinds[1]}, score double, overlap bigint, size int"

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(r"[a-z0-9_]{2,}")
        top: list[list[tuple]] = [[] for _ in ids]
        for batch in batches:
            for ident, pou, name, size, text in zip(*(c.to_pylist() for c in batch.columns)):
                points = [0.0] * len(ids)
                overlap = [0] * len(ids)
                more = [0.0] * len(ids)
                for token, tf in Counter(t for t in word.findall(text) if t in askers).items():
                    named = name is not None and token in name
                    gain = min(tf, 5) * (4.0 if named else 1.0)
                    for q in askers[token]:
                        points[q] += gain
                        overlap[q] += 1
                        if named and pou:
                            more[q] = 2.5
                for q, common in enumerate(overlap):
                    if not common:
                        continue
                    score, kept = points[q] + more[q], top[q]
                    if len(kept) >= k and score + 6.0 < -kept[-1][0]:
                        continue
                    if any(phrase in text for phrase in phrases[q]):
                        score += 6.0
                    row = (-score, -common, size, ident)
                    if len(kept) < k or row < kept[-1]:
                        insort(kept, row)
                        del kept[k:]
        rows = [(q, r[3], -r[0], -r[1], r[2]) for q, kept in zip(ids, top) for r in kept]
        cols = list(zip(*rows)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, out)], names)

    texts = chunks.select("chunk_id", (F.col("kind") == "POU").alias("pou"), F.lower("name").alias("name"), F.length("text").alias("size"), F.lower("text").alias("text")).where("text IS NOT NULL")
    empty = chunks.sparkSession.createDataFrame([], shape).toArrow().schema
    out, names = empty.types, empty.names
    return texts.mapInArrow(best, shape)


def _joined(chunks: DataFrame, questions: DataFrame, asked: DataFrame, n: int, k: int) -> DataFrame:
    """(question_id, chunk_id, score, overlap, size) of all chunks that may be among the `k` best, by joins."""
    few = small(asked, n)
    # Tokens that no question has go first; texts don't travel with the others.
    lists = chunks.select("chunk_id", (F.col("kind") == "POU").alias("pou"), F.lower("name").alias("name"), F.length("text").alias("size"), F.explode(tokens(F.col("text"))).alias("token"))
    tf = lists.join(small(asked.select("token").distinct(), n), "token", "left_semi").groupBy("chunk_id", "token").agg(F.count("*").alias("tf"), *(F.first(c).alias(c) for c in ("pou", "name", "size")))
    named = F.contains("name", F.col("token"))
    hits = tf.select("chunk_id", "token", "size", named.alias("named"), (F.col("pou") & named).alias("pou"), (F.least(F.col("tf"), F.lit(5)) * F.when(named, 4.0).otherwise(1.0)).alias("points"))
    base = hits.join(few, "token").groupBy("question_id", "chunk_id").agg(
        (F.sum("points") + F.max(F.when(F.col("pou"), 2.5).otherwise(0.0))).alias("base"), F.count("*").alias("overlap"), F.first("size").alias("size")
    )
    # The phrase adds 6: only those that it could lift among the first k are looked at for it.
    by = Window.partitionBy("question_id")
    kth = F.min(F.when(F.col("place") == k, F.col("base"))).over(by)
    near = base.withColumn("place", F.row_number().over(by.orderBy(F.desc("base")))).withColumn("kth", kth).where("kth IS NULL OR base + 6.0 >= kth")
    near = cut(near.drop("place", "kth"))
    phrases = questions.select("question_id", F.lower(F.trim("question")).alias("phrase"))
    read = near.select("question_id", "chunk_id").join(phrases, "question_id").join(chunks.select("chunk_id", F.lower("text").alias("text")), "chunk_id")
    whole = read.where(F.contains("text", F.col("phrase"))).select("question_id", "chunk_id", F.lit(6.0).alias("more"))
    total = near.join(whole, ["question_id", "chunk_id"], "left").withColumn("score", F.col("base") + F.coalesce("more", F.lit(0.0)))
    return total.select("question_id", "chunk_id", "score", "overlap", "size")


def squared_distance(a: Column | str, b: Column | str) -> Column:
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def vector_topk(vectors: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """(probe_id, vec_id, distance, rank): the nearest vectors of few probes, exactly.

    Probes (probe_id, probe) are given by the caller and broadcast; every vector is measured in one pass. A
    partial top-k in each partition goes ahead of the shuffle.
    """
    each = vectors.select("vec_id", "embedding").crossJoin(F.broadcast(probes))
    scored = each.select("probe_id", "vec_id", F.round(F.sqrt(squared_distance("embedding", "probe")), 4).alias("distance"))
    order = Window.partitionBy("probe_id").orderBy("distance", "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def windows(docs: DataFrame, key: str, text: str, size: int = WINDOW, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """(key, part, chunk): windows of a text, each starting `overlap` before the last one's end; too short ones go."""
    step = size - overlap
    n = F.length(text)
    last = F.greatest(F.lit(0), F.ceil((n - F.lit(overlap)) / F.lit(step)) - 1).cast("int")
    at = docs.where(F.col(text).isNotNull()).select(key, text, F.explode(F.sequence(F.lit(0), last)).alias("part"))
    return at.select(key, "part", F.substring(F.col(text), F.col("part") * step + 1, F.lit(size)).alias("chunk")).where(F.length("chunk") >= least)


def chunks_of_xml(docs: DataFrame, key: str, xml: str, tags: tuple[str, ...] = ("pou", "globalVars", "dataType", "ST", "interface")) -> DataFrame:
    """(key, kind, name, part, chunk): elements of interest as text windows, one for each beginning of 180 characters.

    A text without any such element is windowed as it is.
    """
    from pyspark.sql.types import ArrayType, StringType, StructField, StructType

    shape = ArrayType(StructType([StructField(c, StringType()) for c in ("kind", "name", "body")]))
    names = "|".join(tags)
    found = F.regexp_extract_all(F.col(xml), F.lit(rf"(?s)<(?:{names})\b[^>]*>.*?</(?:{names})>"), 0)

    def part(x: Column) -> Column:
        return F.struct(F.regexp_extract(x, r"^<(\w+)", 1).alias("kind"), F.regexp_extract(x, r'^<[^>]*\bname="([^"]*)"', 1).alias("name"), F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\s+", " ")).alias("body"))

    parts = F.transform(found, part)
    whole = F.array(F.struct(F.lit("text").alias("kind"), F.lit("").alias("name"), F.trim(F.regexp_replace(F.col(xml), r"\s+", " ")).alias("body")))
    rows = docs.select(key, F.posexplode(F.when(F.size(found) > 0, parts).otherwise(whole).cast(shape)).alias("pos", "e")).select(key, "pos", "e.*")
    rows = rows.withColumn("head", F.substring("body", 1, 180))
    first = F.row_number().over(Window.partitionBy(key, "head").orderBy("pos"))
    rows = rows.withColumn("nth", first).where("nth = 1").withColumn("id", F.struct(key, "pos", "kind", "name"))
    return windows(rows, "id", "body").select("id.*", "part", "chunk")


def snippets(docs: DataFrame, key: str, text: str, term: str, radius: int = 2, most: int = 5) -> DataFrame:
    """(key, line, snippet): the lines around each line that contains the term, the first few of a text."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "content"))
    order = Window.partitionBy(key).orderBy("pos")
    around = F.concat_ws("\n", F.collect_list("content").over(order.rowsBetween(-radius, radius)))
    marked = lines.select(key, (F.col("pos") + 1).alias("line"), "content", around.alias("snippet")).where(F.contains(F.lower("content"), F.lit(term.lower())))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("line"))
    return marked.withColumn("nth", nth).where(F.col("nth") <= most).select(key, "line", "snippet")


def aliases(ident: Column) -> Column:
    """The names under which a snapshot's id may be looked for, with their scores: whole 100, last three parts 92, last two 88, last one 55."""
    parts = F.split(F.lower(ident), r"[./]")
    n = F.size(parts)

    def tail(k: int, score: int) -> Column:
        return F.when(n >= k, F.struct(F.concat_ws(".", F.slice(parts, F.greatest(n - k + 1, F.lit(1)), F.lit(k))).alias("alias"), F.lit(score).alias("score")))

    whole = F.struct(F.concat_ws(".", parts).alias("alias"), F.lit(100).alias("score"))
    return F.filter(F.array(whole, tail(3, 92), tail(2, 88), tail(1, 55)), lambda x: x.isNotNull())


def alias_index(items: DataFrame, key: str, ident: str) -> DataFrame:
    """(key, alias, score): each alias of an item with the best of its scores."""
    each = items.select(key, F.explode(aliases(F.col(ident))).alias("a")).select(key, "a.*")
    return each.groupBy(key, "alias").agg(F.max("score").alias("score"))


def best_hits(items: DataFrame, key: str, ident: str, wanted: DataFrame, scope: str | None = None) -> DataFrame:
    """(symbol, key, score): for each wanted symbol the item that fits best; the smaller key of equals.

    Scores of the item's alias and of the symbol's add up; an id in the wanted scope has 25 more.
    """
    sym = wanted.select("symbol", F.explode(aliases(F.col("symbol"))).alias("a")).select("symbol", "a.alias", F.col("a.score").alias("own"))
    sym = sym.groupBy("symbol", "alias").agg(F.max("own").alias("own"))
    # A last part alone is shared by very many: it counts only where the symbol itself has no more parts.
    sym = sym.where((F.col("own") > 55) | ~F.lower("symbol").rlike("[./]"))
    hit = alias_index(items, key, ident).join(sym, "alias").groupBy("symbol", key).agg(F.max(F.col("score") + F.col("own")).alias("score"))
    if scope is not None:
        ids = items.select(key, F.when(F.contains(F.lower(ident), F.lit(scope.lower())), 25).otherwise(0).alias("more"))
        hit = hit.join(ids, key).select("symbol", key, (F.col("score") + F.col("more")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("score"), key))
    return hit.withColumn("rank", rank).where("rank = 1").drop("rank")


def skill_candidates(skills: DataFrame, names: DataFrame, bonus: float = 0.25) -> DataFrame:
    """(skill, candidate, score): share of the skill's tokens that a name has, more in the same station; the best, even at 0."""
    s = skills.select("skill", F.col("station").alias("of"), tokens(F.col("skill")).alias("st"))
    n = names.select("candidate", "station", tokens(F.col("candidate")).alias("ct"))
    both = s.crossJoin(F.broadcast(n))
    share = F.size(F.array_intersect("st", "ct")) / F.greatest(F.size("st"), F.lit(1))
    score = F.round(share + F.when(F.col("of") == F.col("station"), bonus).otherwise(0.0), 4)
    rank = F.row_number().over(Window.partitionBy("skill").orderBy(F.desc("score"), "candidate"))
    return both.select("skill", "candidate", score.alias("score")).withColumn("rank", rank).where("rank = 1").drop("rank")
