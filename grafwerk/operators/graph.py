"""Operators on triples: patterns, closures, type inference, changes of the graph."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafwerk.model import SUBCLASS, TYPE, as_set, iri, local_name

#: A side of at most this many bytes is broadcast; a larger one is left to the planner.
BROADCAST_BYTES = 8 << 20


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared checkpoint folder and read it from there: its lineage ends.

    Unlike a checkpoint, a table doesn't inherit size estimates, which multiply with every join of a loop.
    The table goes when the driver ends.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = f"{_folder(df)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).deleteOnExit(where)
    return spark.read.parquet(path)


def _folder(df: DataFrame) -> str:
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def small(df: DataFrame, rows: int) -> DataFrame:
    """`df` with a broadcast hint if its counted `rows` take few bytes."""
    wide = sum(8 if t in ("bigint", "int", "double", "boolean", "timestamp") else 96 for _, t in df.dtypes)
    return F.broadcast(df) if rows * (16 + wide) <= BROADCAST_BYTES else df


def match(graph: DataFrame, s: str | None = None, p: str | Sequence[str] | None = None, o: str | None = None, literal: bool = False) -> DataFrame:
    """The triples of a pattern. Several predicates are alternatives; `literal` tells what kind of object `o` is."""
    out = graph
    if s is not None:
        out = out.where(F.col("s") == iri(s))
    if p is not None:
        out = out.where(F.col("p") == iri(p)) if isinstance(p, str) else out.where(F.col("p").isin([iri(x) for x in p]))
    if o is not None:
        out = out.where((F.col("o") == (o if literal else iri(o))) & (F.col("o_kind") == ("literal" if literal else "iri")))
    return out


def pairs(graph: DataFrame, p: str | Sequence[str], s: str, o: str) -> DataFrame:
    """Subjects and objects of a predicate as columns of the given names."""
    return match(graph, p=p).select(F.col("s").alias(s), F.col("o").alias(o))


def instances(graph: DataFrame, cls: str, s: str) -> DataFrame:
    return match(graph, p=TYPE, o=cls).select(F.col("s").alias(s))


def first_object(graph: DataFrame, p: str, s: str, o: str) -> DataFrame:
    """One object for each subject: the smallest, where the predicate has several."""
    return match(graph, p=p).groupBy(F.col("s").alias(s)).agg(F.min("o").alias(o))


def names(graph: DataFrame, preds: Sequence[str]) -> DataFrame:
    """(s, name) of every subject: its first non-empty name predicate in the given order, or its IRI's local name."""
    rank = F.lit(None).cast("int")
    for k, p in reversed(list(enumerate(preds))):
        rank = F.when((F.col("p") == iri(p)) & (F.trim("o") != ""), k).otherwise(rank)
    best = graph.withColumn("rank", rank).groupBy("s").agg(F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", "o"))).alias("b"))
    return best.select("s", F.coalesce("b.o", local_name(F.col("s"))).alias("name"))


#: Steps of a closure that one round takes.
STEPS = 4

#: Edges of at most this many bytes, by estimate, go to every task of a closure as a whole; more are joined in rounds.
EDGE_BYTES = 64 << 20

#: Pairs of a product that one task writes, about.
PAIRS = 50_000_000


def closure(edges: DataFrame, seeds: DataFrame | None = None, reflexive: bool = True) -> DataFrame:
    """(src, dst) of all nodes that each seed reaches over `edges` (src, dst), however far; cycles are fine.

    Pairs may be many more than edges. Where the edges fit into a task, each seed is followed in one, and its pairs go
    straight on. Otherwise one strong component is made a single node before the search, as all its nodes reach the
    same, and the pairs that it stands for are told at the end, as products. Neither shuffles nor stores them.
    """
    edges = cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    start = (edges.select("src") if seeds is None else seeds.select("src")).distinct()
    wide = sum(8 if t in ("bigint", "int") else 96 for _, t in edges.dtypes)
    if edges.count() * wide <= EDGE_BYTES:
        return _followed(edges, cut(start), reflexive)
    found = _ring(edges)
    if found is None:
        reached = _search(edges, start)
        return reached if reflexive else _proper(reached, edges)
    ring, rep = found
    one = F.lit(rep)

    def folded(df: DataFrame, c: str) -> DataFrame:
        inside = ring.select(F.col("node").alias(c), F.lit(True).alias(f"{c}_in"))
        return df.join(inside, c, "left").withColumn(c, F.when(F.col(f"{c}_in"), one).otherwise(F.col(c)))

    rest = folded(folded(edges, "src"), "dst").where("src_in IS NULL OR dst_in IS NULL").select("src", "dst").distinct()
    rest, start = cut(rest), cut(start)
    node = ring.select(F.col("node").alias("src"))
    inside = start.join(node, "src", "left_semi")
    own = start.join(node, "src", "left_anti")
    reached = cut(_search(rest, own.unionByName(ring.sparkSession.range(1).select(one.cast(dict(start.dtypes)["src"]).alias("src")))))
    of_ring, to_ring = F.col("src").eqNullSafe(one), F.col("dst").eqNullSafe(one)
    single = reached.where(~of_ring & ~to_ring)
    whole = _product(inside.unionByName(reached.where(~of_ring & to_ring).select("src")), ring.select(F.col("node").alias("dst")))
    below = _product(inside, reached.where(of_ring & ~to_ring).select("dst"))
    if reflexive:
        return single.unionByName(whole).unionByName(below)
    # Every node of the component is on a cycle.
    return _proper(single, rest).unionByName(whole).unionByName(below)


def _followed(edges: DataFrame, start: DataFrame, reflexive: bool) -> DataFrame:
    """(src, dst) of a closure of few edges: nodes are numbers, and their edges lists in every task."""
    table = edges.toArrow()
    ends = pa.chunked_array([*table["src"].chunks, *table["dst"].chunks], table["src"].type).combine_chunks().dictionary_encode()
    if isinstance(ends, pa.ChunkedArray):
        ends = ends.combine_chunks()
    ids, nodes = ends.indices.to_numpy(zero_copy_only=False), ends.dictionary
    src, dst = ids[: len(table)], ids[len(table) :]
    first = np.zeros(len(nodes) + 1, np.int64)
    np.cumsum(np.bincount(src, minlength=len(nodes)), out=first[1:])
    spark = edges.sparkSession
    held = spark.sparkContext.broadcast((nodes, first, dst[np.argsort(src, kind="stable")]))

    def follow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, first, to = held.value
        owner = np.zeros(len(nodes), np.int64)
        for batch in batches:
            seeds = batch.column(0)
            at = pc.index_in(seeds, nodes).to_pylist()
            for k, node in enumerate(at):
                seen = np.zeros(len(nodes), bool)
                ahead = np.array([] if node is None else [node], np.int64)
                while len(ahead):
                    n = first[ahead + 1] - first[ahead]
                    ahead = to[np.repeat(first[ahead] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                    ahead = ahead[~seen[ahead]]
                    owner[ahead] = np.arange(len(ahead))
                    ahead = ahead[owner[ahead] == np.arange(len(ahead))]
                    seen[ahead] = True
                if reflexive and node is not None:
                    seen[node] = True
                met = np.flatnonzero(seen)
                for i in range(0, len(met), 1 << 18):
                    some = nodes.take(pa.array(met[i : i + (1 << 18)]))
                    yield pa.RecordBatch.from_arrays([seeds.take(pa.array(np.full(len(some), k))), some], ["src", "dst"])
            if reflexive:  # those without an edge
                lone = seeds.filter(pa.array([node is None for node in at], pa.bool_()))
                yield pa.RecordBatch.from_arrays([lone, lone], ["src", "dst"])

    n = start.count()
    tasks = max(1, min(n, max(spark.sparkContext.defaultParallelism, -(-n * len(nodes) // PAIRS))))
    kind = dict(edges.dtypes)
    return start.repartition(tasks).mapInArrow(follow, f"src {dict(start.dtypes)['src']}, dst {kind['dst']}")


def _search(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(src, dst) of all that each node of `start` (src) reaches, itself included.

    Breadth-first, `STEPS` steps a round: only what the last step of a round met newly goes on, and the search ends
    when that is nothing. Each round is cut off in the shared folder, so that neither plan nor lineage grows.
    """
    hop = edges.withColumnsRenamed({"src": "mid", "dst": "next"})
    reached = cut(start.select("src", F.col("src").alias("dst")))
    frontier, parts = reached, 1
    while True:
        met = None
        for k in range(1, STEPS + 1):
            frontier = frontier.join(hop, F.col("dst") == F.col("mid")).select("src", F.col("next").alias("dst")).distinct()
            step = frontier.withColumn("step", F.lit(k))
            met = step if met is None else met.unionByName(step)
        new = met.groupBy("src", "dst").agg(F.min("step").alias("step"))
        new = cut(new.join(reached, ["src", "dst"], "left_anti"))
        # Rounds are disjoint by construction, so that a plain union is the set of all.
        reached = reached.unionByName(new.select("src", "dst"))
        frontier = new.where(F.col("step") == STEPS).select("src", "dst")
        if frontier.isEmpty():
            return reached
        parts += 1
        if parts % 8 == 0:
            reached = cut(reached)


def _proper(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """`reached` with a node's pair with itself only where a cycle leads back to it."""
    hop = edges.withColumnsRenamed({"src": "mid", "dst": "next"})
    loops = reached.join(hop, F.col("dst") == F.col("mid")).where("src = next").select("src", F.col("src").alias("dst")).distinct()
    return reached.where("src <> dst").unionByName(loops)


def _ring(edges: DataFrame) -> tuple[DataFrame, object] | None:
    """The strong component (node) of the node with most ways through it, and that node; None if it is alone."""
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i"))
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o"))
    best = into.join(out, "node").orderBy(F.desc(F.col("i") * F.col("o")), "node").first()
    if best is None:
        return None
    rep = best["node"]
    start = edges.sparkSession.range(1).select(F.lit(rep).cast(dict(edges.dtypes)["src"]).alias("src"))
    ahead = cut(_search(edges, start).select(F.col("dst").alias("node")))
    back = edges.join(ahead.select(F.col("node").alias("src")), "src", "left_semi")
    if back.where((F.col("dst") == rep) & (F.col("src") != rep)).isEmpty():
        return None
    back = cut(back.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return cut(_search(back, start).select(F.col("dst").alias("node"))), rep


def _product(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of two columns, spread over tasks by how many they are."""
    n, m = left.count(), right.count()
    tasks = max(left.sparkSession.sparkContext.defaultParallelism, -(-n * m // PAIRS))
    if n <= m:
        return right.repartition(tasks).crossJoin(small(left, n)).select("src", "dst")
    return left.repartition(tasks).crossJoin(small(right, m)).select("src", "dst")


#: Triples that one task of an inference takes.
TRIPLES_EACH = 100_000


def infer_types(graph: DataFrame, subclasses: DataFrame | None = None) -> DataFrame:
    """The graph with the types that follow from its subclass edges and the given (src, dst) ones.

    Triples are parted by subject, so many as a task can hold the types of, and gain types where they then are.
    """
    edges = match(graph, p=SUBCLASS).select(F.col("s").alias("src"), F.col("o").alias("dst"))
    if subclasses is not None:
        edges = edges.unionByName(subclasses.select("src", "dst"))
    supers = cut(closure(edges))
    wider = supers.groupBy(F.col("src").alias("cls")).agg(F.collect_list("dst").alias("wider"))
    parted = graph.repartition(max(1, -(-graph.count() // TRIPLES_EACH)), "s")
    both = parted.join(small(wider, supers.count()), (F.col("p") == TYPE) & (F.col("o") == F.col("cls")), "left")
    own = F.array("o")
    each = F.explode(F.when(F.col("wider").isNull(), own).otherwise(F.concat(own, "wider"))).alias("o")
    return as_set(both.select("s", "p", each, "o_kind", "o_dtype", "o_lang"))


def schema_card(graph: DataFrame, top: int = 15, products: dict[str, tuple[DataFrame, DataFrame]] | None = None) -> DataFrame:
    """(kind, term, n): the most frequent classes and predicates; of equal counts the smaller term.

    `products` has further triples by predicate, as (dst, via) of subjects and (via, var) of objects: all of a group
    meet. They are counted by group, not built. A predicate is not `rdf:type` there.
    """
    # One pass counts both: the classes apart, by their term, and the types among the predicates as their sum.
    is_type = F.col("p") == TYPE
    counted = graph.groupBy("p", F.when(is_type, F.col("o")).alias("cls")).agg(F.count("*").alias("n"))
    for p, (members, of) in (products or {}).items():
        left = members.groupBy("via").agg(F.count("*").alias("l"))
        right = of.groupBy("via").agg(F.count("*").alias("r"))
        counted = counted.unionByName(left.join(right, "via").select(F.lit(iri(p)).alias("p"), F.lit(None).cast("string").alias("cls"), (F.col("l") * F.col("r")).alias("n")))
    # Few rows: classes and predicates.
    counted = cut(counted)
    classes = counted.where(F.col("p") == TYPE).select(F.col("cls").alias("term"), "n", F.lit("class").alias("kind"))
    preds = counted.groupBy(F.col("p").alias("term")).agg(F.sum("n").alias("n")).withColumn("kind", F.lit("predicate"))
    best = [d.orderBy(F.desc("n"), "term").limit(top) for d in (classes, preds)]
    return best[0].unionByName(best[1]).select("kind", "term", "n")


def search_terms(graph: DataFrame, text: str, limit: int = 30) -> DataFrame:
    """The first triples, by (s, p, o), of which a term contains `text` in any case."""
    needle = F.lit(text.lower())
    hit = F.lit(False)
    for c in ("s", "p", "o"):
        hit = hit | F.contains(F.lower(c), needle)
    return graph.where(hit).select("s", "p", "o").orderBy("s", "p", "o").limit(limit)


def remove_nodes(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """The graph without triples from or to `nodes` (s)."""
    gone = cut(nodes.select(F.col("s").alias("gone")).distinct())
    kept = graph.join(gone, F.col("s") == F.col("gone"), "left_anti")
    return kept.join(gone, F.col("o") == F.col("gone"), "left_anti")


def upsert(graph: DataFrame, new: DataFrame) -> DataFrame:
    """The graph with each (s, p) of `new` replaced by its triples there."""
    keys = new.select(F.col("s").alias("ns"), F.col("p").alias("np")).distinct()
    kept = graph.join(keys, (graph["s"] == F.col("ns")) & (graph["p"] == F.col("np")), "left_anti")
    return as_set(kept.unionByName(new))


def overlap(a: str, b: str) -> Column:
    """Jaccard similarity of two array columns of distinct values; of two empty ones 0."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(F.array_union(a, b))
    return F.when(all_ > 0, both / all_).otherwise(0.0)


def signatures(graph: DataFrame, products: tuple[DataFrame, DataFrame] | None = None, sizes: bool = False) -> DataFrame:
    """(pou, reachable, called, vars, hw, ports) of each POU, as sorted arrays of names, or with `sizes` their lengths.

    `products` has further variables that POUs use, as (dst, via) of POUs and (via, var) of variables: all of a group
    meet. POUs that reach the same groups have the same variables, which are listed once.
    """
    calls = pairs(graph, "op:containsPOUCall", "pou", "call").join(pairs(graph, "op:callsPOU", "call", "callee"), "call").select("pou", "callee").distinct()
    calls = cut(calls)
    pous = cut(pairs(graph, ["dp:hasPOUName", "dp:hasProgramName"], "pou", "name").groupBy("pou").agg(F.min("name").alias("name")))
    reach = cut(closure(calls.select(F.col("pou").alias("src"), F.col("callee").alias("dst")), pous.select(F.col("pou").alias("src"))).withColumnRenamed("src", "pou"))

    def listed(rows: DataFrame, value: str, as_: str, by: str = "pou") -> DataFrame:
        rows = rows.where(F.col(by).isNotNull() & F.col(value).isNotNull()).select(by, value)
        if sizes:
            return rows.distinct().groupBy(by).agg(F.count("*").cast("int").alias(as_))
        return rows.groupBy(by).agg(F.sort_array(F.collect_set(value)).alias(as_))

    name_of = pous.withColumnsRenamed({"pou": "dst", "name": "dst_name"})
    reached = reach.join(name_of, "dst")
    # A POU's own variables are a group of its own.
    own = pairs(graph, ["op:hasInternalVariable", "op:usesVariable"], "dst", "var").select("dst", F.concat(F.lit("="), "dst").alias("via"), "var")
    members, of = own.select("dst", "via").distinct(), own.select("via", "var")
    if products is not None:
        shared = [d.withColumn("via", F.concat(F.lit("+"), F.col("via"))) for d in products]
        members, of = members.unionByName(shared[0].select("dst", "via")), of.unionByName(shared[1].select("via", "var"))
    sets = cut(reach.join(members, "dst").groupBy("pou").agg(F.sort_array(F.collect_set("via")).alias("vias")))
    lists = cut(sets.groupBy("vias").agg(F.min("pou").alias("list")))
    listed_of = sets.join(lists, "vias").select("pou", "list")
    used = lists.select("list", F.explode("vias").alias("via")).join(of, "via").select("list", "var").distinct()
    var_name = pairs(graph, "dp:hasVariableName", "var", "var_name")
    hw = pairs(graph, "dp:hasHardwareAddress", "var", "address")
    port = pairs(graph, "op:hasPort", "pou", "port").join(pairs(graph, "dp:hasPortName", "port", "port_name"), "port")
    called = calls.join(name_of, calls["callee"] == name_of["dst"]).select("pou", "dst_name")
    out = pous
    for part in (
        listed(reached, "dst_name", "reachable"),
        listed(called, "dst_name", "called"),
        listed_of.join(listed(used.join(var_name, "var"), "var_name", "vars", "list"), "list").drop("list"),
        listed_of.join(listed(used.join(hw, "var"), "address", "hw", "list"), "list").drop("list"),
        listed(port, "port_name", "ports"),
    ):
        out = out.join(part, "pou", "left")
    empty = F.lit(0) if sizes else F.array().cast("array<string>")
    return out.select("pou", "name", *(F.coalesce(c, empty).alias(c) for c in ("reachable", "called", "vars", "hw", "ports")))


def _tagged(c: str) -> Column:
    return F.transform(c, lambda x: F.concat(F.lit(c), F.lit(":"), x))


def similar(sigs: DataFrame, probe: DataFrame, k: int) -> DataFrame:
    """(probe, name, score, rank): the `k` most similar signatures, 0.55 by hardware, 0.25 by variables, 0.20 by calls; a probe finds itself too.

    Only signatures that share a member with the probe can score above zero: those are found by an equi-join on
    members, and the rest fill up by name if there are fewer than `k`.
    """
    key = ["name"]
    member = F.explode(F.concat(*(_tagged(c) for c in ("hw", "vars", "called"))))
    left = probe.select(F.col("name").alias("probe"), member.alias("m"))
    right = sigs.select("name", member.alias("m"))
    cand = left.join(right, "m").select("probe", "name").distinct()
    fill = sigs.select("name").orderBy("name").limit(k)
    cand = cand.unionByName(probe.select(F.col("name").alias("probe")).crossJoin(F.broadcast(fill))).distinct()
    p = probe.select(F.col("name").alias("probe"), *(F.col(c).alias(f"p_{c}") for c in ("hw", "vars", "called")))
    both = cand.join(p, "probe").join(sigs.select("name", "hw", "vars", "called"), key)
    score = F.round(0.55 * overlap("p_hw", "hw") + 0.25 * overlap("p_vars", "vars") + 0.20 * overlap("p_called", "called"), 4)
    ranked = both.select("probe", "name", score.alias("score"))
    rank = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "name"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= k)
