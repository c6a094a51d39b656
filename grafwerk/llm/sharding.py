"""Sharding by Karmarkar-Karp differencing.

Documents of one text are a group that no shard boundary may split. A group is a partial partition: its bytes
in one shard, nothing in the others. The two partial partitions of the largest spread are combined again and
again, the fullest shard of one with the emptiest of the other, until one is left. Buckets of groups are
combined side by side and each leaves one partial partition; those meet in a tree by the same rule.

Defined cases: a null text is a group of its own for each doc_id, of 0 bytes; empty texts are one group.
Repeated rows each keep their place and count their bytes; of groups of equal bytes the one met first counts. A text
of any length counts whole and is never split. A null doc_id with a text goes with its text. Columns other than
doc_id and text may have any names. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafwerk.llm.common import cut, small

SHARDS = 64
#: Groups that one task combines, and partial partitions that meet in one group of the tree.
LEAF, FAN = 20_000, 512


def combine(parts: Sequence[Sequence[int]], ids: Sequence[object]) -> tuple[list[int], list[list[tuple[object, int]]]]:
    """Difference partial partitions, given as sums by slot: the sums by final slot (descending), and the (id, slot) that went into each."""
    k = len(parts[0])
    heap: list[tuple[int, int, list[tuple[int, list]]]] = []
    for n, (sums, name) in enumerate(zip(parts, ids)):
        slots = sorted(((int(s), [(name, j)]) for j, s in enumerate(sums)), key=lambda x: -x[0])
        heap.append((slots[-1][0] - slots[0][0], n, slots))
    heapq.heapify(heap)
    tick = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        merged = []
        for i in range(k):
            (x, mine), (y, theirs) = a[i], b[k - 1 - i]
            if len(mine) < len(theirs):
                mine, theirs = theirs, mine
            mine.extend(theirs)
            merged.append((x + y, mine))
        merged.sort(key=lambda x: -x[0])
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], tick, merged))
        tick += 1
    final = heap[0][2]
    return [s for s, _ in final], [m for _, m in final]


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over whole groups: each group's slot, and the sums by slot."""
    # A lone group fills one slot; its empty slots carry no list.
    heap: list[tuple[int, int, list[int], list[list[int]]]] = [
        (-int(s), n, [int(s)] + [0] * (k - 1), [[n]] + [[] for _ in range(k - 1)]) for n, s in enumerate(sizes)
    ]
    heapq.heapify(heap)
    tick = len(heap)
    while len(heap) > 1:
        _, _, xs, ms = heapq.heappop(heap)
        _, _, ys, ns = heapq.heappop(heap)
        sums = [x + y for x, y in zip(xs, reversed(ys))]
        lists = []
        for mine, theirs in zip(ms, reversed(ns)):
            if len(mine) < len(theirs):
                mine, theirs = theirs, mine
            if theirs:
                mine.extend(theirs)
            lists.append(mine)
        order = sorted(range(k), key=sums.__getitem__, reverse=True)
        sums = [sums[i] for i in order]
        heapq.heappush(heap, (sums[-1] - sums[0], tick, sums, [lists[i] for i in order]))
        tick += 1
    slot = np.zeros(len(sizes), np.int32)
    if not heap:
        return slot, np.zeros(k, np.int64)
    for j, members in enumerate(heap[0][3]):
        slot[members] = j
    return slot, np.array(heap[0][2], np.int64)


def _leaf(k: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "group"], ascending=[False, True])
        slot, sums = difference(rows["bytes"].to_numpy(np.int64), k)
        out = pd.DataFrame({"bucket": int(key[0]), "group": rows["group"].to_numpy(), "slot": slot, "total": np.int64(0)})
        head = pd.DataFrame({"bucket": int(key[0]), "group": None, "slot": np.arange(k, dtype=np.int32), "total": sums})
        return pd.concat([out, head]).astype({"slot": "int32", "total": "int64", "bucket": "int64"})

    return run


def _merge(k: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot_table(index="node", columns="slot", values="total", fill_value=0).reindex(columns=range(k), fill_value=0).sort_index()
        sums, members = combine(wide.to_numpy().astype(np.int64).tolist(), wide.index.tolist())
        out = [(int(key[0]), int(node), int(slot), j, 0) for j, group in enumerate(members) for node, slot in group]
        out += [(int(key[0]), -1, j, j, int(s)) for j, s in enumerate(sums)]
        return pd.DataFrame(out, columns=["parent", "node", "slot", "to_slot", "total"]).astype({"slot": "int32", "to_slot": "int32"})

    return run


def shards(docs: DataFrame, k: int = SHARDS) -> DataFrame:
    """(doc_id, bytes, shard) for each row of `docs`."""
    key = F.when(F.col("text").isNull(), F.concat(F.lit("null "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).otherwise(F.md5("text"))
    rows = cut(docs.select("doc_id", key.alias("group"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")))
    groups = rows.groupBy("group").agg(F.sum("bytes").alias("bytes"))
    n = rows.agg(F.approx_count_distinct("group")).first()[0]
    buckets = max(1, math.ceil(n / LEAF))
    leaf = cut(
        groups.withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(buckets)))
        .groupBy("bucket")
        .applyInPandas(_leaf(k), "bucket long, group string, slot int, total long")
    )
    level = leaf.where("group IS NULL").select(F.col("bucket").alias("node"), "slot", "total")
    # place: where each bucket's slots stand in the tree so far.
    place = level.select(F.col("node").alias("bucket"), "slot", "node", F.col("slot").alias("at"))
    width = buckets
    while width > 1:
        width = math.ceil(width / FAN)
        step = cut(
            level.withColumn("parent", F.floor(F.col("node") / F.lit(FAN)).cast("long"))
            .groupBy("parent")
            .applyInPandas(_merge(k), "parent long, node long, slot int, to_slot int, total long")
        )
        moves = step.where("node >= 0").select("node", F.col("slot").alias("at"), "parent", "to_slot")
        place = cut(place.join(moves, ["node", "at"]).select("bucket", "slot", F.col("parent").alias("node"), F.col("to_slot").alias("at")))
        level = step.where("node = -1").select(F.col("parent").alias("node"), "slot", "total")
    ends = place.select("bucket", "slot", F.col("at").alias("shard"))
    given = leaf.where("group IS NOT NULL").join(small(ends, buckets * k), ["bucket", "slot"]).select("group", "shard")
    return rows.join(given, "group").select("doc_id", "bytes", "shard")
