"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides of at most this many bytes are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 8 << 20
#: Bytes of a batch that goes to a Python worker, about.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def thin(df: DataFrame) -> DataFrame:
    """`df`, after limiting the batches that Python workers get to `BATCH_BYTES`, if the session has no limit of its own."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, "67108864b") == "67108864b":
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def cut(df: DataFrame) -> DataFrame:
    """Compute `df` once, into the shared checkpoint folder, and end its lineage there."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As `cut`, but through a table in the shared folder, which goes when the driver ends.

    For loops: a checkpoint inherits the size estimates of its plan, and those multiply with every join.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        folder = sc.getCheckpointDir()
    path = f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.parquet(path)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if its counted `rows` take few bytes; otherwise the planner shuffles it."""
    wide = sum(96 if any(x in t for x in ("string", "binary", "array", "struct", "map")) else 8 for _, t in df.dtypes)
    return F.broadcast(df) if rows * (16 + wide) <= limit else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        own = f"_{name}"
        while own.lower() in taken:
            own = f"_{own}"
        taken.add(own.lower())
        out.append(own)
    return out


def col(df: DataFrame, name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the int64 offsets of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of `batches` of about `limit` bytes of text, of one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = strings(batch.column(column))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
            yield batch.slice(row, end - row)
            row = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix_int(x: int) -> int:
    m = (1 << 64) - 1
    x &= m
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
    return x ^ (x >> 31)


def unit(*keys: int | str | None) -> float:
    """A number in [0, 1) that depends on `keys` alone."""
    h = 0x9E3779B97F4A7C15
    for k in keys:
        if isinstance(k, str):
            k = int.from_bytes(k.encode("utf-8", "surrogatepass"), "little") % ((1 << 61) - 1) + len(k)
        h = mix_int(h ^ (0x1234567 if k is None else int(k)) * 0x9E3779B97F4A7C15 + 0x632BE5AB)
    return (h >> 11) / (1 << 53)


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each value of `key`, from batches in which equal values stand together."""
    held: list[pa.RecordBatch] = []
    last: object = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy(zero_copy_only=False)
        bounds = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(bounds[:-1], bounds[1:]):
            if held and values[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = values[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The concatenated ranges [start, start + length)."""
    total = int(length.sum())
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(start - ends + length, length)
