"""What the operators share: text buffers, words, hashes, written tables, components."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that numpy code works on at once (a longer text is worked on alone).
PIECE_BYTES = 2 << 20

try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # a C library without it
    _TRIM = None

BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: digits, small letters, all of non-ASCII characters.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True


#: Rows that Spark hands to Python at once, unless the session says otherwise than Spark's own default; a batch of long texts is large.
BATCH_ROWS = 1000


def known_to_workers(spark: SparkSession) -> None:
    """Lets Python workers that see this folder import the package from it; elsewhere it is sent with --py-files. Keeps Arrow batches small."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if home not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([home, *filter(None, paths)])


def shared_folder(spark: SparkSession) -> str:
    """A new name in the folder that the cluster shares; only a session without one (as in tests) gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        base = tempfile.mkdtemp(prefix="run-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(base, f"llm-{uuid.uuid4().hex}")


def written(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder: work is not repeated and survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `written` that nothing reads any more, and lets Spark drop the shuffle files of finished work."""
    jvm = tables[0].sparkSession._jvm
    conf = tables[0].sparkSession._jsc.hadoopConfiguration()
    for table in tables:
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
    jvm.System.gc()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and n + 1 offsets; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    kind = np.dtype(np.int64 if wide else np.int32)
    _, places, data = column.buffers()
    if n == 0 or places is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(places, kind, n + 1, column.offset * kind.itemsize).astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8, offsets[-1] - offsets[0], offsets[0]), offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of at most `rows` rows whose texts have about `limit` bytes; texts are never cut. Memory goes back at the end."""
    _, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = min(at + rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1))
        yield batch.slice(at, to - at)
        at = to
    release(every=8)


_RELEASED = 0


def release(every: int = 1) -> None:
    """Gives what numpy and Arrow have freed back to the system, at every so many calls; workers live on for other work."""
    global _RELEASED
    _RELEASED += 1
    if _RELEASED % every:
        return
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)
    if len(_POWERS[0]) > PIECE_BYTES + 1:  # a very long text made them long
        _POWERS[:] = [x[: PIECE_BYTES + 1].copy() for x in _POWERS]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task, after which its worker holds as little as before: what it has freed, and the powers, go back to the system."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        forget_powers()
        release()

    return task


def forget_powers() -> None:
    _POWERS[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse, i < n, modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = max(n, PIECE_BYTES + 1)
        inverse = pow(BASE, -1, 1 << 64)
        for k, base in enumerate((BASE, inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums of a polynomial hash; see `range_hashes`."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up, out=out[1:])
    return out


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end], equal for equal contents."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


class Words:
    """Words of texts: starts and ends in bytes, hashes, and the words of text i at first[i]:first[i + 1]."""

    def __init__(self, column: pa.Array):
        raw, self.offsets = buffers(column)
        self.data = LOWER[raw]
        inside = WORD_BYTE[self.data]
        n = len(raw)
        before = np.zeros(n + 1, bool)
        before[1:] = inside
        before[self.offsets] = False
        starts = inside & ~before[:n]
        after = np.zeros(n + 1, bool)
        after[:n] = inside
        after[self.offsets] = False
        ends = inside & ~after[1:]
        self.starts = np.flatnonzero(starts)
        self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.hashes = range_hashes(prefix_hashes(self.data), self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def sequence_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of `size` values; as many as there are whole runs."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(BASE) + hashes[k : k + n]
    return mix(out)


#: Edges that one task contracts at once.
EDGES_A_TASK = 200_000


@tidy
def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition as stars: each node with the smallest one that it reaches by them."""
    parent: dict[int, int] = {}

    def root(a: int) -> int:
        while parent.setdefault(a, a) != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = [n for n in parent if root(n) != n]
    for at in range(0, len(nodes), 50_000):
        part = nodes[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([root(n) for n in part], pa.int64()), pa.array(part, pa.int64())], names=["lo", "hi"])


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) of all nodes on `edges`: the smallest node that is reachable.

    Each round contracts parts of EDGES_A_TASK edges to stars, in parallel, and, as long as there is
    more than one part, alternates large and small stars over all of them: an aggregate of minima, combined
    before its shuffle, and a join back, so no list of neighbours is built. Rounds are written tables.
    Converges in a logarithmic number of rounds.
    """
    pairs = edges.select(F.least(left, right).cast("bigint").alias("lo"), F.greatest(left, right).cast("bigint").alias("hi")).where("lo < hi")
    pairs = written(pairs.distinct())
    state = None
    while True:
        n = pairs.count()
        parts = max(1, -(-n // EDGES_A_TASK))
        pairs = pairs.repartition(parts).mapInArrow(_contract, "lo bigint, hi bigint")
        if parts == 1:
            pairs = written(pairs)
            break
        pairs = written(pairs.distinct())
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = written(large.where("lo < hi").distinct())
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("lo < hi")
        pairs = written(small.union(low.select("hi", F.col("m").alias("lo"))).select("lo", "hi").distinct())
        row = pairs.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")), F.sum("lo")).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    nodes = pairs.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component"))
    return nodes.union(pairs.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
