"""Near-duplicate vectors by product quantisation.

Coarse lists and residual codebooks are fitted on a bounded sample; every vector is then
put into the list of its nearest centroid as codes of its residual. As a query it is also compared with all
lists whose border is within half the radius: of two linked vectors in different lists one is that near to the
border between them, so no link is lost. Distances of queries to coded vectors come from
lookup tables, and the codes' own known errors turn them into upper bounds of the cosine, so that
nothing is lost here either; what can reach the threshold is compared exactly in double precision.

Equal vectors are collapsed with their count first. Small lists of a label share a block and a large one is cut
into blocks; a query goes to a block once, however many of its lists it probes, and only as its vector. Many queries
pass a block one batch at a time; it gives counts of links and the edges that
connect its members, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapscan.llm.common import components, written

COSINE = 0.93
RADIUS = math.sqrt(2 - 2 * COSINE)
#: A list is probed if the query is this near to the border between it and its own list. A smaller bound loses links.
BORDER = RADIUS / 2
#: The bounded sample for centroids and codebooks.
SAMPLE = 20_000
MOST_LISTS, CODES, PART = 1024, 256, 8
ROUNDS = 8
#: Coded vectors in a block.
BLOCK = 1024


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float32)
    for _ in range(rounds):
        nearest = np.concatenate(
            [(part @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1) for part in np.array_split(x, -(-len(x) // 4096))]
        )
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros(centres.shape, np.float64)
        np.add.at(sums, nearest, x)
        some = counts > 0
        centres[some] = (sums[some] / counts[some, None]).astype(np.float32)
    return centres


class Quantiser:
    """Centroids of the lists and codebooks of residuals, for vectors of one length."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.dim = sample.shape[1]
        self.parts = -(-self.dim // PART)
        self.centres = kmeans(sample, lists)
        residuals = self.widened(sample - self.centres[self.nearest(sample)])
        self.books = [kmeans(np.ascontiguousarray(residuals[:, PART * m : PART * (m + 1)]), CODES, seed=m) for m in range(self.parts)]

    def widened(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), PART * self.parts), np.float64)
        out[:, : self.dim] = x
        return out

    def closeness(self, x: np.ndarray) -> np.ndarray:
        return x @ self.centres.T.astype(np.float64) - (self.centres.astype(np.float64) ** 2).sum(axis=1) / 2

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return self.closeness(x).argmax(axis=1)

    def probes(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each vector's own list, and the others whose border is near."""
        near = self.closeness(x)
        own = near.argmax(axis=1)
        c = self.centres.astype(np.float64)
        squares = (c**2).sum(axis=1)
        apart = np.sqrt(np.maximum(squares[own][:, None] + squares[None, :] - 2 * c[own] @ c.T, 1e-30))
        # not divided by `apart`, which rounding spoils for centroids that all but coincide
        beyond = near[np.arange(len(x)), own][:, None] - near - BORDER * apart
        beyond[np.arange(len(x)), own] = np.inf
        return own, [np.flatnonzero(row <= 1e-7) for row in beyond]

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, the length of what they miss, and its product with the vector itself."""
        residuals = self.widened(x - self.centres[own])
        codes = np.empty((len(x), self.parts), np.uint8)
        missed = residuals.copy()
        for m, book in enumerate(self.books):
            part = residuals[:, PART * m : PART * (m + 1)]
            codes[:, m] = (part @ book.T - (book.astype(np.float64) ** 2).sum(axis=1) / 2).argmax(axis=1)
            missed[:, PART * m : PART * (m + 1)] -= book[codes[:, m]]
        return codes, np.sqrt((missed**2).sum(axis=1)), (missed * self.widened(x)).sum(axis=1)

    def tables(self, x: np.ndarray) -> np.ndarray:
        """Products of the queries' parts with all codes: (query, part, code)."""
        wide = self.widened(x)
        out = np.zeros((len(x), self.parts, CODES))
        for m, book in enumerate(self.books):
            out[:, m, : len(book)] = wide[:, PART * m : PART * (m + 1)] @ book.T
        return out


INDEX = "size int, label string, list int, id bigint, n bigint, vector binary, codes binary, missed double, own double, probes array<int>"


def _packed(raw: np.ndarray) -> list[bytes]:
    """Each vector as floats where they are exact, else as doubles."""
    with np.errstate(over="ignore"):
        small = raw.astype(np.float32)
    return [(f if same else d).tobytes() for d, f, same in zip(raw, small, (small == raw).all(axis=1), strict=True)]


def of_length_one(x: np.ndarray) -> np.ndarray:
    """Vectors without a zero one, of length 1. A power of two brings their largest components near 1 first, so no square vanishes or overflows."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])
    return x / np.sqrt((x**2).sum(axis=1))[:, None]


def _units(packed: list[bytes], dim: int) -> np.ndarray:
    """Vectors of `_packed`, of length 1."""
    return of_length_one(np.array([np.frombuffer(v, np.float32 if len(v) == 4 * dim else np.float64) for v in packed], np.float64).reshape(len(packed), dim))


def _assign(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in INDEX.split(", ")]
        kinds = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.list_(pa.int32())]
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                size, label, ids, n, vectors = (batch.column(k).to_pylist() for k in range(5))
                for dim in sorted(set(size)):
                    rows = [i for i, d in enumerate(size) if d == dim]
                    packed = _packed(np.array([vectors[i] for i in rows], np.float64))
                    x = _units(packed, dim)
                    q: Quantiser = sent.value[dim]
                    own, probes = q.probes(x)
                    codes, missed, product = q.encode(x, own)
                    columns = [
                        [dim] * len(rows), [label[i] for i in rows], own, [ids[i] for i in rows], [n[i] for i in rows],
                        packed, [c.tobytes() for c in codes], missed, product, [p.astype(np.int32) for p in probes],
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


PLACES = "size int, label string, starts array<int>, ends array<int>"


def _number(most: int):
    """Lists of a label with their counts -> the first and the last block of each list, by its number; null for lists without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = [], []
            for cells in batch.column(2).to_pylist():
                first, last, small, large = [None] * (cells[-1]["list"] + 1), [None] * (cells[-1]["list"] + 1), 0, 0
                for cell in cells:
                    k, n = cell["list"], cell["n"]
                    if n < most // 2:  # shares a block, numbered downwards from -1
                        first[k] = last[k] = -1 - small // (most // 2)
                        small += n
                    else:
                        first[k], large = large, large + n // most + 1
                        last[k] = large - 1
                starts.append(first)
                ends.append(last)
            kinds = [pa.list_(pa.int32())] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, (starts, ends), kinds)], names=[x.split()[0] for x in PLACES.split(", ")])

    return run


class _Block:
    """Coded vectors of one block of lists of one label, and what has been found about them."""

    def __init__(self, dim: int, number: int, q: Quantiser):
        self.dim, self.number, self.q = dim, number, q
        self.rows: list[tuple] = []
        self.parent: dict[int, int] = {}
        self.links: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def close(self) -> None:
        self.ids = np.array([r[0] for r in self.rows], np.int64)
        self.n = np.array([r[1] for r in self.rows], np.int64)
        self.x = _units([r[2] for r in self.rows], self.dim)
        self.codes = np.array([np.frombuffer(r[3], np.uint8) for r in self.rows]).reshape(len(self.rows), self.q.parts)
        self.missed, self.own = np.array([r[4] for r in self.rows]), np.array([r[5] for r in self.rows])
        self.centres = self.q.centres[[r[6] for r in self.rows]].astype(np.float64).reshape(len(self.rows), self.dim)
        self.sent = [set(r[7]) for r in self.rows]
        places = np.arange(len(self.rows))
        self.compare(self.ids, self.n, self.x, np.full(len(places), self.number), places)

    def root(self, a: int) -> int:
        while self.parent.setdefault(a, a) != a:
            self.parent[a] = self.parent[self.parent[a]]
            a = self.parent[a]
        return a

    def compare(self, ids, n, x, came, places=None) -> None:
        """Queries, and the blocks they came from, against the block; `places`: the block with itself, each pair once."""
        for at in range(0, len(ids), 256):
            part = slice(at, at + 256)
            tables = self.q.tables(x[part])
            estimate = x[part] @ self.centres.T + self.own[None, :]
            for m in range(self.q.parts):
                estimate += tables[:, m, :][:, self.codes[:, m]]
            # the code's error against the query is that against the vector itself, which is known, plus at most RADIUS x its length
            q, k = np.nonzero(estimate + RADIUS * self.missed[None, :] >= COSINE - 1e-5)
            if places is not None:
                keep = places[part][q] < k
                q, k = q[keep], k[keep]
            for cut in range(0, len(q), 1 << 15):
                a, b = q[cut : cut + (1 << 15)] + at, k[cut : cut + (1 << 15)]
                linked = np.einsum("ij,ij->i", x[a], self.x[b]) >= COSINE
                self.found(ids, n, came, a[linked], b[linked])

    def found(self, ids, n, came, a, b) -> None:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            # a pair that both blocks see counts in the one with the smaller number
            number = int(came[i])
            if number < self.number and number in self.sent[j]:
                continue
            u, v = int(ids[i]), int(self.ids[j])
            self.links[u] = self.links.get(u, 0) + int(self.n[j])
            self.links[v] = self.links.get(v, 0) + int(n[i])
            r, s = self.root(u), self.root(v)
            if r != s:
                self.parent[max(r, s)] = min(r, s)
                self.edges.append((u, v))

    def result(self) -> pa.RecordBatch:
        ids = [*self.links, *(u for u, _ in self.edges)]
        other = [*[None] * len(self.links), *(v for _, v in self.edges)]
        count = [*self.links.values(), *[0] * len(self.edges)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(other, pa.int64()), pa.array(count, pa.int64())], names=["id", "other", "links"])


def _search(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, waiting = None, None, []

        def ask() -> None:
            if waiting:
                columns = list(zip(*waiting, strict=True))
                block.compare(np.array(columns[0], np.int64), np.array(columns[1], np.int64), _units(columns[2], block.dim), np.array(columns[3]))
                waiting.clear()

        for batch in batches:
            for dim, label, number, kind, *row, came in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (dim, label, number) != key:
                    if block is not None:
                        if not hasattr(block, "ids"):
                            block.close()
                        ask()
                        yield block.result()
                    key, block = (dim, label, number), _Block(dim, number, sent.value[dim])
                if kind == 0:
                    block.rows.append(row)
                else:
                    if not hasattr(block, "ids"):
                        block.close()
                    waiting.append((row[0], row[1], row[2], came))
                    if len(waiting) >= BLOCK:
                        ask()
        if block is not None:
            if not hasattr(block, "ids"):
                block.close()
            ask()
            yield block.result()

    return run


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of `vectors`.

    Vectors link if their labels (and lengths) are equal and their cosine is 0.93 or more. Null
    vectors or labels, zero vectors, and those with null or non-finite components link with nothing. Equal vectors all link. Rows
    with one vec_id are one vector for components; an empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    given = vectors.select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("string").alias("label"),
        F.col(embedding).cast("array<double>").alias("v"),
    )
    usable = "label is not null and size(v) > 0 and forall(v, x -> x is not null and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    given = given.withColumn("usable", F.coalesce(F.expr(usable), F.lit(False)))
    classes = written(
        given.where("usable").groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).withColumn("size", F.size("v"))
    )
    sizes = [(r[0], r[1]) for r in classes.groupBy("size").count().orderBy("size").collect()]  # a row a vector length
    quantisers = {}
    for dim, n in sizes:
        rows = classes.where(F.col("size") == dim).orderBy(F.xxhash64("id", "label"), "id").limit(SAMPLE).select("v").collect()
        sample = of_length_one(np.array([r[0] for r in rows], np.float64))
        quantisers[dim] = Quantiser(sample, max(1, min(MOST_LISTS, round(math.sqrt(n)), len(sample) // 8)))
    sent = spark.sparkContext.broadcast(quantisers)
    index = written(classes.select("size", "label", "id", "n", "v").mapInArrow(_assign(sent), INDEX))
    cells = index.groupBy("size", "label", "list").agg(F.count("*").alias("n"))
    cells = cells.groupBy("size", "label").agg(F.sort_array(F.collect_list(F.struct("list", "n"))).alias("cells"))  # MOST_LISTS at most
    placed = index.join(cells.mapInArrow(_number(BLOCK), PLACES), ["size", "label"])
    placed = placed.withColumn("block", F.expr("starts[list] + cast(pmod(xxhash64(id), ends[list] - starts[list] + 1) as int)"))
    # queries go to the blocks of their own list after their own, and to all of the lists that they probe
    later = "if(block < ends[list], sequence(block + 1, ends[list]), cast(array() as array<int>))"
    others = "flatten(transform(filter(probes, p -> get(starts, p) is not null), p -> sequence(starts[p], ends[p])))"
    placed = placed.withColumn("sent", F.expr(f"array_except(concat({others}, {later}), array(block))")).drop("starts", "ends", "probes")
    columns = ["size", "label", "block", "kind", "id", "n", "vector", "codes", "missed", "own", "list", "sent", "came"]
    coded = placed.withColumn("kind", F.lit(0)).withColumn("came", F.col("block")).select(*columns)
    queries = placed.select(
        "size", "label", F.explode("sent").alias("to"), F.lit(1).alias("kind"), "id", "n", "vector", F.lit(None).cast("binary").alias("codes"),
        F.lit(None).cast("double").alias("missed"), F.lit(None).cast("double").alias("own"), F.lit(None).cast("int").alias("list"),
        F.lit(None).cast("array<int>").alias("sent"), F.col("block").alias("came"),
    ).withColumnRenamed("to", "block").select(*columns)
    dealt = coded.unionByName(queries).repartition("size", "label", "block").sortWithinPartitions("size", "label", "block", "kind")
    found = written(dealt.mapInArrow(_search(sent), "id bigint, other bigint, links bigint"))
    edges = found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))
    known = components(edges).select(F.col("node").alias("id"), "component")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    described = classes.select("label", "v", "id", "n").join(links, "id", "left").join(known, "id", "left").select(
        "label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "id").alias("component")
    )
    return given.join(described, ["label", "v"], "left").select(
        "vec_id",
        F.when(F.col("usable"), F.coalesce("links", F.lit(0))).otherwise(0).cast("bigint").alias("n_links"),
        F.when(F.col("usable"), F.coalesce("component", "vec_id")).otherwise(F.col("vec_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id") == F.col("component_id"))
