"""Hard negatives by segment summaries.

A vector is cut into segments; of each the mean and the deviation (the norm of what is left without the mean)
are stored, on a coarse and on a fine level. Within a segment of s components an inner product lies
within s times the product of the means, plus or minus the product of the deviations. So the coarse
summaries bound a score, the fine ones bound it closer for what is left, and only pairs that no bound
decides are scored exactly. Anchors keep the best scores so far, which tightens the bounds as rows pass.

Anchors are a stated query set: groups of bounded size stay in a task while a part of all rows streams past.
A first pass finds each anchor's positives among the rows of its label, a second one the negatives among all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapscan.llm.common import written

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Segments of the coarse and of the fine level.
LEVELS = (4, 16)
#: Rows that stream past a group of anchors in a task, and the bytes of a group's vectors.
ROWS_A_TASK, ANCHOR_BYTES = 8192, 32 << 20
#: Rows and anchors that are compared at once.
ROWS, ANCHORS = 2048, 512
#: Components up to here have inner products (up to 8192 of them) that doubles hold exactly.
PLAIN, PLAIN_DIM = 1 << 20, 1 << 13
#: Share of undecided pairs up to which they are looked at one by one.
FEW = 0.03
NONE = np.iinfo(np.int64).min
LIMITS = np.iinfo(np.int64)

ROW = "row bigint, vec_id bigint, label bigint, dim int, vector binary, summary binary"


def edges(dim: int, level: int) -> np.ndarray:
    """Where the segments of a level begin."""
    return np.unique(np.arange(level) * dim // level) if dim else np.zeros(0, np.int64)


def summaries(vectors: np.ndarray) -> np.ndarray:
    """Means and deviations of all segments of all levels, scaled so that a product of two rows is the bound's part."""
    n, dim = vectors.shape
    parts = []
    for level in LEVELS:
        first = edges(dim, level)
        if not len(first):
            continue
        size = np.diff(np.append(first, dim))
        with np.errstate(over="ignore", invalid="ignore"):
            means = np.add.reduceat(vectors, first, axis=1) / size
            rest = vectors - np.repeat(means, size, axis=1)
            # by the largest component first, so that squares neither vanish nor overflow
            largest = np.maximum.reduceat(np.abs(rest), first, axis=1)
            unit = rest / np.repeat(np.where(largest > 0, largest, 1), size, axis=1)
            parts += [means * np.sqrt(size), largest * np.sqrt(np.add.reduceat(unit * unit, first, axis=1))]
    return np.concatenate(parts, axis=1) if parts else np.zeros((n, 0))


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in ROW.split(", ")]
    for batch in batches:
        found: dict[int, tuple[list, list]] = {}
        lists = batch.column(3)
        for i in range(batch.num_rows):
            values = lists[i].values
            if values is None or values.null_count:
                continue
            x = values.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(x).all():
                at, vectors = found.setdefault(len(x), ([], []))
                at.append(i)
                with np.errstate(over="ignore"):
                    scaled = np.floor(x * SCALE)
                # components beyond all doubles are kept at the largest one: their scores are beyond 64 bits anyway
                vectors.append(np.clip(scaled, -1.7e308, 1.7e308))
        for dim, (at, vectors) in found.items():
            vectors = np.array(vectors).reshape(len(at), dim)
            rows = batch.take(pa.array(at))
            summary = summaries(vectors)
            columns = [rows.column(0), rows.column(1), rows.column(2), pa.array(np.full(len(at), dim), pa.int32())]
            columns += [pa.array([x.tobytes() for x in part], pa.binary()) for part in (vectors, summary)]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def stored(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """Rows that take part, numbered, with components floor(256 x) and their summaries."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    given = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"), F.col(embedding).alias("embedding"))
    given = given.where("vec_id is not null and label is not null and embedding is not null").withColumn("label", moved)
    rows = given.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "embedding")
    return written(rows.mapInArrow(_stored, ROW))


class Block:
    """Vectors of some rows with their summaries."""

    def __init__(self, dim: int, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: list[bytes], summary: list[bytes]):
        self.rows, self.ids, self.labels = rows, ids, labels
        self.vectors = np.frombuffer(b"".join(vectors), np.float64).reshape(len(rows), dim)
        summary = np.frombuffer(b"".join(summary), np.float64).reshape(len(rows), -1)
        self.levels, at = [], 0
        for level in LEVELS:
            n = len(edges(dim, level))
            self.levels.append((summary[:, at : at + n], summary[:, at + n : at + 2 * n]))
            at += 2 * n
        self.plain = dim <= PLAIN_DIM and bool((np.abs(self.vectors) <= PLAIN).all())

    def part(self, at: slice) -> Block:
        out = object.__new__(Block)
        out.rows, out.ids, out.labels, out.vectors = self.rows[at], self.ids[at], self.labels[at], self.vectors[at]
        out.levels = [(m[at], d[at]) for m, d in self.levels]
        out.plain = self.plain
        return out


def exact(a: Block, b: Block) -> np.ndarray:
    """Inner products of all rows of both; what is beyond 64 bits counts as the nearest 64-bit value."""
    if a.plain and b.plain:
        return (a.vectors @ b.vectors.T).astype(np.int64)
    as_whole = np.frompyfunc(int, 1, 1)
    x, y = as_whole(a.vectors).astype(object), as_whole(b.vectors).astype(object)
    out = np.zeros((len(x), len(y)), object) if x.shape[1] == 0 else x @ y.T
    return np.minimum(np.maximum(out, LIMITS.min + 1), LIMITS.max).astype(np.int64)


def scores(a: Block, b: Block, wanted) -> tuple[np.ndarray, np.ndarray]:
    """(scores, open): the exact scores of all pairs that no bound rules out.

    `wanted(lowest, highest, pairs)` tells which pairs a score between the two could matter for; pairs is None for all,
    else the (anchor, row) numbers that lowest and highest belong to.
    """
    open_ = wanted(None, None, None)
    if a.plain and b.plain:
        for (ma, da), (mb, db) in zip(a.levels, b.levels, strict=True):
            left = int(open_.sum())
            if not left:
                break
            if left > FEW * open_.size:
                middle, spread = ma @ mb.T, da @ db.T
                spread += 1e-9 * (np.abs(middle) + spread) + 1e-3  # what rounding can do
                open_ &= wanted(middle - spread, middle + spread, None)
            else:
                i, j = np.nonzero(open_)
                middle, spread = np.einsum("ij,ij->i", ma[i], mb[j]), np.einsum("ij,ij->i", da[i], db[j])
                spread += 1e-9 * (np.abs(middle) + spread) + 1e-3
                out = ~wanted(middle - spread, middle + spread, (i, j))
                open_[i[out], j[out]] = False
        left = int(open_.sum())
        if left <= FEW * open_.size:
            found = np.full(open_.shape, NONE, np.int64)
            i, j = np.nonzero(open_)
            found[i, j] = np.einsum("ij,ij->i", a.vectors[i], b.vectors[j]).astype(np.int64)
            return found, open_
    return exact(a, b), open_


def first_of(values: np.ndarray, keep: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the places of its k largest kept values, equal ones from the left, and which of them there are."""
    n = values.shape[1]
    k = min(k, n)
    values = np.where(keep, values, NONE)
    if np.abs(values[keep], dtype=np.float64).max(initial=0) < 1 << 50:
        # one number of value and place: no two are equal
        values = np.where(keep, values * ROWS + (ROWS - 1 - np.arange(n)), NONE)
        at = np.argpartition(values, n - k, axis=1)[:, n - k :]
        at = np.take_along_axis(at, np.argsort(-np.maximum(np.take_along_axis(values, at, 1), NONE + 1), axis=1, kind="stable"), 1)
    else:
        at = (n - 1 - np.argsort(values[:, ::-1], axis=1, kind="stable")[:, ::-1])[:, :k]
    return at, np.take_along_axis(keep, at, 1)


class Leaders:
    """The k highest scores of each anchor so far. Rows come by ascending id, so that of equal ones the earlier stays."""

    def __init__(self, n: int, k: int):
        self.scores = np.full((n, k), NONE, np.int64)
        self.ids, self.rows = np.zeros((n, k), np.int64), np.full((n, k), -1, np.int64)

    def least(self, at: slice) -> np.ndarray:
        """A score must be over this to come in."""
        return self.scores[at, -1]

    def add(self, at: slice, found: np.ndarray, keep: np.ndarray, block: Block) -> None:
        k = self.scores.shape[1]
        places, there = first_of(found, keep, k)
        if not there.any():
            return
        new = np.where(there, np.take_along_axis(found, places, 1), NONE)
        all_ = np.concatenate([self.scores[at], new], axis=1)
        ids = np.concatenate([self.ids[at], block.ids[places]], axis=1)
        rows = np.concatenate([self.rows[at], np.where(there, block.rows[places], -1)], axis=1)
        order = np.argsort(-np.maximum(all_, NONE + 1), axis=1, kind="stable")[:, :k]
        self.scores[at], self.ids[at], self.rows[at] = (np.take_along_axis(x, order, 1) for x in (all_, ids, rows))


def positives_among(anchors: Block, blocks: Iterator[Block]) -> Leaders:
    best = Leaders(len(anchors.rows), POSITIVES)
    for block in blocks:
        for start in range(0, len(anchors.rows), ANCHORS):
            at = slice(start, start + ANCHORS)
            mine = anchors.part(at)
            least = best.least(at)

            def wanted(low, high, pairs, least=least, mine=mine):
                if high is None:
                    return mine.rows[:, None] != block.rows[None]
                return high > (least[:, None] if pairs is None else least[pairs[0]])

            found, open_ = scores(mine, block, wanted)
            best.add(at, found, open_ & (found > least[:, None]), block)
    return best


def limits(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole scores from 50 to 95 hundredths of a positive's."""
    twentieths, rest = np.divmod(positive, 20)
    return -(-positive // 2), 19 * twentieths + 19 * rest // 20


def negatives_among(anchors: Block, positive: np.ndarray, known: np.ndarray, blocks: Iterator[Block]) -> list[Leaders]:
    """For each of the positives (scores by anchor and rank, where known) the highest fitting rows of other labels."""
    low, high = limits(positive)
    best = [Leaders(len(anchors.rows), NEGATIVES) for _ in range(positive.shape[1])]
    for block in blocks:
        for start in range(0, len(anchors.rows), ANCHORS):
            at = slice(start, start + ANCHORS)
            mine = anchors.part(at)
            # for each positive: whether there is one, what a score must reach, at most and at least, to come in
            needs = [(known[at, p], low[at, p], high[at, p], b.least(at)) for p, b in enumerate(best)]

            def fits(lowest, highest, need, pairs):
                there, floor, top, least = (x[:, None] if pairs is None else x[pairs[0]] for x in need)
                return there & (highest >= floor) & (lowest <= top) & (highest > least)

            def wanted(lowest, highest, pairs, mine=mine, needs=needs):
                if lowest is None:
                    return mine.labels[:, None] != block.labels[None]
                return np.logical_or.reduce([fits(lowest, highest, need, pairs) for need in needs])

            found, open_ = scores(mine, block, wanted)
            for need, b in zip(needs, best, strict=True):
                b.add(at, found, open_ & fits(found, found, need, None), block)
    return best


def _cells(spread: int, kernel):
    """Rows of a cell: its anchors first, then the others by ascending id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        stream = rows()
        row = next(stream, None)
        while row is not None:
            cell, dim = row[:spread], row[spread + 4]
            anchors = []
            while row is not None and row[:spread] == cell and row[spread] == 0:
                anchors.append(row[spread + 1 :])
                row = next(stream, None)

            def blocks():
                nonlocal row
                part = []
                while row is not None and row[:spread] == cell:
                    part.append(row[spread + 1 :])
                    row = next(stream, None)
                    if len(part) == ROWS:
                        yield as_block(dim, part)
                        part = []
                if part:
                    yield as_block(dim, part)

            rest = blocks()
            if anchors:
                yield from kernel(as_block(dim, anchors), anchors, rest)
            for _ in rest:
                pass

    return run


def as_block(dim: int, rows: list[tuple]) -> Block:
    """Of tuples (row, vec_id, label, dim, vector, summary, ...)."""
    columns = list(zip(*rows, strict=True))
    return Block(dim, *(np.array(columns[k], np.int64) for k in range(3)), columns[4], columns[5])


LED = "anchor_row bigint, anchor_id bigint, place int, other_row bigint, other_id bigint, score bigint"


def led(anchors: Block, best: list[Leaders]) -> Iterator[pa.RecordBatch]:
    for place, leaders in enumerate(best):
        i, k = np.nonzero(leaders.rows >= 0)
        columns = [anchors.rows[i], anchors.ids[i], np.full(len(i), place, np.int32), leaders.rows[i, k], leaders.ids[i, k], leaders.scores[i, k]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in LED.split(", ")])


def _positives(anchors: Block, rows: list[tuple], blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
    yield from led(anchors, [positives_among(anchors, blocks)])


def _negatives(anchors: Block, rows: list[tuple], blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
    positive, known = np.zeros((len(rows), POSITIVES), np.int64), np.zeros((len(rows), POSITIVES), bool)
    for i, row in enumerate(rows):
        positive[i, : len(row[6])], known[i, : len(row[6])] = row[6], True
    yield from led(anchors, negatives_among(anchors, positive, known, blocks))


def _dealt(rows: DataFrame, anchors: DataFrame, key: list[str], parts: int, groups: int) -> DataFrame:
    """Rows and anchors of equal key in cells: a part of the rows with a group of the anchors."""
    cell = [*key, "part", "group"]
    columns = [*cell, "kind", "row", "vec_id", "label" if "label" not in key else F.col("label").alias("own_label"), F.col("dim").alias("size"), "vector", "summary", "scores"]
    own = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    left = anchors.withColumns({"group": own(groups), "part": each(parts), "kind": F.lit(0)})
    right = rows.withColumns({"part": own(parts), "group": each(groups), "kind": F.lit(1), "scores": F.lit(None).cast("array<bigint>")})
    both = left.select(*columns).unionByName(right.select(*columns))
    return both.repartition(*cell).sortWithinPartitions(*cell, "kind", "vec_id", "row")


def mine(vectors: DataFrame, anchor_step: int = 50, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each anchor's positives.

    Components count as floor(256 x); a score is the whole inner product, and what is beyond 64 bits counts as the
    nearest 64-bit value. Anchors are the rows whose vec_id is divisible by `anchor_step`; positives the 5 highest
    other rows of the label, negatives the 3 highest rows of other labels from 50 to 95 hundredths of the positive's score.
    Equal scores go by smaller vec_id, then by row. Where vec_id is divisible by 7 the label is moved on first.
    Rows without id, label or vector, or with a component that is null or not finite, take no part; vectors of different
    lengths are not compared, empty ones score 0 with each other. Rows of equal id are rows of their own, so an anchor twice in the
    table is mined twice. An empty table gives no rows; other columns are ignored.
    """
    rows = stored(vectors, vec_id, embedding, label)
    anchors = rows.where(F.col("vec_id") % anchor_step == 0)
    n, dim = rows.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(0))).first()
    parts, groups = n // ROWS_A_TASK + 1, anchors.count() * 8 * dim // ANCHOR_BYTES + 1
    none = F.lit(None).cast("array<bigint>").alias("scores")
    found = _dealt(rows, anchors.select("*", none), ["label", "dim"], parts, groups).mapInArrow(_cells(4, _positives), LED)
    order = Window.partitionBy("anchor_row").orderBy(F.desc("score"), "other_id", "other_row")
    positives = written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= POSITIVES).drop("place"))
    lists = positives.groupBy("anchor_row").agg(F.expr("transform(array_sort(collect_list(struct(rank, score))), x -> x.score)").alias("scores"))
    asked = anchors.join(lists.withColumnRenamed("anchor_row", "row"), "row")
    found = _dealt(rows, asked, ["dim"], parts, groups).mapInArrow(_cells(3, _negatives), LED)
    order = Window.partitionBy("anchor_row", "place").orderBy(F.desc("score"), "other_id", "other_row")
    negatives = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES)
    of = positives.select("anchor_row", (F.col("rank") - 1).alias("place"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(of, ["anchor_row", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
