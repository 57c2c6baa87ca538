"""Near-duplicate documents by ProbMinHash.

A text is a multiset of five-word shingles, weighted by how often they occur. Every
shingle emits a Poisson process of arrivals at a rate of its weight; each arrival
falls on one of M components, which keep the shingle that came first. A process ends as soon as
its next arrival is later than all components' first ones. Two texts agree in a component with the
probability Jaccard similarity of their weights.

Equal texts are collapsed first. Bands of components bring candidates together: within a
bucket all members are compared with two representatives, not with each other, and
only members that are still in different components afterwards, and whose signatures
are close enough, are compared directly. Every comparison is exact, on whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapscan.llm.common import PIECE_BYTES, Words, components, mix, pieces, sequence_hashes, tidy, written

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
M = BANDS * ROWS
#: A pair at SIMILARITY has fewer equal components than this with a chance under 1 in 10,000.
CLOSE = int(M * SIMILARITY - 3.8 * (M * SIMILARITY * (1 - SIMILARITY)) ** 0.5)
#: Pairs that share a representative in one task.
PAIRS_A_TASK = 5000

#: Shingles whose arrivals are drawn at once, and texts that are signed at once.
SHINGLES, TEXTS = 16_384, 2048
#: Members of a bucket that a task compares at once.
BLOCK = 1024
#: What the collision of short hashes can do to a similarity; pairs near the threshold are compared by their texts.
MARGIN = 0.005

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the different shingles of each text; a shorter text is one shingle."""
    counts = np.diff(words.first)
    runs = sequence_hashes(words.hashes, size)
    place = np.arange(len(words.hashes))
    owner = np.repeat(np.arange(len(counts)), counts)
    whole = place + size <= words.first[owner + 1] if len(owner) else np.zeros(0, bool)
    hashes, texts = [runs[place[whole]]], [owner[whole]]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        own = words.hashes[words.first[i] : words.first[i + 1]]
        hashes.append(sequence_hashes(own, len(own)) ^ np.uint64(len(own)))
        texts.append(np.array([i]))
    hashes, texts = np.concatenate(hashes), np.concatenate(texts)
    _, one, n = np.unique(mix(hashes ^ mix(texts.astype(np.uint64) * GOLDEN)), return_index=True, return_counts=True)
    return texts[one], hashes[one], n


def signatures(texts: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_texts: int) -> np.ndarray:
    """M components for each text: 16 bits of the shingle that arrived first; texts without shingles have zeros.

    Shingles are taken in blocks, so that memory does not grow with their number; a later block meets the arrivals of earlier ones.
    """
    times = np.full(n_texts * M, np.inf)
    out = np.zeros(n_texts * M, np.uint16)
    for start in range(0, len(texts), SHINGLES):
        at = slice(start, start + SHINGLES)
        _arrive(times.reshape(n_texts, M), out, texts[at], hashes[at], weights[at])
    return out.reshape(n_texts, M)


def _arrive(times: np.ndarray, out: np.ndarray, texts: np.ndarray, hashes: np.ndarray, weights: np.ndarray) -> None:
    """Arrivals of some shingles, until each one's next is later than all of its text's first ones."""
    clock = np.zeros(len(texts))
    alive, drawn, block = np.arange(len(texts)), 0, 1
    low = int(texts.min(initial=0))
    mine = times[low : int(texts.max(initial=0)) + 1]  # of the texts that these shingles belong to
    flat = times.reshape(-1)
    while len(alive):
        steps = (np.arange(drawn, drawn + block, dtype=np.uint64) + np.uint64(1)) * GOLDEN
        seeds = mix(hashes[alive, None] + steps)
        gaps = -np.log(((seeds >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53)
        arrivals = clock[alive, None] + np.cumsum(gaps, axis=1) / weights[alive, None]
        clock[alive] = arrivals[:, -1]
        last = mine.max(axis=1)
        row, column = np.nonzero(arrivals < last[texts[alive] - low, None])
        when, who = arrivals[row, column], alive[row]
        at = texts[who] * M + (mix(seeds[row, column] ^ GOLDEN) % np.uint64(M)).astype(np.int64)
        np.minimum.at(flat, at, when)
        first = flat[at] == when
        out[at[first]] = (hashes[who[first]] >> np.uint64(48)).astype(np.uint16)
        last = mine.max(axis=1)
        drawn += block
        alive = alive[clock[alive] < last[texts[alive] - low]]
        block = min(64, 2 * block) if drawn > 1 else 1


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact similarity of two multisets, each (sorted hashes, counts)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    if a[1].max() == b[1].max() == 1:  # of sets it is the plain one
        place = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
        shared = int((a[0][place] == b[0]).sum())
        return shared / (len(a[0]) + len(b[0]) - shared)
    keys = np.union1d(a[0], b[0])
    x, y = np.zeros(len(keys)), np.zeros(len(keys))
    x[np.searchsorted(keys, a[0])] = a[1]
    y[np.searchsorted(keys, b[0])] = b[1]
    both = (x > 0) & (y > 0)
    if not both.any():
        return 0.0
    # for a shingle with ratio r, those with a ratio of r or more count by x, the others by y
    ratio = np.where(y > 0, x / np.maximum(y, 1), np.inf)
    order = np.argsort(ratio)
    sorted_ratio = ratio[order]
    y_before = np.concatenate([[0], np.cumsum(y[order])])
    x_from = np.concatenate([np.cumsum(x[order][::-1])[::-1], [0]])
    at = np.searchsorted(sorted_ratio, ratio[both], "left")
    return float((1 / (x_from[at] / x[both] + y_before[at] / y[both])).sum())


@tidy
def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "digest", "signature"]
    for batch in batches:
        for part in pieces(batch, "text", PIECE_BYTES // 2, TEXTS):
            words = Words(part.column(1))
            texts, hashes, weights = shingles(words)
            order = np.argsort(texts, kind="stable")
            texts, hashes, weights = texts[order], hashes[order], weights[order]
            found = signatures(texts, hashes, weights, part.num_rows)
            some = np.diff(words.first) > 0
            signs = [x.tobytes() if s else None for x, s in zip(found, some, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(signs, pa.binary())], names=names)


def digest(text: str) -> Column:
    """128 bits that stand for a text; null for null."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, signature) of each row; no signature where there are no words."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", digest("text").alias("digest")).mapInArrow(
        _sign, "doc_id bigint, digest binary, signature binary"
    )


@tidy
def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group, a group's own text first; that one's shingles stay while others pass."""
    key, own = None, None
    for batch in batches:
        for part in pieces(batch, "text", PIECE_BYTES // 2):
            keys, others = part.column(0).to_pylist(), part.column(2).to_pylist()
            texts, hashes, counts = shingles(Words(part.column(3)))
            order = np.lexsort((hashes, texts))
            texts, hashes, counts = texts[order], hashes[order], counts[order]
            first = np.searchsorted(texts, np.arange(part.num_rows + 1))
            a, b, similarity = [], [], []
            for i, other in enumerate(others):
                mine = hashes[first[i] : first[i + 1]], counts[first[i] : first[i + 1]]
                if other is None:
                    key, own = keys[i], mine
                elif keys[i] == key:
                    value = probability_jaccard(own, mine)
                    if value >= SIMILARITY - 1e-12:
                        a.append(key)
                        b.append(other)
                        similarity.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(similarity, pa.float64())], names=["a", "b", "similarity"]
            )


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of (id, text) whose similarity is high enough. A text that many pairs share is sent once to each of their tasks."""
    sizes = pairs.groupBy("a").agg(F.expr(f"count(*) div {PAIRS_A_TASK} + 1").alias("salts"))
    others = pairs.join(sizes, "a").withColumn("salt", F.pmod(F.xxhash64("b"), "salts"))
    right = others.join(texts, others["b"] == texts["id"]).select("a", "salt", "b", "text")
    left = sizes.join(texts, sizes["a"] == texts["id"]).select(
        "a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("bigint").alias("b"), "text"
    )
    rows = left.unionByName(right).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_compare, "a bigint, b bigint, similarity double")


def _band_rows(signs: DataFrame) -> DataFrame:
    bands = F.array(*[F.xxhash64(F.lit(k), F.expr(f"substring(signature, {2 * ROWS * k + 1}, {2 * ROWS})")) for k in range(BANDS)])
    return signs.select("id", F.posexplode(bands).alias("band", "bucket"))


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of a bucket in blocks: each block's own (kind 0), then those of the blocks before it (kind 1)."""
    sizes = rows.groupBy("bucket").agg(F.expr(f"count(*) div {BLOCK} + 1").alias("blocks"))
    placed = rows.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    later = placed.where("block + 1 < blocks").withColumn("block", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)))
    both = placed.withColumn("kind", F.lit(0)).unionByName(later.withColumn("kind", F.lit(1))).drop("blocks")
    return both.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "kind", "id")


class _Block:
    """Members of a bucket that are compared with each other if they are in different components.

    Without shingles it finds the members that are close to some other; with them, pairs that are
    similar and whose components are still apart here.
    """

    def __init__(self, rows: list[tuple]):
        self.mine = self.arrays(rows)
        self.close: set[int] = set()
        self.pairs: list[tuple[int, int]] = []
        self.parent: dict[int, int] = {}
        self.compare(*self.mine, np.arange(len(rows)))

    @staticmethod
    def arrays(rows: list[tuple]) -> tuple:
        ids, components_, bands, signs, sketches = zip(*rows, strict=True)
        return np.array(ids), np.array(components_), bands[0], np.array([np.frombuffer(x, np.uint16) for x in signs]), [_counted(x) for x in sketches]

    def root(self, a: int) -> int:
        while self.parent.setdefault(a, a) != a:
            self.parent[a] = self.parent[self.parent[a]]
            a = self.parent[a]
        return a

    def compare(self, ids, components_, band, signs, sketches, places=None) -> None:
        own_ids, own_components, _, own_signs, own_sketches = self.mine
        for at in range(0, len(ids), 32):
            equal = signs[at : at + 32, None, :] == own_signs[None]
            q, k = np.nonzero(equal.sum(axis=2, dtype=np.int16) >= CLOSE)
            keep = components_[at + q] != own_components[k]
            if places is not None:
                keep &= places[at + q] < k
            q, k = q[keep], k[keep]
            # a pair counts in the first band that it shares
            keep = equal[q, k].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
            for i, j in zip((at + q[keep]).tolist(), k[keep].tolist(), strict=True):
                if sketches[i] is None:
                    self.close |= {int(ids[i]), int(own_ids[j])}
                    continue
                x, y = self.root(int(components_[i])), self.root(int(own_components[j]))
                if x != y:
                    similarity = probability_jaccard(sketches[i], own_sketches[j])
                    if similarity >= SIMILARITY - MARGIN:
                        self.pairs.append((int(ids[i]), int(own_ids[j])))
                    if similarity >= SIMILARITY + MARGIN:
                        self.parent[max(x, y)] = min(x, y)


def _counted(sketch: bytes | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Different hashes and their counts of a sketch, which lists its shingles sorted."""
    return None if sketch is None else np.unique(np.frombuffer(sketch, np.uint32), return_counts=True)


@tidy
def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, id, null) for close members, or (bucket, id, id) for similar pairs."""
    key, rows, block, waiting = None, [], None, []

    def ask() -> None:
        if waiting:
            block.compare(*_Block.arrays(waiting))
            waiting.clear()

    def result() -> pa.RecordBatch:
        nonlocal block, rows
        if block is None:
            block = _Block(rows)
        ask()
        found = [(i, None) for i in sorted(block.close)] + block.pairs
        out = [[key[0]] * len(found), [a for a, _ in found], [b for _, b in found]]
        block, rows = None, []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["bucket", "a", "b"])

    for batch in batches:
        for bucket, part, kind, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (bucket, part) != key:
                if rows:
                    yield result()
                key, rows, block = (bucket, part), [], None
                waiting.clear()
            if kind == 0:
                rows.append(tuple(row))
            elif rows:
                if block is None:
                    block = _Block(rows)
                waiting.append(tuple(row))
                if len(waiting) >= BLOCK:
                    ask()
    if rows:
        yield result()


APART = "bucket bigint, a bigint, b bigint"


@tidy
def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All shingles of each text, repeated ones too, as sorted 32-bit hashes."""
    for batch in batches:
        for part in pieces(batch, "text", PIECE_BYTES // 2):
            texts, hashes, counts = shingles(Words(part.column(1)))
            small = (hashes >> np.uint64(32)).astype(np.uint32)
            order = np.lexsort((small, texts))
            texts, small = np.repeat(texts[order], counts[order]), np.repeat(small[order], counts[order])
            first = np.searchsorted(texts, np.arange(part.num_rows + 1))
            found = pa.array([small[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), found], names=["id", "sketch"])


def near_duplicates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, links): (doc_id, class_id, digest, class_digest) of each row of docs, and the verified pairs (a, b, similarity).

    class_id is the smallest doc_id that is reachable by links of similarity 0.8 or more; class_digest tells which
    text of that id it is, the one with the smallest digest. Equal texts are one class, also empty and wordless ones,
    which are like nothing else. Each null text is a class of its own. Texts of fewer than five words are one shingle. Rows with one doc_id are one document
    if their texts are equal, else each text is a document. A null doc_id has a null
    class. A text is compared whole, in one task, which takes about 50 bytes of memory for each of its bytes. Links connect the smallest ids of groups of equal texts. An empty table gives no rows; other columns are ignored.
    """
    signs = written(signed(docs))
    # ids below number the different texts in the order of their smallest doc_id, since a doc_id can have several texts
    equal = signs.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature"))
    equal = written(equal.repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest").withColumn("id", F.monotonically_increasing_id()))
    rows = _band_rows(equal.where("signature is not null"))
    buckets = rows.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    buckets = written(rows.join(buckets, "bucket"))
    stars = buckets.select(F.col("low").alias("a"), F.col("id").alias("b")).union(buckets.select(F.col("high").alias("a"), F.col("id").alias("b")))
    # a member that both ends of its bucket share many bands with is still compared with each once
    stars = written(stars.where("a <> b").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "a").groupBy("x", "y").agg(F.min("a").alias("a")))
    stars = stars.select("a", (F.col("x") + F.col("y") - F.col("a")).alias("b"))
    # the texts that can be compared, once; their ids have no bound, so they are merged at every size
    members = equal.join(buckets.select("id").distinct(), "id", "left_semi").select("doc_id", "digest", "id").hint("merge")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", digest("text").alias("digest"))
    texts = written(texts.join(members, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"]).select("id", "text"))
    links = written(verified(stars, texts))
    # members of one bucket that are in different components still
    known = written(components(links))
    placed = buckets.select("bucket", "band", "id").join(known.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    apart = placed.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("bucket")
    columns = ["bucket", "block", "kind", "id", "component", "band", "signature", "sketch"]
    opened = placed.join(apart, "bucket").join(equal.select("id", "signature"), "id").withColumn("sketch", F.lit(None).cast("binary"))
    opened = written(opened)
    close = written(_dealt(opened).select(*columns).mapInArrow(_apart, APART).select("bucket", F.col("a").alias("id")).distinct())
    wanted = texts.join(close.select("id").distinct(), "id")
    sketches = wanted.mapInArrow(_sketch, "id bigint, sketch binary").dropDuplicates(["id"])
    near = opened.drop("sketch").join(close, ["bucket", "id"]).join(sketches, "id")
    similar = _dealt(near).select(*columns).mapInArrow(_apart, APART)
    similar = written(similar.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    more = written(verified(similar, texts))
    if not more.isEmpty():
        links = links.unionByName(more)
        # the new links join components, not documents
        inner = known.withColumnRenamed("node", "a").withColumnRenamed("component", "x")
        outer = known.withColumnRenamed("node", "b").withColumnRenamed("component", "y")
        between = more.join(inner, "a", "left").join(outer, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
        joined = components(between).select(F.col("node").alias("component"), F.col("component").alias("final"))
        ends = more.select(F.col("a").alias("node")).union(more.select(F.col("b").alias("node"))).distinct()
        nodes = known.unionByName(ends.join(known, "node", "left_anti").withColumn("component", F.col("node")))
        known = nodes.join(joined, "component", "left").select("node", F.coalesce("final", "component").alias("component"))
    first = equal.select(F.col("id").alias("component"), F.col("doc_id").alias("class_id"), F.col("digest").alias("class_digest"))
    first = known.where("node <> component").join(first, "component").select(F.col("node").alias("id"), "class_id", "class_digest")
    described = equal.join(first, "id", "left").select(
        "digest", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_digest", "digest").alias("class_digest")
    )
    named = F.col("doc_id").isNotNull()
    classes = signs.select("doc_id", "digest").join(described, "digest", "left").select(
        "doc_id", F.when(named, F.coalesce("class_id", "doc_id")).alias("class_id"),
        "digest", F.when(named, F.coalesce("class_digest", "digest")).alias("class_digest"),
    )
    a, b = (equal.select(F.col("id").alias(k), F.col("doc_id").alias(f"{k}_id")) for k in "ab")
    return classes, links.join(a, "a").join(b, "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "similarity")


def is_kept(classes: DataFrame) -> Column:
    """Whether a row is the document that its class is named after; null for a null doc_id."""
    same = (classes["doc_id"] == classes["class_id"]) & classes["digest"].eqNullSafe(classes["class_digest"])
    return F.when(classes["doc_id"].isNotNull(), same)
