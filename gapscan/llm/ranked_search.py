"""Ranked lexical search over an index that is stratified by document length.

A document's length enters its scores only through the normaliser m, a whole number. Documents with
equal m form a stratum. Within one, a posting's impact depends on its term frequency alone, so
postings lie by term and frequency and each frequency's impact is computed once. The largest impact of
each query term bounds what a stratum can score; a query visits strata from the highest bound down and stops
where no bound reaches its tenth score.

One pass counts terms; strata are dealt to tasks by their postings, a large one in parts. Queries
are taken in blocks of bounded size, each broadcast by itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType

from gapscan.llm.common import PIECE_BYTES, WORD_BYTE, LOWER, Words, buffers, pieces, written

TOP = 10
#: Bytes of query text in a broadcast block.
BLOCK_BYTES = 2 << 20
#: Postings, and documents, that a task holds as an index at once.
SEGMENT_POSTINGS, SEGMENT_DOCS = 2_000_000, 1 << 16
#: Postings and documents that one task of the search is dealt, and postings of a stratum that stay together.
POSTINGS_A_TASK, DOCS_A_TASK, POSTINGS_A_PART = 1_000_000, 20_000, 200_000

COUNTED = "doc_id bigint, n bigint, terms array<int>, counts array<bigint>"


class Vocabulary:
    """Different terms, found by hash and confirmed byte by byte."""

    def __init__(self, terms: list[bytes]):
        words = Words(pa.array(terms, pa.binary()))
        order = np.argsort(words.hashes, kind="stable")
        self.keys, self.ids = words.hashes[order], order.astype(np.int64)
        self.data = words.data
        self.starts, self.lengths = words.starts, words.ends - words.starts
        self.size = len(terms)

    def find(self, words: Words) -> np.ndarray:
        """The number of each word's term, -1 for words that are none."""
        out = np.full(len(words.hashes), -1, np.int64)
        if not self.size:
            return out
        low = np.searchsorted(self.keys, words.hashes)
        open_ = np.flatnonzero(low < self.size)
        open_ = open_[self.keys[low[open_]] == words.hashes[open_]]
        place = low[open_]
        while len(open_):
            ids = self.ids[place]
            same = self.equal(words, open_, ids)
            out[open_[same]] = ids[same]
            # another term may have the same hash
            open_, place = open_[~same], place[~same] + 1
            more = place < self.size
            more[more] = self.keys[place[more]] == words.hashes[open_[more]]
            open_, place = open_[more], place[more]
        return out

    def equal(self, words: Words, at: np.ndarray, ids: np.ndarray) -> np.ndarray:
        lengths = words.ends[at] - words.starts[at]
        same = lengths == self.lengths[ids]
        at, ids, lengths = at[same], ids[same], lengths[same]
        if len(at):
            first = np.cumsum(lengths) - lengths
            step = np.arange(lengths.sum())
            ours = words.data[np.repeat(words.starts[at] - first, lengths) + step]
            theirs = self.data[np.repeat(self.starts[ids] - first, lengths) + step]
            same[same] = np.logical_and.reduceat(ours == theirs, first)
        return same


def stretches(data: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[np.ndarray]:
    """A long text in parts of about `limit` bytes that end between words; only a longer word makes a longer part."""
    at = 0
    while at < len(data):
        to = min(len(data), at + limit)
        while to < len(data):
            breaks = np.flatnonzero(~WORD_BYTE[LOWER[data[to : to + limit]]])
            if len(breaks):
                to += int(breaks[0])
                break
            to = min(len(data), to + limit)
        yield data[at:to]
        at = to


def _count(sent):
    def counted(ids: pa.Array, n: np.ndarray, first: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        places = pa.array(first, pa.int32())
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(n, pa.int64()), pa.ListArray.from_arrays(places, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(places, pa.array(counts, pa.int64()))],
            names=["doc_id", "n", "terms", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: Vocabulary = sent.value
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES // 2):
                data, _ = buffers(part.column(1))
                if part.num_rows == 1 and len(data) > 2 * PIECE_BYTES:
                    n, total = 0, np.zeros(vocabulary.size, np.int64)
                    for stretch in stretches(data):
                        words = Words(pa.array([stretch.tobytes()], pa.binary()))
                        found = vocabulary.find(words)
                        n += len(found)
                        total += np.bincount(found[found >= 0], minlength=vocabulary.size)
                    terms = np.flatnonzero(total)
                    yield counted(part.column(0), np.array([n]), np.array([0, len(terms)]), terms, total[terms])
                    continue
                words = Words(part.column(1))
                found = vocabulary.find(words)
                of = np.diff(words.first)
                hit = found >= 0
                keys, counts = np.unique(np.repeat(np.arange(part.num_rows), of)[hit] * max(1, vocabulary.size) + found[hit], return_counts=True)
                texts, terms = np.divmod(keys, max(1, vocabulary.size))
                yield counted(part.column(0), of, np.searchsorted(texts, np.arange(part.num_rows + 1)), terms, counts)

    return run


@dataclass
class Queries:
    """The items of a block: each one's different terms with their counts, and all terms' weights."""

    items: list
    first: np.ndarray
    terms: np.ndarray
    repeats: np.ndarray
    weights: np.ndarray


def normaliser_of(documents: int, terms: int) -> str:
    """SQL of a document's normaliser from its number of terms n."""
    return f"25 + (cast({75 * documents} as decimal(38,0)) * n) div {terms}"


class Stratum:
    """Documents of one normaliser: postings by term and frequency, with their impacts."""

    def __init__(self, m: int, first: np.ndarray, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray):
        self.n = len(first) - 1
        owner = np.repeat(np.arange(self.n), np.diff(first))
        order = np.lexsort((counts, terms))
        self.docs, terms, counts = owner[order], terms[order], counts[order]
        frequency, which = np.unique(counts, return_inverse=True)
        impact = 1_000_000_000 * frequency // (1000 * frequency + 8 * m)
        self.values = weights[terms] * impact[which]
        self.terms = np.unique(terms)
        self.first = np.append(np.searchsorted(terms, self.terms), len(terms))
        self.best = self.values[self.first[1:] - 1]  # the highest frequency stands last

    def places(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the terms' postings are, and which terms have some."""
        at = np.searchsorted(self.terms, terms)
        known = at < len(self.terms)
        known[known] = self.terms[at[known]] == terms[known]
        return at, known

    def bounds(self, queries: Queries) -> np.ndarray:
        """The most that a document can score, for each query."""
        at, known = self.places(queries.terms)
        most = np.zeros(len(at) + 1, np.int64)
        most[:-1][known] = self.best[at[known]] * queries.repeats[known]
        sums = np.concatenate([[0], np.cumsum(most)])
        return sums[queries.first[1:]] - sums[queries.first[:-1]]

    def scores(self, terms: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n, np.int64)
        at, known = self.places(terms)
        for k, times in zip(at[known].tolist(), repeats[known].tolist(), strict=True):
            a, b = self.first[k], self.first[k + 1]
            out[self.docs[a:b]] += times * self.values[a:b]
        return out


class Best:
    """The highest scores of a query so far; equal ones by id, a missing id last."""

    def __init__(self):
        self.scores, self.missing, self.ids = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """What a document needs at least to come in."""
        return int(self.scores[-1]) if len(self.scores) == TOP else 1

    def add(self, scores: np.ndarray, missing: np.ndarray, ids: np.ndarray) -> None:
        keep = np.flatnonzero(scores >= self.least)
        if len(keep) > 4 * TOP:  # only what can still be among the first
            cut = np.partition(scores[keep], len(keep) - TOP)[len(keep) - TOP]
            keep = keep[scores[keep] >= cut]
        if len(keep):
            scores, missing, ids = (np.concatenate([a, b[keep]]) for a, b in ((self.scores, scores), (self.missing, missing), (self.ids, ids)))
            order = np.lexsort((ids, missing, -scores))[:TOP]
            self.scores, self.missing, self.ids = scores[order], missing[order], ids[order]


def _search(sent, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by m."""
        queries: Queries = sent.value
        best = [Best() for _ in queries.items]
        waiting: list[pa.RecordBatch] = []
        docs = postings = 0

        def visit() -> None:
            table = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            ids, m, terms, counts = (table.column(k).chunk(0) for k in range(4))
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            ids, m = ids.fill_null(0).to_numpy(), m.to_numpy()
            places = terms.offsets.to_numpy().astype(np.int64)
            terms, counts = terms.values.to_numpy(), counts.values.to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(m[1:] != m[:-1]) + 1, [len(m)]])
            strata = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                p, q = places[a], places[b]
                strata.append((a, b, Stratum(int(m[a]), places[a : b + 1] - p, terms[p:q], counts[p:q], queries.weights)))
            bounds = np.array([s.bounds(queries) for _, _, s in strata])
            for k, found in enumerate(best):
                mine = slice(queries.first[k], queries.first[k + 1])
                for s in np.argsort(-bounds[:, k], kind="stable").tolist():
                    if bounds[s, k] < found.least:
                        break
                    a, b, stratum = strata[s]
                    found.add(stratum.scores(queries.terms[mine], queries.repeats[mine]), missing[a:b], ids[a:b])

        for batch in batches:
            waiting.append(batch)
            docs += batch.num_rows
            postings += len(batch.column(2).flatten())
            if docs >= SEGMENT_DOCS or postings >= SEGMENT_POSTINGS:
                visit()
                docs = postings = 0
        if docs:
            visit()
        number = [k for k, b in enumerate(best) for _ in range(len(b.ids))]
        if number:
            ids = pa.array(np.concatenate([b.ids for b in best]), mask=np.concatenate([b.missing for b in best]))
            scores = pa.array(np.concatenate([b.scores for b in best]))
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array([queries.items[k] for k in number], kind), ids, scores], names=["number", "item_id", "doc_id", "score"])

    return run


def _block(docs: DataFrame, block: list, kind) -> DataFrame:
    """(number, item_id, rank, doc_id, score) of a block of items."""
    spark = docs.sparkSession
    words = Words(pa.array([row[1] for row in block], pa.string()))
    spelled = [words.word(i) for i in range(len(words.hashes))]
    terms = sorted(set(spelled))
    number = {term: k for k, term in enumerate(terms)}
    numbered = np.array([number[x] for x in spelled], np.int64)
    counted = written(docs.mapInArrow(_count(spark.sparkContext.broadcast(Vocabulary(terms))), COUNTED).where("n > 0").withColumn("row", F.monotonically_increasing_id()))
    documents, total = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()
    df = np.zeros(len(terms), np.int64)
    df[holding["term"].to_numpy()] = holding["df"].to_numpy()
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    own = [np.unique(numbered[words.first[i] : words.first[i + 1]], return_counts=True) for i in range(len(block))]
    queries = Queries(
        [row[0] for row in block], np.concatenate([[0], np.cumsum([len(t) for t, _ in own])]).astype(np.int64),
        np.concatenate([t for t, _ in own]), np.concatenate([c for _, c in own]), weights,
    )
    index = counted.where("size(terms) > 0").withColumn("m", F.expr(normaliser_of(documents, max(1, total))))
    sizes = index.groupBy("m").agg(F.expr(f"sum(size(terms)) div {POSTINGS_A_PART} + 1").alias("parts"))
    index = index.join(sizes, "m").withColumn("part", F.pmod(F.xxhash64("row"), "parts"))
    tasks = 1 + int(df.sum()) // POSTINGS_A_TASK + documents // DOCS_A_TASK
    index = index.repartition(tasks, "m", "part").sortWithinPartitions("m", "part").select("doc_id", "m", "terms", "counts")
    found = index.mapInArrow(_search(spark.sparkContext.broadcast(queries), to_arrow_type(kind)), f"number bigint, item_id {kind.simpleString()}, doc_id bigint, score bigint")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


def search(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ten highest-scoring documents of each item, all if fewer score above 0.

    Terms are runs of digits, letters and non-ASCII characters, A-Z lower-cased, of whole texts; a long text is counted in
    stretches. Null and empty texts have no terms, count nowhere and are never found. Equal scores come by ascending
    doc_id, a null doc_id last. Repeated rows of `docs` are documents of their own, repeated items are ranked each;
    an item without terms, or whose terms no document holds, has no rows. Empty tables give no rows; other columns are ignored.
    """
    documents = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    asked = written(items.select(F.col(item).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text")))
    kind = asked.schema["item"].dataType
    total = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    out = None
    for k in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        if block:
            found = _block(documents, block, kind).select("item_id", "rank", "doc_id", "score")
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id bigint, score bigint")
    return out
