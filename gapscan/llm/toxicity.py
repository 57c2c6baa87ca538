"""Toxicity by a convolutional text classifier, trained here in numpy.

A word's vector is the sum of hashed embeddings of the word and of its first four and five
bytes. Filters one, two and three words wide slide over the whole text, each keeps its
largest response, and a logistic layer weighs them. Training takes all labelled rows: each
round, shards of them go on from the same model side by side, and what they change is averaged,
a row per bucket. Scoring is one pass over all texts, without a shuffle. The score never sees language,
source or id; only the decision `flagged` uses thresholds that are calibrated by language.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapscan.llm.common import Words, discard, pieces, prefix_hashes, range_hashes, tidy, written

WIDTHS = (1, 2, 3)
FILTERS, DIM = 8, 8
WORD_BITS, START_BITS = 18, 16
STARTS = (4, 5)
BUCKETS = (1 << WORD_BITS) + len(STARTS) * (1 << START_BITS)
COLUMNS = FILTERS * sum(WIDTHS)
#: Words worked on at once; a longer text is taken in parts that overlap.
CHUNK = 1 << 14

#: Rows and characters that a shard of training has on average, and words it holds at once at most, but for a single text.
SHARD_ROWS, SHARD_CHARS, SHARD_WORDS = 8000, 32 << 20, 1 << 23
#: So many labelled ids are broadcast at most; more meet their texts in a shuffle by id.
SENT_IDS = 1_000_000
#: Rounds over all rows; a shard with few rows passes them several times a round, for about UPDATES in all.
ROUNDS, UPDATES, BATCH, RATE = 4, 1200, 32, 0.15
DROPPED = 0.3
#: A bucket that fewer training texts hold keeps a zero vector.
LEAST_TEXTS = 3
FOLDS = 5
#: One training row in so many trains nothing: it tells which round did best, and calibrates.
HELD = 5
#: Changes are summed as whole numbers, so that sums do not depend on their order.
UNIT = float(1 << 32)
#: Scores of held rows are counted in steps of 1/STEPS of a logit, from -EDGE to EDGE.
STEPS, EDGE = 64, 30
#: A language has a threshold of its own from so many held rows of each class on.
LEAST_HELD = 20


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all words (one row each), and the rows' n + 1 offsets by text."""
    words = Words(column)
    out = np.empty((len(words.hashes), 1 + len(STARTS)), np.int32)
    out[:, 0] = words.hashes >> np.uint64(64 - WORD_BITS)
    sums = prefix_hashes(words.data)
    for k, size in enumerate(STARTS):
        hashes = range_hashes(sums, words.starts, np.minimum(words.ends, words.starts + size))
        out[:, 1 + k] = (hashes >> np.uint64(64 - START_BITS)).astype(np.int32) + (1 << WORD_BITS) + k * (1 << START_BITS)
    return out, words.first


class Products:
    """The products of buckets' vectors with all filters, summed in one order and rounded once.

    Matrix products round differently with the number of rows; here a word's responses depend on its buckets alone, so
    that equal texts score alike in any batch.
    """

    def __init__(self, buckets: np.ndarray, vectors: np.ndarray, filters: np.ndarray):
        self.place = np.full(BUCKETS + 1, len(buckets), np.int32)
        self.place[buckets] = np.arange(len(buckets), dtype=np.int32)
        self.values = np.zeros((len(buckets) + 1, COLUMNS), np.float32)
        for at in range(0, len(buckets), CHUNK):
            values = np.zeros((len(vectors[at : at + CHUNK]), COLUMNS))
            for k in range(DIM):
                values += vectors[at : at + CHUNK, k, None].astype(np.float64) * filters[k].astype(np.float64)
            self.values[at : at + len(values)] = values

    def of(self, rows: np.ndarray) -> np.ndarray:
        """Of each word the sum over its buckets."""
        at = self.place[rows]
        out = self.values[at[:, 0]]
        for k in range(1, rows.shape[1]):
            out += self.values[at[:, k]]
        return out


@dataclass
class Model:
    """Embeddings of the buckets that training saw, filters, and the logistic layer."""

    buckets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, DIM), np.float32))
    filters: np.ndarray = field(default_factory=lambda: np.zeros((DIM, COLUMNS), np.float32))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    bias: float = -20.0
    #: Decision thresholds by language, for languages with enough rows of both classes.
    thresholds: dict[str, float] = field(default_factory=dict)

    def products(self) -> Products:
        return Products(self.buckets, self.vectors, self.filters)


def responses(words: np.ndarray) -> np.ndarray:
    """Responses of all filters at all words from the words' products; behind the end there are zeros."""
    n, at = len(words), 0
    products = np.zeros((n + max(WIDTHS) - 1, COLUMNS), words.dtype)
    products[:n] = words
    out = np.zeros((n, len(WIDTHS) * FILTERS), words.dtype)
    for k, width in enumerate(WIDTHS):
        for j in range(width):
            out[:, k * FILTERS : (k + 1) * FILTERS] += products[j : j + n, at : at + FILTERS]
            at += FILTERS
    return out


def padded(rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with empty ones (the last bucket, a zero vector) between texts, and the texts' new offsets."""
    gap = max(WIDTHS) - 1
    n = len(first) - 1
    out = np.full((len(rows) + gap * n, rows.shape[1]), BUCKETS, np.int32)
    owner = np.repeat(np.arange(n), np.diff(first))
    out[np.arange(len(rows)) + gap * owner] = rows
    return out, first + gap * np.arange(n + 1)


def pooled(model: Model, products: Products, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The largest response of each filter in each text, at least 0."""
    n = len(first) - 1
    out = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
    rows, places = padded(rows, first)
    ends = places[:-1] + np.diff(first)
    gap = max(WIDTHS) - 1
    for at in range(0, len(rows), CHUNK):
        part = rows[at : at + CHUNK + gap]
        found = responses(products.of(part))[:CHUNK] + model.offsets
        here = np.flatnonzero((places[:-1] < at + len(found)) & (ends > at) & (ends > places[:-1]))
        if len(here):
            cuts = np.stack([np.maximum(places[here], at), np.minimum(ends[here], at + len(found))], 1).ravel() - at
            found = np.concatenate([found, np.zeros((1, found.shape[1]), np.float32)])
            out[here] = np.maximum(out[here], np.maximum.reduceat(found, cuts, axis=0)[::2])
    return out


def logits(model: Model, products: Products, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    best = pooled(model, products, rows, first)
    out = np.full(len(best), float(model.bias))
    for k, weight in enumerate(model.weights.astype(np.float64)):
        out += best[:, k].astype(np.float64) * weight
    return out


def chance(logit: float) -> float:
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, logit))))


@dataclass
class State:
    """What training goes on from: parameters and their summed squared gradients (Adagrad), as rows of DIM numbers.

    First the vectors of `buckets`, then the filters' columns, the weights, the offsets and the bias.
    """

    buckets: np.ndarray
    values: np.ndarray
    squares: np.ndarray

    @staticmethod
    def new(buckets: np.ndarray, seed: int = 7) -> State:
        rng = np.random.default_rng(seed)
        dense = rng.normal(0, 0.5, (COLUMNS * DIM + len(WIDTHS) * FILTERS)), np.zeros(len(WIDTHS) * FILTERS + DIM)
        values = np.concatenate([rng.normal(0, 0.02, (len(buckets), DIM)), np.concatenate(dense).reshape(-1, DIM)]).astype(np.float32)
        return State(buckets, values, np.full(values.shape, 0.01, np.float32))

    def parts(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Vectors, filters, weights, offsets and bias as views of `values` or `squares`."""
        n, many = len(self.buckets), len(WIDTHS) * FILTERS
        dense = rows[n:].reshape(-1)
        at = COLUMNS * DIM
        return rows[:n], rows[n : n + COLUMNS].T, dense[at : at + many], dense[at + many : at + 2 * many], dense[at + 2 * many : at + 2 * many + 1]

    def model(self) -> Model:
        vectors, filters, weights, offsets, bias = self.parts(self.values)
        return Model(self.buckets, vectors, filters, offsets, weights, float(bias[0]))


def _tops(table: np.ndarray, filters: np.ndarray, offsets: np.ndarray, rows: np.ndarray, places: np.ndarray, ends: np.ndarray):
    """Of each text and filter the largest response and its row; rows are taken in parts, whatever a text's length."""
    gap, many = max(WIDTHS) - 1, np.arange(len(WIDTHS) * FILTERS)
    top = np.zeros((len(ends), len(many)), np.int64)
    best = np.zeros(top.shape, np.float32)
    for at in range(0, len(rows), CHUNK):
        found = responses(table[rows[at : at + CHUNK + gap]].sum(axis=1) @ filters)[:CHUNK] + offsets
        for k in np.flatnonzero((places < at + len(found)) & (ends > at)):
            a = max(int(places[k]) - at, 0)
            b = min(int(ends[k]) - at, len(found))
            if b > a:
                here = found[a:b].argmax(axis=0) + a
                response = found[here, many]
                more = response > best[k]
                top[k, more], best[k, more] = here[more] + at, response[more]
    return top, best


def train(state: State, texts: list[np.ndarray], labels: np.ndarray, share: float, rng: np.random.Generator) -> np.ndarray:
    """Passes over the texts (rows of places in `state.buckets`), changing the state; returns which of its rows changed.

    `share` is the weight of a toxic row.
    """
    vectors_, filters, weights, offsets, bias = state.parts(state.values)
    table = np.concatenate([vectors_, np.zeros((1, DIM), np.float32)])
    none = len(table) - 1
    squares = state.parts(state.squares)
    changed = np.zeros(len(state.values), bool)
    changed[none:] = True
    width_of = np.repeat(WIDTHS, FILTERS)
    column_of = np.concatenate([FILTERS * sum(WIDTHS[:k]) + np.arange(FILTERS) for k in range(len(WIDTHS))])
    gap = max(WIDTHS) - 1
    for _ in range(max(1, UPDATES // (ROUNDS * -(-len(texts) // BATCH)))):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            sizes = np.array([len(texts[i]) for i in chosen])
            places = np.concatenate([[0], np.cumsum(sizes + gap)[:-1]])
            rows = np.full((int(sizes.sum()) + gap * len(chosen), 1 + len(STARTS)), none, np.int32)
            for i, place in zip(chosen, places):
                rows[place : place + len(texts[i])] = texts[i]
            rows[rng.random(len(rows), np.float32) < DROPPED] = none  # no single word decides a text
            top, best = _tops(table, filters, offsets, rows, places, places + sizes)
            active = best > 0
            y = labels[chosen]
            p = 1 / (1 + np.exp(-np.clip(best @ weights + bias[0], -30, 30)))
            g = ((p - y) * np.where(y == 1, share, 1.0) / len(chosen)).astype(np.float32)
            g_best = g[:, None] * weights * active
            g_filters, g_rows, g_vectors = np.zeros((DIM, COLUMNS), np.float32), [], []
            for j in range(max(WIDTHS)):
                k, f = np.nonzero(active & (width_of > j))
                place, column = top[k, f] + j, column_of[f] + j * FILTERS
                np.add.at(g_filters.T, column, g_best[k, f, None] * table[rows[place]].sum(axis=1))
                g_rows.append(rows[place])
                g_vectors.append(g_best[k, f, None] * filters[:, column].T)
            touched, back = np.unique(np.concatenate(g_rows).ravel(), return_inverse=True)
            g_table = np.zeros((len(touched), DIM), np.float32)
            np.add.at(g_table, back.ravel(), np.repeat(np.concatenate(g_vectors), 1 + len(STARTS), axis=0))
            if len(touched) and touched[-1] == none:
                touched, g_table = touched[:-1], g_table[:-1]
            squares[0][touched] += g_table**2
            table[touched] -= RATE * g_table / np.sqrt(squares[0][touched])
            changed[touched] = True
            whole = np.array([g.sum()], np.float32)
            for x, square, gx in zip((filters, weights, offsets, bias), squares[1:], (g_filters, best.T @ g, g_best.sum(axis=0), whole)):
                square += gx**2
                x -= RATE / 3 * gx / np.sqrt(square)
    vectors_[:] = table[:-1]
    return changed


def _steps(scores: np.ndarray) -> np.ndarray:
    """The step of each logit, from 0."""
    return np.floor(np.clip(scores, -EDGE, EDGE) * STEPS).astype(np.int64) + EDGE * STEPS


def _best_cut(toxic: np.ndarray, clean: np.ndarray) -> float:
    """The threshold with the fewest errors, in the middle of the gap it stands in, from the rows counted by step."""
    there = np.flatnonzero(toxic + clean)
    errors = np.concatenate([[0], np.cumsum(toxic)]) + np.concatenate([np.cumsum(clean[::-1])[::-1], [0]])
    edges = np.arange(max(0, there[0] - 2 * STEPS), min(len(toxic), there[-1] + 1 + 2 * STEPS) + 1)
    best = edges[errors[edges] == errors[edges].min()]
    return float(best[len(best) // 2]) / STEPS - EDGE


def _loss(toxic: np.ndarray, clean: np.ndarray, share: float) -> float:
    middles = (np.arange(len(toxic)) + 0.5) / STEPS - EDGE
    return float((toxic * np.logaddexp(0, -middles)).sum() * share + (clean * np.logaddexp(0, middles)).sum())


@tidy
def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with words as the bucket numbers of their words, eight bytes a word."""
    for batch in batches:
        for part in pieces(batch, "text"):
            rows, first = features(part.column("text"))
            rows = rows.astype(np.int64) - [0, 1 << WORD_BITS, (1 << WORD_BITS) + (1 << START_BITS)]
            words = pa.py_buffer((rows[:, 0] << 32 | rows[:, 1] << 16 | rows[:, 2]).tobytes())
            offsets = pa.py_buffer((first * 8).astype(np.int32).tobytes())
            packed = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, offsets, words])
            there = pa.array(np.diff(first) > 0)
            yield pa.RecordBatch.from_arrays([packed, *part.columns[1:]], names=["rows", *part.schema.names[1:]]).filter(there)


def _buckets(words: bytes) -> np.ndarray:
    """A text's bucket numbers (one row each), as `features` gives them."""
    packed = np.frombuffer(words, np.int64)
    out = np.empty((len(packed), 1 + len(STARTS)), np.int32)
    out[:, 0] = packed >> 32
    out[:, 1] = (packed >> 16 & 0xFFFF) + (1 << WORD_BITS)
    out[:, 2] = (packed & 0xFFFF) + (1 << WORD_BITS) + (1 << START_BITS)
    return out


def _shards(batches: Iterator[pa.RecordBatch], place: np.ndarray):
    """(shard, texts as rows of places, toxic, held, lang) of each shard; one with very many words comes in parts."""
    texts, toxic, held, lang, now, words = [], [], [], [], None, 0
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("toxic", "lang", "shard", "held"))
        for packed, y, language, shard, h in zip(batch.column("rows"), *columns):
            if texts and (shard != now or words > SHARD_WORDS):
                yield now, texts, np.array(toxic, np.int64), np.array(held, bool), lang
                texts, toxic, held, lang, words = [], [], [], [], 0
            now = shard
            texts.append(place[_buckets(packed.as_buffer())])
            toxic.append(y)
            held.append(h)
            lang.append(language)
            words += len(texts[-1])
    if texts:
        yield now, texts, np.array(toxic, np.int64), np.array(held, bool), lang


@tidy
def _texts_by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for packed in batch.column("rows"):
            seen[np.unique(_buckets(packed.as_buffer()))] += 1
    found = np.flatnonzero(seen)
    for at in range(0, len(found), CHUNK):
        some = found[at : at + CHUNK]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["at", "n"])


#: What a shard tells of a round: changes of the state's rows (`at` from 0 on), and held rows by step and class (below 0).
_CHANGES = [f"v{k}" for k in range(2 * DIM)]


def _places(buckets: np.ndarray) -> np.ndarray:
    place = np.full(BUCKETS + 1, len(buckets), np.int32)
    place[buckets] = np.arange(len(buckets), dtype=np.int32)
    return place


def _counted_held(state: State, texts: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Twice the step of each text's score, plus its class."""
    products = Products(np.arange(len(state.buckets), dtype=np.int32), *state.parts(state.values)[:2])
    products.place[len(state.buckets) :] = len(state.buckets)
    model, out = state.model(), []
    for at in range(0, len(texts), BATCH):
        some = texts[at : at + BATCH]
        first = np.concatenate([[0], np.cumsum([len(t) for t in some])])
        rows = np.concatenate(some)
        rows = np.where(rows == len(state.buckets), BUCKETS, rows)
        out.append(_steps(logits(model, products, rows, first)))
    return 2 * np.concatenate(out) + toxic


def _round(sent, number: int, share: float):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start: State = sent.value
        for shard, texts, toxic, held, _ in _shards(batches, _places(start.buckets)):
            if held.any():
                at, n = np.unique(_counted_held(start, [t for t, h in zip(texts, held) if h], toxic[held]), return_counts=True)
                nothing = [pa.array(np.zeros(len(at), np.int64))] * len(_CHANGES)
                yield pa.RecordBatch.from_arrays([pa.array(-1 - at), pa.array(n), *nothing], names=["at", "n", *_CHANGES])
            if held.all():
                continue
            state = State(start.buckets, start.values.copy(), start.squares.copy())
            rng = np.random.default_rng([7, number, shard])
            at = np.flatnonzero(train(state, [t for t, h in zip(texts, held) if not h], toxic[~held], share, rng))
            for some in np.array_split(at, -(-len(at) // CHUNK)):
                moved = np.concatenate([x[some].astype(np.float64) - y[some] for x, y in ((state.values, start.values), (state.squares, start.squares))], 1)
                moved = np.rint(moved * UNIT).astype(np.int64)
                columns = [pa.array(np.ascontiguousarray(moved[:, k])) for k in range(moved.shape[1])]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.ones(len(some), np.int64)), *columns], names=["at", "n", *_CHANGES])

    return run


def _held_by_language(sent):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: State = sent.value
        for _, texts, toxic, held, lang in _shards(batches, _places(state.buckets)):
            if held.any():
                counted = _counted_held(state, [t for t, h in zip(texts, held) if h], toxic[held])
                yield pa.RecordBatch.from_arrays([pa.array([x or "" for x, h in zip(lang, held) if h], pa.string()), pa.array(counted)], names=["lang", "at"])

    return run


def _by_class(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of toxic and of clean rows by step."""
    counts = np.zeros(2 * (2 * EDGE * STEPS + 1), np.int64)
    np.add.at(counts, at, n)
    return counts[1::2], counts[::2]


def _calibrated(rows: DataFrame, state: State, share: float) -> tuple[Model, float]:
    """The model with thresholds that all held rows give, and their loss."""
    sent = rows.sparkSession.sparkContext.broadcast(state)
    counted = rows.where("held").mapInArrow(_held_by_language(sent), "lang string, at bigint").groupBy("lang", "at").agg(F.count("*").alias("n"))
    # languages with few rows of a class have no threshold: theirs count in the total only
    classes = [F.sum(F.when(F.col("at") % 2 == k, F.col("n")).otherwise(0)).over(Window.partitionBy("lang")) for k in (0, 1)]
    kept = counted.withColumn("lang", F.when(F.least(*classes) >= LEAST_HELD, F.col("lang")))
    table = kept.groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    sent.destroy()
    m = state.model()
    toxic, clean = _by_class(table["at"].to_numpy(np.int64), table["n"].to_numpy(np.int64))
    loss = _loss(toxic, clean, share)
    if toxic.any() and clean.any():
        cut = _best_cut(toxic, clean)
        m.bias -= cut
        for language, own in table.dropna().groupby("lang"):
            # half way to the language's own best cut: its rows are fewer than all
            own_cut = _best_cut(*_by_class(own["at"].to_numpy(np.int64), own["n"].to_numpy(np.int64))) - cut
            m.thresholds[language] = float(1 / (1 + np.exp(-0.5 * own_cut)))
    return m, loss


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The texts to learn from with their class, in shards by hash of the id; each shard's rows lie together, in one order."""
    known = (
        labels.where("toxic in (0, 1) and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0)
    )
    few = known.count() <= SENT_IDS
    if few:
        known = F.broadcast(known)
    language = F.col("lang") if "lang" in docs.columns else F.lit(None)
    texts = docs.select("doc_id", "text", language.cast("string").alias("lang"), F.length("text").alias("size")).where("size > 0")
    rows, chars = texts.select("doc_id", "size").join(known, "doc_id").agg(F.count("*"), F.sum("size")).first()
    shards = max(1, -(-rows // SHARD_ROWS), -(-(chars or 0) // SHARD_CHARS))
    if not few:  # Spark shuffles anew for a join in fewer parts than it is set to
        shards = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # the partition that an id goes to, so that a join by shuffle has its rows there already; else rows are dealt by this number
    # itself, so that a shard is one task's however many partitions a key would be hashed to
    number = F.pmod(F.hash("doc_id"), F.lit(shards))
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(HELD)) == 0
    if few:
        placed = texts.join(known, "doc_id").withColumns({"shard": number, "held": held}).repartitionById(shards, "shard")
    else:
        placed = texts.repartition(shards, "doc_id").join(known.repartition(shards, "doc_id"), "doc_id")
        placed = placed.withColumns({"shard": number, "held": held})
    placed = placed.sortWithinPartitions("shard", F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "text", "lang")
    return written(placed.select("text", "toxic", "lang", "shard", "held").mapInArrow(_packed, "rows binary, toxic int, lang string, shard int, held boolean"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from all labelled rows; only those whose crc32(doc_id as text) mod 5 is not 0 are learnt from.

    A round passes all rows: each shard trains from the round's model, and the next one has, of each parameter, the mean change
    of the shards that changed it. Every fifth row is held back: the round that does best on them all stays, and
    they calibrate the thresholds. What comes to the driver is bounded by the model's size.
    """
    rows = _labelled(docs, labels)
    counts = {(r["toxic"], r["held"]): r["count"] for r in rows.groupBy("toxic", "held").count().collect()}
    classes = {toxic for toxic, _ in counts}
    if len(classes) < 2:
        discard(rows)
        return Model(bias=20.0 if classes == {1} else -20.0)
    share = float(np.clip(counts.get((0, False), 0) / max(1, counts.get((1, False), 0)), 1, 10))
    seen = rows.mapInArrow(_texts_by_bucket, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TEXTS)
    state = State.new(np.sort(seen.select("at").toArrow().column(0).to_numpy()).astype(np.int32))
    schema = ", ".join(f"{c} bigint" for c in ("at", "n", *_CHANGES))
    least, best = np.inf, None
    for number in range(ROUNDS):
        sent = rows.sparkSession.sparkContext.broadcast(state)
        told = rows.mapInArrow(_round(sent, number, share), schema).groupBy("at").agg(*[F.sum(c).alias(c) for c in ("n", *_CHANGES)]).toArrow()
        sent.destroy()
        at, n = told.column("at").to_numpy(), told.column("n").to_numpy()
        held = at < 0
        loss = _loss(*_by_class(-1 - at[held], n[held]), share)
        if number and loss < least:
            least, best = loss, state
        moved = np.stack([told.column(c).to_numpy()[~held] for c in _CHANGES], 1) / UNIT / n[~held, None]
        state = State(state.buckets, state.values.copy(), state.squares.copy())
        state.values[at[~held]] += moved[:, :DIM].astype(np.float32)
        state.squares[at[~held]] += moved[:, DIM:].astype(np.float32)
    model, loss = _calibrated(rows, state, share)
    if best is not None and loss > least:  # the round that does best on the held texts stays
        model, _ = _calibrated(rows, best, share)
    discard(rows)
    return model


def _score(sent, names: list[str], text: str):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        products = None
        for batch in batches:
            products = model.products() if products is None else products
            for part in pieces(batch, text, CHUNK * 32):
                found = logits(model, products, *features(part.column(names.index(text))))
                scores = [chance(x) for x in found.tolist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=[*names, "score"])

    return run


def score(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """`docs` with score (0 to 1), predicted (1 from 0.5 on) and flagged (from the language's threshold on).

    Null and empty texts get the score of no words at all. A language without a threshold
    uses 0.5, and so do tables without the column. Repeated rows score alike; columns with the name of an added one are replaced.
    """
    docs = docs.drop("score", "predicted", "flagged")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.withColumn("score", F.lit(0.5)).schema
    out = docs.mapInArrow(_score(sent, docs.columns, text), schema)
    threshold = F.lit(0.5)
    if lang in docs.columns:
        for language, value in model.thresholds.items():
            threshold = F.when(F.col(lang) == language, F.lit(value)).otherwise(threshold)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn("flagged", F.col("score") >= threshold)
