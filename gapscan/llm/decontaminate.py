"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of about half a megabyte in one task. Its words are mapped
to the benchmark's vocabulary; runs of such words that are long enough for a window are
indexed, other words cannot be part of one. All benchmark windows are searched at once,
backwards through wavelet-tree ranks; occurrences are located by walking to sampled
suffix positions, and merged into spans. No shuffle.

The benchmark is a query set: it is taken in blocks of bounded size, each broadcast by
itself and passed over all documents in one chain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapscan.llm.common import PIECE_BYTES, Words, buffers, pieces, tidy

#: Bytes of benchmark text in a broadcast block.
BLOCK_BYTES = 8 << 20
SAMPLE_STEP = 16

FOUND = "n_words bigint, hit_starts array<bigint>, hit_ends array<bigint>, n_hit bigint, items array<string>"


def suffix_array(values: np.ndarray) -> np.ndarray:
    """Order of all suffixes; the last value must be smaller than all others."""
    n = len(values)
    order = np.argsort(values, kind="stable")
    step = 1
    key = values
    while True:
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]) if n else []
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        later = np.zeros(n, np.int64)
        later[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + later
        order = np.argsort(key, kind="stable")
        step *= 2


class FMIndex:
    """Backward search and location over a sequence of symbols from 1 on."""

    def __init__(self, sequence: np.ndarray):
        text = np.append(sequence.astype(np.int64), 0)
        order = suffix_array(text)
        self.last = text[order - 1]
        self.n = len(text)
        self.levels = []
        self.bits = max(1, int(text.max()).bit_length())
        values = self.last
        for bit in range(self.bits - 1, -1, -1):
            ones = (values >> bit) & 1
            self.levels.append((bit, np.concatenate([[0], np.cumsum(ones)]), int(self.n - ones.sum())))
            values = np.concatenate([values[ones == 0], values[ones == 1]])
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << self.bits))])
        marked = order % SAMPLE_STEP == 0
        self.marked = marked
        self.marks = np.concatenate([[0], np.cumsum(marked)])
        self.places = order[marked]

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first `ends` of the last column."""
        starts = np.zeros(len(symbols), np.int64)
        for bit, ones, zeros in self.levels:
            one = (symbols >> bit) & 1 == 1
            starts = np.where(one, zeros + ones[starts], starts - ones[starts])
            ends = np.where(one, zeros + ones[ends], ends - ones[ends])
        return ends - starts

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of phrases of one length, a row each."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        alive = np.flatnonzero((phrases < 1 << self.bits).all(axis=1))
        high[np.setdiff1d(np.arange(len(phrases)), alive)] = 0
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbols = phrases[alive, column]
            low[alive] = self.before[symbols] + self.rank(symbols, low[alive])
            high[alive] = self.before[symbols] + self.rank(symbols, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of suffixes: back to the next sampled one, counting steps."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.marked[rows])
        while len(walking):
            at = rows[walking]
            symbols = self.last[at]
            rows[walking] = self.before[symbols] + self.rank(symbols, at)
            steps[walking] += 1
            walking = walking[~self.marked[rows[walking]]]
        return self.places[self.marks[rows]] + steps


class Phrases:
    """The windows of a block of benchmark items, as symbols of its vocabulary."""

    def __init__(self, ids: list, texts: list, size: int):
        words = Words(pa.array(texts, pa.string()))
        self.keys, one = np.unique(words.hashes, return_index=True)
        lengths = (words.ends - words.starts)[one]
        self.starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(one) else np.zeros(0, np.int64)
        self.lengths = lengths
        self.bytes = np.frombuffer(b"".join(words.word(i) for i in one), np.uint8)
        symbols = np.searchsorted(self.keys, words.hashes) + 1
        windows: dict[tuple, set[str]] = {}
        for i, item in enumerate(ids):
            row = symbols[words.first[i] : words.first[i + 1]].tolist()
            width = min(size, len(row))
            for k in range(len(row) - width + 1 if row else 0):
                windows.setdefault(tuple(row[k : k + width]), set()).add("" if item is None else str(item))
        self.groups = []
        for width in sorted({len(w) for w in windows}):
            of = [w for w in windows if len(w) == width]
            self.groups.append((width, np.array(of, np.int64), [sorted(windows[w]) for w in of]))
        self.shortest = min((g[0] for g in self.groups), default=size)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def symbols(self, words: Words) -> np.ndarray:
        """Symbols of all words; 0 where the vocabulary lacks the word (compared byte by byte)."""
        out = np.zeros(len(words.hashes), np.int64)
        if not len(self.keys):
            return out
        some = np.flatnonzero(self.maybe[(words.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.keys, words.hashes[some]), len(self.keys) - 1)
        lengths = words.ends[some] - words.starts[some]
        same = (self.keys[place] == words.hashes[some]) & (self.lengths[place] == lengths)
        some, place, lengths = some[same], place[same], lengths[same]
        if len(some):
            within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            equal = words.data[np.repeat(words.starts[some], lengths) + within] == self.bytes[np.repeat(self.starts[place], lengths) + within]
            whole = np.logical_and.reduceat(equal, np.cumsum(lengths) - lengths)
            out[some[whole]] = place[whole] + 1
        return out


def search_shard(phrases: Phrases, column: pa.Array) -> tuple[Words, np.ndarray, list[set[str]]]:
    """The words of a shard, which of them are in an occurrence, and the items found in each text."""
    words = Words(column)
    n_texts = len(words.first) - 1
    items: list[set[str]] = [set() for _ in range(n_texts)]
    hit = np.zeros(len(words.hashes) + 1, np.int64)
    symbols = phrases.symbols(words)
    known = np.zeros(len(symbols) + 2, np.int8)
    known[1:-1] = symbols > 0
    # runs of known words within a text
    cut = np.zeros(len(symbols) + 1, bool)
    cut[words.first] = True
    edge = known[1:] != known[:-1]
    starts = np.flatnonzero((edge | cut)[: len(symbols)] & (symbols > 0))
    stops = np.flatnonzero((edge | cut)[1:] & (symbols > 0)) + 1
    keep = stops - starts >= phrases.shortest
    starts, stops = starts[keep], stops[keep]
    if len(starts) and phrases.groups:
        lengths = stops - starts + 1  # with a separator, which no phrase holds
        within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        place = np.repeat(starts, lengths) + within
        sequence = np.where(within == np.repeat(lengths - 1, lengths), len(phrases.keys) + 1, symbols[np.minimum(place, len(symbols) - 1)])
        index = FMIndex(sequence)
        for width, rows, owners in phrases.groups:
            low, high = index.search(rows)
            sizes = high - low
            which = np.repeat(np.arange(len(rows)), sizes)
            suffixes = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
            at = place[index.locate(suffixes)]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + width, -1)
            texts = np.searchsorted(words.first, at, "right") - 1
            for text, window in set(zip(texts.tolist(), which.tolist(), strict=True)):
                items[text].update(owners[window])
    return words, np.cumsum(hit)[:-1] > 0, items


def _merge(starts: list, ends: list) -> tuple[list[int], list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [x[0] for x in out], [x[1] for x in out]


def _pass(broadcast, size: int, text: str, own: list[str]):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = None
        for batch in batches:
            phrases = phrases or Phrases(*broadcast.value, size)
            for part in pieces(batch, text, PIECE_BYTES // 4):
                words, hit, items = search_shard(phrases, part.column(own.index(text)))
                hit = np.concatenate([[False], hit, [False]])
                before = part.column(len(own) + 1).to_pylist(), part.column(len(own) + 2).to_pylist(), part.column(len(own) + 4).to_pylist()
                counts, starts, ends, hits, found = [], [], [], [], []
                for i in range(part.num_rows):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    mine = hit[a + 1 : b + 1]
                    s, e = [], []
                    if mine.any():
                        change = np.diff(np.concatenate([[0], mine.astype(np.int8), [0]]))
                        s, e = np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist()
                    s, e = _merge(before[0][i] + s, before[1][i] + e)
                    counts.append(b - a)
                    starts.append(s)
                    ends.append(e)
                    hits.append(sum(e) - sum(s))
                    found.append(sorted({*before[2][i], *items[i]}))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(own)], pa.array(counts, pa.int64()), pa.array(starts, pa.list_(pa.int64())),
                     pa.array(ends, pa.list_(pa.int64())), pa.array(hits, pa.int64()), pa.array(found, pa.list_(pa.string()))],
                    names=[*own, "n_words", "hit_starts", "hit_ends", "n_hit", "items"],
                )

    return run


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """`docs` with n_words, hit_starts and hit_ends (merged runs of hit words), n_hit and items.

    A window is `size` consecutive words of an item; a shorter item with any word is one
    window. Null and empty texts have no words; an empty benchmark hits nothing; equal items
    all count; repeated rows are judged each; a text is judged whole, in one task, which takes about 50 bytes of memory for each of its bytes; a column of `docs` with the name of an added one is replaced.
    """
    added = [x.split()[0] for x in FOUND.split(", ")]
    docs = docs.drop(*added)
    names = docs.columns
    items = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    out = docs.select(
        *names, F.lit(0).cast("bigint").alias("n_words"), F.array().cast("array<bigint>").alias("hit_starts"),
        F.array().cast("array<bigint>").alias("hit_ends"), F.lit(0).cast("bigint").alias("n_hit"), F.array().cast("array<string>").alias("items"),
    )
    schema = out.schema
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        sent = docs.sparkSession.sparkContext.broadcast(([r[0] for r in block], [r[1] for r in block]))
        out = out.mapInArrow(_pass(sent, size, text, names), schema)
    return out


def _cut(text: str, names: list[str]):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, last = names.index(text), names.index("hit_starts"), names.index("hit_ends")
        for batch in batches:
            for part in pieces(batch, text, PIECE_BYTES // 4):
                column = part.column(at)
                starts, ends = part.column(first).to_pylist(), part.column(last).to_pylist()
                texts = column.to_pylist()
                if any(starts):
                    words = Words(column)
                    raw, offsets = buffers(column)
                    for i, s in enumerate(starts):
                        if s:
                            of, at_byte, kept = int(words.first[i]), int(offsets[i]), []
                            for a, b in zip(s, ends[i], strict=True):
                                kept.append(raw[at_byte : words.starts[of + a]].tobytes())
                                at_byte = int(words.ends[of + b - 1])
                            texts[i] = (b"".join(kept) + raw[at_byte : offsets[i + 1]].tobytes()).decode()
                yield part.set_column(at, names[at], pa.array(texts, column.type))

    return run


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """`docs` with all hit words, and what stands between those of a run, cut out of the text."""
    found = find_contamination(docs, benchmark, text=text, **options)
    return found.mapInArrow(_cut(text, found.columns), found.schema)
