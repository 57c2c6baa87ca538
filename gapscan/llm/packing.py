"""Packing of tokenised documents into windows by minimum bin slack.

Documents are tokenised and cut into whole windows and a rest, in one pass without a
shuffle. What has to be packed is then a multiset of rests, and the number of different
lengths is bounded by the window, whatever the corpus: its histogram is the only thing that
goes to the driver. There a bitset subset-sum programme picks, window by window, the
multiset of remaining lengths that comes closest to capacity; the same choice is repeated
as often as the counts allow, so the plan has a bounded size too. Pieces are numbered within their
length (in parts, so a frequent length is no single task) and find their place in the
plan by number.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapscan.llm.common import PIECE_BYTES, buffers, pieces, prefix_hashes, range_hashes, release, written

WINDOW = 2048
END = 1
#: Words whose ids a task remembers, and bytes of text that it encodes at once.
CACHE, PIECE = 200_000, PIECE_BYTES // 4
ROWS_A_PART = 1_000

LETTER, DIGIT, OTHER, BLANK = 0, 1, 2, 3
_KIND = np.full(256, OTHER, np.uint8)
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = LETTER
_KIND[48:58] = DIGIT
_KIND[[9, 10, 11, 12, 13, 32]] = BLANK
#: Bytes that only the library handles: apostrophes (contractions), odd controls, and what isn't ASCII or a letter of U+00C0 to U+024F.
_RARE = np.zeros(256, bool)
_RARE[[0x27, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2]] = True
_RARE[0xCA:] = True


class Tokens:
    """Ids of many texts at once.

    Common texts are cut into the vocabulary's words by byte classes, and each different
    word is encoded once; the rest, and texts with a special token, go through the library whole.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.word = lambda text: self.library.encode(text, add_special_tokens=False).ids
        if ranks:
            import tiktoken

            with open(ranks, "rb") as file:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            self.word = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=known, special_tokens={}).encode_ordinary
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.starts, self.lengths, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0
        self.ids, self.filled = np.zeros(1 << 18, np.uint32), 0

    def learn(self, keys: list[int], found: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        to, filled = self.used + len(found), self.filled + int(lengths.sum())
        if to > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * to), np.resize(self.lengths, 2 * to)
        if filled > len(self.ids):
            self.ids = np.resize(self.ids, 2 * filled)
        self.lengths[self.used : to] = lengths
        self.starts[self.used : to] = self.filled + np.cumsum(lengths) - lengths
        self.ids[self.filled : filled] = np.fromiter(chain.from_iterable(found), np.uint32, filled - self.filled)
        self.known.update(zip(keys, range(self.used, to), strict=True))
        self.used, self.filled = to, filled

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by END, and n + 1 offsets."""
        data, offsets = buffers(column)
        n = len(offsets) - 1
        rare = _RARE[data]
        rare[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        odd = np.diff(np.concatenate([[0], np.cumsum(rare)])[offsets]) > 0
        raw = data.tobytes() if self.special else b""
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                odd[np.searchsorted(offsets, at, "right") - 1] = True
                at = raw.find(token, at + 1)
        slow = {i: self.library.encode(data[offsets[i] : offsets[i + 1]].tobytes().decode(), add_special_tokens=False).ids for i in np.flatnonzero(odd).tolist()}
        places, ends = self._words(data, offsets)
        first = np.searchsorted(places, offsets)
        usual = np.repeat(~odd, np.diff(first))
        places, ends = places[usual], ends[usual]
        words = np.where(odd, 0, np.diff(first))
        which = self._ids_of(data, places, ends)
        lengths = self.lengths[which]
        total = np.concatenate([[0], np.cumsum(lengths)])
        by_text = np.concatenate([[0], np.cumsum(words)])
        counts = total[by_text[1:]] - total[by_text[:-1]]
        flat = self.ids[np.repeat(self.starts[which] - total[:-1], lengths) + np.arange(total[-1])]
        for i, ids in slow.items():
            counts[i] = len(ids)
        out_offsets = np.concatenate([[0], np.cumsum(counts + 1)])
        out = np.full(out_offsets[-1], END, np.uint32)
        keep = np.ones(len(out), bool)
        keep[out_offsets[1:] - 1] = False
        for i, ids in slow.items():
            out[out_offsets[i] : out_offsets[i + 1] - 1] = ids
            keep[out_offsets[i] : out_offsets[i + 1]] = False
        out[keep] = flat
        return out, out_offsets

    @staticmethod
    def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words start and end: runs of one class, which take one blank before them."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind = _KIND[data]
        begin = np.zeros(n + 1, bool)
        begin[1:n] = kind[1:] != kind[:-1]
        begin[offsets] = True
        edge = np.zeros(n + 1, bool)  # where texts start
        edge[offsets] = True
        blank = kind == BLANK
        start = begin[:n].copy()
        # a run after a space starts at that space, and the last blank before a run stands apart from earlier ones
        after_blank = begin[1:n] & ~edge[1:n] & ~blank[1:] & blank[:-1]
        start[1:] &= ~(after_blank & (data[:-1] == 32))
        start[:-1] |= after_blank
        places = np.flatnonzero(start)
        return places, np.append(places[1:], n)

    def _ids_of(self, data: np.ndarray, places: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(places):
            return np.zeros(0, np.int64)
        hashes = range_hashes(prefix_hashes(data), places, ends)
        different, one, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > CACHE:
            self.forget()
        keys = different.tolist()
        known = self.known
        missing = [i for i, key in enumerate(keys) if key not in known]
        if missing:
            k = one[missing]
            words = [data[a:b].tobytes().decode() for a, b in zip(places[k].tolist(), ends[k].tolist(), strict=True)]
            self.learn([keys[i] for i in missing], [self.word(word) for word in words])
        at = np.fromiter((known[key] for key in keys), np.int64, len(keys))
        return at[back]


_TOKENS: dict[tuple, Tokens] = {}


def tokens(*paths: str | None) -> Tokens:
    if paths not in _TOKENS:
        _TOKENS[paths] = Tokens(*paths)
    return _TOKENS[paths]


COLUMNS = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def _cut(paths: tuple, window: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                ids, offsets = tokens(*paths).encode(part.column(1))
                counts = np.diff(offsets)
                parts = -(-counts // window)
                owner = np.repeat(np.arange(len(counts)), parts)
                start = (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * window
                length = np.minimum(window, counts[owner] - start)
                at = offsets[owner] + start
                raw = ids.astype("<u4").tobytes()
                cut = [raw[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                columns = [part.column(0).take(pa.array(owner)), pa.array(start), pa.array(length),
                           pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array(counts[owner])]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array(cut, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
        tokens(*paths).forget()  # the worker goes on to other work
        release()

    return run


def token_pieces(docs: DataFrame, paths: tuple, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Whole windows and the rest of each document: (doc_id, start, length, ids_crc32, doc_tokens[, ids])."""
    schema = "doc_id bigint, " + COLUMNS + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_cut(paths, window, with_ids), schema)


def closest_fill(lengths: list[int], counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to `capacity`; holds the first length.

    Bit s of a bitset says that sum s can be reached. Counts enter as powers of two, and
    the sets after each step are kept for the way back.
    """
    mask = (1 << (capacity + 1)) - 1
    reach, steps = 1 << lengths[0], []
    for length in lengths:
        left = min(counts[length] - (length == lengths[0]), capacity // length)
        size = 1
        while left > 0:
            size = min(size, left)
            steps.append((length, size, reach))
            reach |= (reach << (length * size)) & mask
            left -= size
            size *= 2
        if reach >> capacity & 1:
            break
    total = reach.bit_length() - 1
    chosen = {lengths[0]: 1}
    for length, size, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + size
            total -= length * size
    return chosen


def plan_windows(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(multiset, how often) until all lengths are used up; each choice uses up a length at least."""
    counts = {length: n for length, n in histogram.items() if n}
    lengths = sorted(counts, reverse=True)
    plan = []
    while lengths:
        chosen = closest_fill(lengths, counts, capacity)
        times = min(counts[length] // n for length, n in chosen.items())
        plan.append((chosen, times))
        for length, n in chosen.items():
            counts[length] -= n * times
        lengths = [length for length in lengths if counts[length]]
    return plan


def _places(plan: list[tuple[dict[int, int], int]]):
    """Column function (length, number within length) -> (sequence_id, offset), from the bounded plan."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for chosen, times in plan:
        offset = 0
        for length, n in chosen.items():
            at = used.get(length, 0)
            rows.append((length << 44 | at, at, n, sequence, offset, length))
            used[length] = at + n * times
            offset += length * n
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def find(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for length, number in parts:
            length, number = length.to_numpy(np.int64), number.to_numpy(np.int64)
            of = table[np.searchsorted(table[:, 0], length << 44 | number, "right") - 1]
            since = number - of[:, 1]
            yield pd.DataFrame({"sequence_id": of[:, 3] + since // of[:, 2], "offset": of[:, 4] + since % of[:, 2] * of[:, 5]})

    return find(F.col("length"), F.col("number"))


def pack(docs: DataFrame, paths: tuple, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with sequence_id and offset; sequences hold at most `window` ids.

    `paths`: the tokenizer's file, and the same vocabulary as ranks with its pattern, or None.
    A null or empty text is one piece with the end mark alone. A text is tokenised whole, in one task, which takes about 50 bytes of memory for
    each of its bytes. Pieces of equal length are placed by id, start and checksum; equal ones are alike, so any order is right. Null ids keep their
    rows; repeated rows are packed each; an empty table gives no rows; other columns are ignored.
    """
    cut = written(token_pieces(docs, paths, window, with_ids))
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # a row a length
    spark = docs.sparkSession
    split = spark.createDataFrame([(k, -(-n // ROWS_A_PART)) for k, n in histogram.items()], "length bigint, parts bigint")
    parted = cut.join(F.broadcast(split), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), "parts"))
    sizes = parted.groupBy("length", "part").count()
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    numbered = parted.withColumn("within", F.row_number().over(within) - 1).join(offsets, ["length", "part"])
    numbered = numbered.withColumn("number", F.col("within") + F.col("earlier"))
    return numbered.withColumn("place", _places(plan_windows(histogram, window))).select(*cut.columns, "place.sequence_id", "place.offset")
