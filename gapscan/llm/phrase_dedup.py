"""Exact removal of repeated phrases, found by sharded Aho-Corasick automata over words.

Equal texts are one text with a number of copies. Each window of SIZE words has an anchor, the run of ANCHOR
words with the smallest hash in it; equal windows have equal anchors. Neighbouring windows with one
anchor form a stretch. Stretches whose anchor occurs again are collapsed to the different ones, and what recurs among their
windows is confirmed by keyed digests. The confirmed windows are dealt by anchor to shards of bounded size; a
shard compiles the cores of its windows, as sequences of word numbers, into an automaton, and all different stretches
of its anchors stream through it. The occurrences located go back to every text that holds the stretch.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapscan.llm.common import PIECE_BYTES, discard, prefix_hashes, range_hashes, sequence_hashes, written

SIZE = 35
ANCHOR = 8
#: Windows that one automaton holds about, and windows of one anchor beyond which they are dealt to several shards.
SHARD_WINDOWS, ANCHOR_WINDOWS = 20_000, 20_000
#: Stretches of one anchor that stream through one copy of its windows.
STREAMED = 20_000
#: Bytes of words that are worked on at once; longer texts are taken in overlapping parts.
PART_BYTES = PIECE_BYTES // 2
#: More than the words that are worked on at once: as many low bits of a hash give way to its place, the same for all batches.
PLACES = 1 << 22

# What stands between words (space, tab, line feed, vertical tab, form feed, carriage return).
BETWEEN = b" \t\n\x0b\x0c\r"


def parts_of(text: bytes, overlap: int) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first word, words) of a text; of a long one in parts that share `overlap` words with the next."""
    if len(text) <= 2 * PART_BYTES:
        yield 0, text.split()
        return
    first, held, at = 0, [], 0
    while at < len(text):
        to = min(len(text), at + PART_BYTES)
        while to < len(text) and text[to] not in BETWEEN:
            to += 1
        held += text[at:to].split()
        at = to
        if at >= len(text) or len(held) > 2 * overlap:
            yield first, held
            first += max(0, len(held) - overlap)
            held = held[max(0, len(held) - overlap) :] if overlap else []


def _texts(column: pa.Array) -> list[bytes]:
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


class Parts:
    """Parts of texts laid end to end, a space between words."""

    def __init__(self, runs: list[tuple[int, int, list[bytes]]]):
        self.text = np.array([r[0] for r in runs], np.int64)
        self.offset = np.array([r[1] for r in runs], np.int64)
        words = [w for r in runs for w in r[2]]
        self.first = np.concatenate([[0], np.cumsum([len(r[2]) for r in runs])]).astype(np.int64)
        self.joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths

    def stretches(self, size: int, anchor: int) -> tuple[np.ndarray, ...]:
        """(anchor's hash, part, first word, number of windows) of all stretches; words count from the first part's on."""
        n = len(self.starts) - size + 1
        if n <= 0:
            return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
        hashes = range_hashes(prefix_hashes(np.frombuffer(self.joined, np.uint8)), self.starts, self.ends)
        runs = sequence_hashes(hashes, anchor)
        bits = np.uint64(PLACES - 1)
        if len(runs) >= PLACES:
            raise ValueError("too many words at once")
        least = runs & ~bits | np.arange(len(runs), dtype=np.uint64)
        width, reach = size - anchor + 1, 1
        while reach * 2 <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if width > reach:
            least = np.minimum(least[: reach - width], least[width - reach :])
        owner = np.repeat(np.arange(len(self.text)), np.diff(self.first))
        cut = np.ones(n + 1, bool)
        cut[1:n] = (least[1:n] != least[: n - 1]) | (owner[1:n] != owner[: n - 1])
        whole = owner[:n] == owner[size - 1 :]
        cut[1:n] |= whole[1:] != whole[:-1]
        at = np.flatnonzero(cut)
        start, count = at[:-1], np.diff(at)
        keep = whole[start]
        start, count = start[keep], count[keep]
        return runs[(least[start] & bits).astype(np.int64)], owner[start], start, count


STRETCHES = "anchor bigint, content bigint, tid bigint, start bigint, count int, copies bigint"


def digests(texts: Iterable[bytes], key: bytes) -> np.ndarray:
    """64 bits of each under a key that is drawn for the run, so that none can be made to collide; they are only compared within one anchor."""
    return np.frombuffer(b"".join([blake2b(text, digest_size=8, key=key).digest() for text in texts]), np.int64)


def _stretches(size: int, anchor: int, secret: bytes):
    names = [x.split()[0] for x in STRETCHES.split(", ")]

    def rows(runs: list, copies: list) -> pa.RecordBatch:
        parts = Parts(runs)
        anchors, of, start, count = parts.stretches(size, anchor)
        begin, end = parts.starts[start].tolist(), parts.ends[start + count + size - 2].tolist()
        contents = digests((parts.joined[a:b] for a, b in zip(begin, end, strict=True)), secret)
        columns = [
            pa.array(anchors.view(np.int64)), pa.array(contents), pa.array(parts.text[of]), pa.array(parts.offset[of] + start - parts.first[of]),
            pa.array(count.astype(np.int32)), pa.array(np.array(copies, np.int64)[of]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, copies, held = [], [], 0
            for tid, text, n in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                for offset, words in parts_of(text, size - 1):
                    if len(words) < size:
                        continue
                    runs.append((tid, offset, words))
                    copies.append(n)
                    held += sum(map(len, words)) + len(words)
                    if held >= PART_BYTES:
                        yield rows(runs, copies)
                        runs, copies, held = [], [], 0
            if runs:
                yield rows(runs, copies)

    return run


def _contents(size: int):
    """The words of the wanted stretches of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for text, wanted in zip(_texts(batch.column(0)), (x.as_py() for x in batch.column(1)), strict=True):
                wanted.sort(key=lambda w: w["start"])
                k = 0
                for offset, words in parts_of(text, 2 * size):
                    while k < len(wanted) and wanted[k]["start"] + wanted[k]["count"] + size - 1 <= offset + len(words):
                        w = wanted[k]
                        at = w["start"] - offset
                        cut = b" ".join(words[at : at + w["count"] + size - 1])
                        out.append((w["anchor"], w["content"], w["n"], w["differ"], cut))
                        held += len(cut)
                        k += 1
                    if held >= PART_BYTES:
                        yield _as_batch(out, CONTENTS)
                        out, held = [], 0
            if out:
                yield _as_batch(out, CONTENTS)

    return run


KINDS = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()), "string": pa.string()}


def _as_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split(" ") for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


CONTENTS = "anchor bigint, content bigint, n bigint, differ boolean, words binary"
WINDOWS = "anchor bigint, content bigint, n bigint, place int, window bigint"


def _windows(size: int, secret: bytes):
    """Digests of the windows of each stretch."""
    names = [x.split()[0] for x in WINDOWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                held = [text.split(b" ") for text in part.column(3).to_pylist()]
                counts = np.array([len(words) - size + 1 for words in held], np.int64)
                owner = pa.array(np.repeat(np.arange(len(held)), counts))
                place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                found = digests((b" ".join(words[k : k + size]) for words in held for k in range(len(words) - size + 1)), secret)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(k).take(owner) for k in range(3)], pa.array(place.astype(np.int32)), pa.array(found)], names=names
                )

    return run


class Phrases:
    """Recurring windows of equal length: an automaton over word numbers finds their cores, the windows around are confirmed.

    Neighbouring windows make a passage, and passages are cut into cores of half a window, so that every window holds
    a whole one: the automaton has as many nodes as passages have words, not as windows have.
    """

    def __init__(self, size: int):
        self.size, self.core = size, (size + 1) // 2
        self.numbers: dict[bytes, int] = {}
        self.windows: set[tuple] = set()
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)

    def add(self, words: list[bytes], places: list[int]) -> None:
        """The windows that begin at these places, ascending."""
        numbers = self.numbers
        spelled = [numbers.setdefault(w, len(numbers) + 1) for w in words]
        first = last = None
        for k in places:
            self.windows.add(tuple(spelled[k : k + self.size]))
            if last is None or k > last + 1:
                if last is not None:
                    self._cores(spelled[first : last + self.size])
                first = k
            last = k
        if last is not None:
            self._cores(spelled[first : last + self.size])

    def _cores(self, passage: list[int]) -> None:
        for at in range(0, len(passage) - self.core + 1, self.core):
            self.automaton.add_word(tuple(passage[at : at + self.core]), 1)

    def compiled(self) -> Phrases:
        self.automaton.make_automaton()
        return self

    def locate(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """Merged runs of words under occurrences, as starts and ends."""
        if not len(self.automaton):
            return [], []
        known, size, windows = self.numbers.get, self.size, self.windows
        spelled = tuple([known(w, 0) for w in words])
        starts, ends, seen = [], [], 0
        for last, _ in self.automaton.iter(spelled):
            # all windows around this core that no earlier core had
            for a in range(max(seen, last + 1 - size), min(last + 1 - self.core, len(spelled) - size) + 1):
                if spelled[a : a + size] in windows:
                    if ends and a <= ends[-1]:
                        ends[-1] = a + size
                    else:
                        starts.append(a)
                        ends.append(a + size)
            seen = max(seen, last + 2 - self.core)
        return starts, ends


LOCATED = "anchor bigint, content bigint, run_starts array<int>, run_ends array<int>"


def _locate(size: int):
    """Rows of a shard: the windows that are to be found (kind 0) first, then the stretches that may hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, phrases, filling, out = None, None, False, []
        for batch in batches:
            for number, kind, anchor, content, places, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != shard:
                    shard, phrases, filling = number, Phrases(size), True
                words = text.split(b" ")
                if kind == 0:
                    phrases.add(words, range(len(words) - size + 1) if places is None else sorted(places))
                    continue
                if filling:
                    phrases.compiled()
                    filling = False
                starts, ends = phrases.locate(words)
                if starts:
                    out.append((anchor, content, starts, ends))
                if len(out) >= 4096:
                    yield _as_batch(out, LOCATED)
                    out = []
        if out:
            yield _as_batch(out, LOCATED)

    return run


REMOVED = "digest binary, n_words bigint, starts array<bigint>, ends array<bigint>, kept string"


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, held = [], 0
        for digest, text, spans in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), (x.as_py() for x in batch.column(2)), strict=True):
            starts, ends = [], []
            for span in sorted(spans or [], key=lambda s: s["a"]):
                if ends and span["a"] <= ends[-1]:
                    ends[-1] = max(ends[-1], span["b"])
                else:
                    starts.append(span["a"])
                    ends.append(span["b"])
            kept, n, k = [], 0, 0
            for offset, words in parts_of(text, 0):
                at = 0
                while k < len(starts) and starts[k] < offset + len(words):
                    kept += words[at : max(0, starts[k] - offset)]
                    at = ends[k] - offset
                    if at > len(words):  # goes on in the next part
                        break
                    k += 1
                kept += words[at:]
                n = offset + len(words)
                kept = [b" ".join(kept)] if kept else []
            out.append((digest, n, starts, ends, b"".join(kept).decode()))
            held += len(text)
            if held >= PART_BYTES:
                yield _as_batch(out, REMOVED)
                out, held = [], 0
        if out:
            yield _as_batch(out, REMOVED)


def remove_phrases(docs: DataFrame, size: int = SIZE, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): (doc_id, digest) of each row of docs, and of each different text (digest, n_words, starts, ends, kept).

    Words are runs of bytes other than ASCII white space, unchanged. A word goes if a window of `size` consecutive
    words over it also starts anywhere else, in this or another document. starts and ends are the removed runs of words,
    kept the words that stay, with a space between. Null texts count as empty; texts of fewer than `size` words stay whole;
    repeated rows are documents of their own, so each is the other's copy, whatever their ids. Null ids keep their rows. Long texts are
    taken in parts that overlap by a window; a single word is never cut. An empty table gives no rows; other columns are ignored.
    """
    secret = os.urandom(16)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))
    texts = rows.groupBy("digest").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    texts = written(texts.withColumn("tid", F.monotonically_increasing_id()))
    found = written(texts.select("tid", "text", "copies").mapInArrow(_stretches(size, anchor, secret), STRETCHES))
    # a table of its own, so that Spark can split an anchor that is very frequent on the other side of the join
    again = written(found.groupBy("anchor").agg(F.sum("copies").alias("n")).where("n > 1").select("anchor"))
    candidates = written(found.join(again, "anchor").select("anchor", "content", "tid", "start", "count", "copies"))
    discard(found, again)
    different = candidates.groupBy("anchor", "content").agg(F.sum("copies").alias("n"), F.min(F.struct("tid", "start", "count")).alias("one"))
    distinct = written(different)
    several = distinct.groupBy("anchor").agg((F.count("*") > 1).alias("differ"))
    different = distinct.join(several, "anchor")
    wanted = F.struct("anchor", "content", "n", "differ", F.col("one.start").alias("start"), F.col("one.count").alias("count"))
    wanted = different.groupBy(F.col("one.tid").alias("tid")).agg(F.collect_list(wanted).alias("wanted"))
    stretches = written(texts.select("tid", "text").join(wanted, "tid").select("text", "wanted").mapInArrow(_contents(size), CONTENTS))
    # windows that recur, each with one stretch that holds it; of a lone content all do
    windows = lambda of: of.select("anchor", "content", "n", "words").mapInArrow(_windows(size, secret), WINDOWS)
    recurring = windows(stretches.where("differ")).groupBy("anchor", "window").agg(F.sum("n").alias("n"), F.min(F.struct("content", "place")).alias("one")).where("n > 1")
    recurring = written(recurring.select("anchor", "window", F.col("one.content").alias("content"), F.col("one.place").alias("place")))
    discard(distinct)
    # a crowded anchor's windows are dealt to blocks, and its stretches to copies of these
    held = stretches.groupBy("anchor").agg(F.count("*").alias("held"))
    crowded = held.join(recurring.groupBy("anchor").agg(F.count("*").alias("n")), "anchor", "left").selectExpr("anchor", "held", f"coalesce(n, 0) div {ANCHOR_WINDOWS} + 1 as blocks")
    most = size - anchor + 1
    crowded = crowded.selectExpr("anchor", "blocks", f"if(blocks = 1, held, {most} * held div blocks) div {STREAMED} + 1 as salts").where("blocks > 1 or salts > 1")
    crowded = written(crowded)
    block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("window"), "blocks")).otherwise(F.lit(0)).alias("block")
    of = recurring.join(crowded, "anchor", "left").select("anchor", "content", "place", block, "salts")
    of = of.groupBy("anchor", "content", "block", "salts").agg(F.collect_list("place").alias("places"))
    phrases = of.join(stretches.select("anchor", "content", "words"), ["anchor", "content"])
    lone = stretches.where("not differ").select("anchor", "content", F.lit(0).cast("bigint").alias("block"), F.lit(None).cast("bigint").alias("salts"), F.lit(None).cast("array<int>").alias("places"), "words")
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")
    phrases = phrases.select("anchor", "content", F.col("block").cast("bigint").alias("block"), each, "places", "words").unionByName(
        lone.select("anchor", "content", "block", each, "places", "words")
    )
    # a stretch passes the blocks that its windows are dealt to
    salt = F.pmod(F.xxhash64("content"), "salts").alias("salt")
    crowd = crowded.where("blocks > 1")
    split = windows(stretches.where("differ").join(crowd, "anchor", "left_semi")).join(crowd, "anchor").select("anchor", "content", F.pmod(F.xxhash64("window"), "blocks").alias("block"), salt).distinct()
    split = split.join(stretches.select("anchor", "content", "words"), ["anchor", "content"])
    plain = stretches.join(crowded, "anchor", "left").where("coalesce(blocks, 1) = 1")
    plain = plain.select("anchor", "content", F.lit(0).cast("bigint").alias("block"), F.coalesce(F.pmod(F.xxhash64("content"), "salts"), F.lit(0)).alias("salt"), "words")
    streamed = plain.unionByName(split.select("anchor", "content", "block", "salt", "words")).withColumn("places", F.lit(None).cast("array<int>"))
    both = phrases.withColumn("kind", F.lit(0)).unionByName(streamed.withColumn("kind", F.lit(1)))
    total = recurring.count() + (stretches.where("not differ").agg(F.count("*")).first()[0] or 0) * most // 2
    shard = F.pmod(F.xxhash64("anchor", "block", "salt"), F.lit(total // SHARD_WINDOWS + 1)).alias("shard")
    both = both.select(shard, "kind", "anchor", "content", "places", "words").repartition("shard").sortWithinPartitions("shard", "kind")
    located = written(both.mapInArrow(_locate(size), LOCATED))
    discard(stretches, recurring, crowded)
    # back to every text that holds a stretch
    runs = located.select("anchor", "content", F.explode(F.arrays_zip("run_starts", "run_ends")).alias("run"))
    spans = candidates.select("anchor", "content", "tid", "start").join(runs, ["anchor", "content"])
    spans = spans.select("tid", F.struct((F.col("start") + F.col("run.run_starts")).alias("a"), (F.col("start") + F.col("run.run_ends")).alias("b")).alias("span"))
    spans = spans.groupBy("tid").agg(F.collect_list("span").alias("spans"))
    removed = texts.select("tid", "digest", "text").join(spans, "tid", "left").select("digest", "text", "spans").mapInArrow(_remove, REMOVED)
    return rows.select("doc_id", "digest"), removed
