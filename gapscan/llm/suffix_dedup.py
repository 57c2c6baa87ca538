"""Exact removal of repeated byte strings by a Burrows-Wheeler transform per shard.

Each string of SPAN bytes has an anchor, the substring of ANCHOR bytes with the smallest
hash in it; equal strings have equal anchors. Neighbouring strings with one anchor form a segment. Only
segments whose anchor occurs again can hold a repeat. Equal segments are counted and
kept once; different ones with the same anchor meet in a shard, where a transform of all of them is
indexed: a breadth-first backward extension of its intervals gives the longest common
prefixes of neighbouring suffixes in increasing order, and stops at SPAN. What is
unresolved then is repeated. The runs found go back to all occurrences of a segment and are merged per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapscan.llm.common import PIECE_BYTES, buffers, mix, pieces, powers, prefix_hashes, written

SPAN = 200
ANCHOR = 40
#: Bytes of segments that are indexed together; anchors are not divided.
SHARD_BYTES = 1 << 20
#: Different segments with one anchor beyond which each string is counted by itself.
HOT_SEGMENTS = 20_000
UNKNOWN = 32767
#: More than the bytes that are worked on at once.
PLACES = 4 * PIECE_BYTES


def segments(data: np.ndarray, offsets: np.ndarray, span: int = SPAN, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(anchor's hash, start, number of strings, text) of all segments of texts laid end to end."""
    n = len(data) - span + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    sums = prefix_hashes(data)
    _, down = powers(len(sums))
    hashes = mix((sums[anchor:] - sums[:-anchor]) * down[: len(sums) - anchor])
    # the place in the low bits: of equal ones the first counts, and it is known where it stands
    least = hashes & ~np.uint64(PLACES - 1) | np.arange(len(hashes), dtype=np.uint64)
    width, reach = span - anchor + 1, 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if width > reach:
        least = np.minimum(least[: reach - width], least[width - reach :])
    inside = np.zeros(n + 1, np.int32)
    sizes = np.diff(offsets)
    long = sizes >= span
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - span + 1, -1)
    whole = np.cumsum(inside[:n]) > 0
    cut = np.ones(n + 1, bool)
    cut[1:n] = (least[1:] != least[:-1]) | (whole[1:] != whole[:-1])
    cut[offsets[offsets < n]] = True
    at = np.flatnonzero(cut)
    start, count = at[:-1], np.diff(at)
    keep = whole[start]
    start, count = start[keep], count[keep]
    anchors = hashes[(least[start] & np.uint64(PLACES - 1)).astype(np.int64)]
    return anchors, start, count, np.searchsorted(offsets, start, "right") - 1


def _segment_rows(span: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "content", "digest", "start", "count"]

        def rows(part, data, found, start):
            raw, at = data.tobytes(), found[1].tolist()
            ends = (found[1] + found[2] + span - 1).tolist()
            contents = b"".join([hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(at, ends, strict=True)])
            return pa.RecordBatch.from_arrays(
                [pa.array(found[0].view(np.int64)), pa.array(np.frombuffer(contents, np.int64)), part.column(0).take(pa.array(found[3])),
                 pa.array(start), pa.array(found[2].astype(np.int32))], names=names,
            )

        for batch in batches:
            for part in pieces(batch, "text"):
                data, offsets = buffers(part.column(1))
                if part.num_rows > 1 or len(data) <= 2 * PIECE_BYTES:
                    found = segments(data, offsets, span, anchor)
                    yield rows(part, data, found, found[1] - offsets[found[3]])
                    continue
                for at in range(0, len(data), PIECE_BYTES):  # one long text, in stretches of strings
                    slice_ = data[at : at + PIECE_BYTES + span - 1]
                    found = segments(slice_, np.array([0, len(slice_)]), span, anchor)
                    yield rows(part, slice_, found, found[1] + at)

    return run


def order_of_suffixes(text: np.ndarray, length: int) -> np.ndarray:
    """Suffixes in the order of their first `length` bytes at least."""
    n = len(text)
    key = text.astype(np.uint64)
    for step in (1, 2, 4):
        later = np.zeros(n, np.uint64)
        later[: max(0, n - step)] = key[step:]
        key = key << np.uint64(8 * step) | later
    reach = 8
    while True:
        order = np.argsort(key)
        ordered = key[order]
        new = np.ones(n, np.int64)
        new[1:] = ordered[1:] != ordered[:-1]
        ranks = np.cumsum(new)
        if reach >= length or ranks[-1] == n:
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = ranks
        later = np.zeros(n, np.uint64)
        later[: max(0, n - reach)] = rank[reach:]
        key = rank << np.uint64(32) | later
        reach *= 2


def common_prefixes(last: np.ndarray, length: int) -> np.ndarray:
    """Common prefixes of neighbouring suffixes from their transform; UNKNOWN where they reach `length`.

    Level by level: if suffixes b - 1 and b first differ after l bytes, then so do, after
    l + 1, those that have one more byte in front: for each byte that precedes some suffix from b on
    within its interval, the suffix that follows from the first of them.
    """
    n = len(last)
    sorted_places = np.argsort(last, kind="stable")
    front = np.empty(n, np.int64)  # where the suffix with the preceding byte stands
    front[sorted_places] = np.arange(n)
    previous = np.full(n, -1, np.int64)  # the last place before with the same byte
    same = last[sorted_places[1:]] == last[sorted_places[:-1]]
    previous[sorted_places[1:][same]] = sorted_places[:-1][same]
    out = np.full(n + 1, UNKNOWN, np.int16)
    counts = np.bincount(last, minlength=256)
    firsts = np.cumsum(counts) - counts
    present = np.flatnonzero(counts)
    fresh = firsts[present]
    out[fresh] = 0
    out[n] = -1
    for level in range(1, length):
        found = []
        begin, place = fresh, fresh
        for step in range(48):
            new = front[place[previous[place] < begin]]
            new = new[out[new] == UNKNOWN]
            out[new] = level
            found.append(new)
            place = place + 1
            on = out[place] >= level
            begin, place = begin[on], place[on]
            if not len(begin):
                break
        else:  # wide intervals: the first place of each byte by rank
            for byte in present:
                of = sorted_places[firsts[byte] : firsts[byte] + counts[byte]]
                rank = np.searchsorted(of, begin)
                new = np.unique(firsts[byte] + rank[rank < len(of)])
                new = new[out[new] == UNKNOWN]
                out[new] = level
                found.append(new)
        fresh = np.concatenate(found)
        if not len(fresh):
            break
    return out[:n]


def repeated_starts(parts: list[bytes], span: int = SPAN) -> list[np.ndarray]:
    """For each part, which strings of `span` bytes are also elsewhere in these parts."""
    text = np.frombuffer(b"".join(p + b"\xff" for p in parts), np.uint8)
    order = order_of_suffixes(text, span)
    prefixes = common_prefixes(text[order - 1], span)
    alike = prefixes == UNKNOWN
    either = alike.copy()
    either[:-1] |= alike[1:]
    repeated = np.zeros(len(text), bool)
    repeated[order[either]] = True
    out, at = [], 0
    for p in parts:
        out.append(repeated[at : at + len(p) - span + 1])
        at += len(p) + 1
    return out


def runs_of(mask: np.ndarray) -> tuple[list[int], list[int]]:
    change = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist()


RUNS = "anchor bigint, content bigint, run_starts array<int>, run_ends array<int>"


def _index(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; all segments of some whole anchors are indexed at once."""
        waiting: list[tuple] = []
        size, key = 0, None

        def done() -> pa.RecordBatch:
            found = [runs_of(x) for x in repeated_starts([w[2] for w in waiting], span)]
            columns = [[w[0] for w in waiting], [w[1] for w in waiting], [f[0] for f in found], [f[1] for f in found]]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["anchor", "content", "run_starts", "run_ends"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != key and size >= SHARD_BYTES:
                    yield done()
                    size = 0
                key = row[0]
                waiting.append(row)
                size += len(row[2])
        if waiting:
            yield done()

    return run


def _contents(span: int):
    """Bytes of the wanted segments of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                data, offsets = buffers(part.column(0))
                wanted = part.column(1)
                counts = np.diff(wanted.offsets.to_numpy())
                fields = wanted.flatten()
                anchor, content, start, count = (fields.field(k) for k in ("anchor", "content", "start", "count"))
                at = np.repeat(offsets[:-1], counts) + start.to_numpy()
                ends = at + count.to_numpy() + span - 1
                cut = pa.array([data[a:b].tobytes() for a, b in zip(at.tolist(), ends.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([anchor, content, cut], names=["anchor", "content", "bytes"])

    return run


def _digests_of_strings(span: int):
    """One row for each string of a hot anchor's segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                anchor, content, texts = (c.to_pylist() for c in batch.slice(at, 256).columns)
                rows = [(a, c, k, hashlib.blake2b(t[k : k + span], digest_size=16).digest()) for a, c, t in zip(anchor, content, texts, strict=True) for k in range(len(t) - span + 1)]
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["anchor", "content", "at", "digest"])

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            data, offsets = buffers(part.column(1))
            starts, ends, kept = [], [], []
            for i, spans in enumerate(part.column(2).to_pylist()):
                own = data[offsets[i] : offsets[i + 1]]
                s, e = [], []
                if spans:
                    mask = np.zeros(len(own) + 1, np.int32)
                    np.add.at(mask, [x["a"] for x in spans], 1)
                    np.add.at(mask, [x["b"] for x in spans], -1)
                    gone = np.cumsum(mask[:-1]) > 0
                    s, e = runs_of(gone)
                    own = own[~gone]
                starts.append(s)
                ends.append(e)
                kept.append(own.tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(offsets)), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "starts", "ends", "kept"],
            )


def remove_repeats(docs: DataFrame, span: int = SPAN, anchor: int = ANCHOR, hot: int = HOT_SEGMENTS) -> DataFrame:
    """(doc_id, n_bytes, starts, ends, kept) of each document: removed byte ranges and the bytes that stay.

    A byte goes if a string of `span` bytes over it also starts anywhere else, in this or another
    document. Null texts count as empty; texts shorter than `span` stay whole; a long text is taken in stretches; repeated rows are
    documents of their own, so each is the other's copy, whatever their ids. Null ids keep their rows; an empty table gives no
    rows; other columns are ignored.
    """
    # a text is known by its digest, whatever ids its rows have
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("digest", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))
    schema = "anchor bigint, content bigint, digest binary, start bigint, count int"
    found = written(texts.select("digest", "text").mapInArrow(_segment_rows(span, anchor), schema))
    # anchors that occur again, and whether with different segments
    again = found.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("content") < F.max("content")).alias("differ")).where("n > 1")
    # as a table of its own, so that Spark can split an anchor that is very frequent on the other side of the join
    again = written(again.select("anchor", "differ"))
    candidates = written(found.join(again, "anchor"))
    different = written(
        candidates.where("differ").groupBy("anchor", "content").agg(
            F.count("*").alias("n"), F.min(F.struct("digest", "start", "count")).alias("one")
        )
    )
    crowded = different.groupBy("anchor").agg(F.count("*").alias("segments")).where(F.col("segments") > hot).select("anchor")
    wanted = different.groupBy(F.col("one.digest").alias("digest")).agg(
        F.collect_list(F.struct("anchor", "content", F.col("one.start").alias("start"), F.col("one.count").alias("count"))).alias("wanted")
    )
    contents = texts.join(wanted, "digest").select("text", "wanted").mapInArrow(_contents(span), "anchor bigint, content bigint, bytes binary")
    contents = written(contents.dropDuplicates(["anchor", "content"]))
    usual = contents.join(crowded, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor", "content")
    runs = usual.mapInArrow(_index(span), RUNS)
    strings = contents.join(crowded, "anchor").mapInArrow(_digests_of_strings(span), "anchor bigint, content bigint, at int, digest binary")
    twice = strings.groupBy("anchor", "digest").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "digest")
    single = strings.join(twice, ["anchor", "digest"]).select("anchor", "content", F.array("at").alias("run_starts"), F.array(F.expr("at + 1")).alias("run_ends"))
    partial = runs.unionByName(single).where("size(run_starts) > 0")
    # all strings of a segment that occurs twice are repeated, of others those in the runs
    whole = candidates.where("not differ").select("digest", "start", "count")
    several = candidates.where("differ").join(different.select("anchor", "content", "n"), ["anchor", "content"])
    whole = whole.unionByName(several.where("n > 1").select("digest", "start", "count"))
    whole = whole.select("digest", F.col("start").alias("a"), (F.col("start") + F.col("count") + span - 1).alias("b"))
    parts = several.where("n = 1").join(partial, ["anchor", "content"]).select("digest", "start", F.explode(F.arrays_zip("run_starts", "run_ends")).alias("run"))
    parts = parts.select("digest", (F.col("start") + F.col("run.run_starts")).alias("a"), (F.col("start") + F.col("run.run_ends") + span - 1).alias("b"))
    # copies of a text give equal spans, so a list is as long as its text has segments, whatever the number of copies
    spans = whole.unionByName(parts).groupBy("digest").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    return texts.join(spans, "digest", "left").select("doc_id", "text", "spans").mapInArrow(
        _remove, "doc_id bigint, n_bytes bigint, starts array<bigint>, ends array<bigint>, kept binary"
    )
