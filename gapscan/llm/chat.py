"""Chat formatting in budgeted windows.

Prefix sums of turn tokens cut a conversation into spans of whole turns. Each window
repeats the system turn and the last turns before it, as far as a history budget goes, and
trains only on assistant turns that no earlier window had. Prefix sums are taken in two
levels (within stretches of turns, then over the stretches' sums), so no step needs a whole
conversation in one task's memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of new turns in a window, and of repeated ones before them.
BUDGET, HISTORY = 1024, 256
#: Turns in a stretch of the first level.
STRETCH = 64

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
#: Control characters of the template; a backslash before them makes them text.
_CONTROL = re.compile(r"[\\#<:]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.)*+)</turn>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the escaped text) of each turn of a formatted window."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return out


def _turns(conversations: DataFrame) -> DataFrame:
    """Turns with the tokens before them, in order of turn, then role and text."""
    words = F.expr("regexp_count(body, '\\\\S+')") + 4  # the template's own marks count too
    rows = conversations.select(
        F.col("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("body"),
    ).withColumn("tokens", words.cast("bigint")).withColumn("stretch", F.expr(f"turn div {STRETCH}"))
    same = F.struct(F.col("conv_id").isNull(), F.coalesce("conv_id", F.lit(0)))
    rows = rows.withColumn("conv", same)
    order = ["turn", "role", "body"]
    within = Window.partitionBy("conv", "stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("conv", "stretch").agg(F.sum("tokens").alias("sum"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "conv", "stretch", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("sum_before"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"),
    )
    local = rows.withColumn("sum", F.sum("tokens").over(within)).withColumn("n", F.count("*").over(within))
    on = (F.col("a.conv") == F.col("b.conv")) & F.col("a.stretch").eqNullSafe(F.col("b.stretch"))
    return local.alias("a").join(sums.alias("b"), on).select(
        "a.conv", "a.conv_id", "role", "body", "tokens",
        (F.col("a.sum") + F.col("sum_before") - F.col("tokens")).alias("before"), (F.col("a.n") + F.col("n_before") - 1).alias("position"),
    )


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a window; rows come sorted by conversation and window, then in order of turns."""
    key, parts, out = None, [], []

    def done() -> None:
        if key is None:
            return
        text, starts, ends, new, at = [], [], [], 0, 0
        for role, body, kind in parts:
            head, tail = f"{OPEN}{escape(role)}{MIDDLE}", escape(body)
            if kind == 2:
                new += 1
                if role == "assistant":
                    starts.append(at + len(head))
                    ends.append(at + len(head) + len(tail))
            text += [head, tail, CLOSE]
            at += len(head) + len(tail) + len(CLOSE)
        out.append((*key, "".join(text), len(parts) - new, starts, ends))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["conv_id", "window", "formatted", "n_repeated", "loss_starts", "loss_ends"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for conv, window, role, body, kind in zip(*columns[:5], strict=True):
            if (conv, window) != key:
                done()
                key, parts = (conv, window), []
                if sum(len(r[2]) for r in out[-64:]) > 1 << 20 or len(out) >= 500:
                    yield flush()
                    out = []
            parts.append((role, body, kind))
    done()
    if out:
        yield flush()


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of all conversations: (conv_id, window, formatted, n_repeated, loss_starts, loss_ends).

    A turn belongs to window floor(tokens before it / budget). Those last turns of the window before
    it whose tokens up to its start fit into `history` are repeated in it, and so is a system turn at the conversation's start;
    repeated turns (the first n_repeated) are outside the loss spans, which are code points of `formatted`. A turn
    longer than the budget is kept whole. Turns are ordered by turn (null first), then role and text; null
    roles and texts count as empty; repeated rows are turns of their own; null conv_ids are one conversation.
    An empty table gives no windows; other columns are ignored.
    """
    turns = _turns(conversations).withColumn("window", F.expr(f"before div {budget}"))
    # where each window starts and which comes before it: a row a window
    windows = turns.groupBy("conv", "window").agg(F.min("before").alias("start"), F.first("conv_id").alias("conv_id"))
    order = Window.partitionBy("conv").orderBy("window")
    following = windows.select("conv", "window", F.lead("window").over(order).alias("next"), F.lead("start").over(order).alias("next_start"))
    # a window's own last turns go into the next one; a long turn between leaves no room for earlier ones
    columns = ["conv", "conv_id", "target", "position", "role", "body", "kind"]
    new = turns.select("conv", "conv_id", F.col("window").alias("target"), "position", "role", "body", F.lit(2).alias("kind"))
    repeated = (
        turns.join(following, ["conv", "window"])
        .where((F.col("next_start") - F.col("before") <= history) & ~((F.col("position") == 0) & (F.col("role") == "system")))
        .select("conv", "conv_id", F.col("next").alias("target"), "position", "role", "body", F.lit(1).alias("kind"))
    )
    system = turns.where("position = 0 and role = 'system'").select("conv", "role", "body")
    heads = windows.where("window > 0").join(system, "conv")
    heads = heads.select("conv", "conv_id", F.col("window").alias("target"), F.lit(-1).cast("bigint").alias("position"), "role", "body", F.lit(0).alias("kind"))
    rows = new.select(columns).unionByName(repeated.select(columns)).unionByName(heads.select(columns))
    dealt = rows.repartition("conv", "target").sortWithinPartitions("conv", "target", "position")
    schema = "conv_id bigint, window bigint, formatted string, n_repeated bigint, loss_starts array<bigint>, loss_ends array<bigint>"
    return dealt.select("conv_id", F.col("target").alias("window"), "role", "body", "kind").mapInArrow(_format, schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations, turn by turn as windows come in order: one window is in memory."""
    state: list | None = None

    def row(state: list) -> pa.RecordBatch:
        conv, n, turns, chars, loss, size = state
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        values = [conv, n, turns.hexdigest(), chars, loss.hexdigest(), size]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    def together(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(rows).combine_chunks().to_batches()[0]

    rows: list[pa.RecordBatch] = []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for conv, text, repeated, starts, ends in zip(*columns, strict=True):
            if state is None or state[0] != conv:
                if state is not None:
                    rows.append(row(state))
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if len(rows) >= 5000:
                    yield together(rows)
                    rows = []
            for role, body, _, _ in parse(text)[repeated:]:
                state[1] += 1
                state[2].update(f"{role}\n{body}\n".encode())
            for a, b in zip(starts, ends, strict=True):
                learnt = unescape(text[a:b])
                state[3] += len(learnt)
                state[4].update(learnt.encode())
            state[5] += len(text)
    if state is not None:
        rows.append(row(state))
    if rows:
        yield together(rows)


def read_back(windows: DataFrame) -> DataFrame:
    """A row for each conversation, from the formatted windows alone: what its turns and its loss mask hold.

    A digest of a conversation is sequential, so its windows stream through one task in order, one at a time.
    """
    key = F.struct(F.col("conv_id").isNull(), F.coalesce("conv_id", F.lit(0)))
    dealt = windows.withColumn("key", key).repartition("key").sortWithinPartitions("key", "window")
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return dealt.select("conv_id", "formatted", "n_repeated", "loss_starts", "loss_ends").mapInArrow(_digest, schema)
