"""URL rules in a sorted digest array.

Each rule is a host and the start of a path. The array holds the 64-bit xxhash of every
rule's string, sorted; a url's candidates (its host and all parent domains, with those
starts of its path that are as long as some rule's) are hashed, a batch of urls is probed
with one vectorised binary search, and a hit counts only if the stored string is equal. The
array lies in a memory map, which tasks of a worker share.
Rules are taken in blocks of bounded size, each broadcast by itself. No shuffle.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of rules in a broadcast block.
BLOCK_BYTES = 16 << 20

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class DigestArray:
    """Sorted digests with offsets into the stored strings, in one anonymous memory map."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        strings = [f"{host}{path}".encode() for host, path, _ in rules]
        digests = np.array([xxhash.xxh64_intdigest(s) for s in strings], np.uint64)
        order = np.argsort(digests, kind="stable")
        self.n = len(rules)
        lengths = np.array([len(strings[i]) for i in order], np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        blob = b"".join(strings[i] for i in order)
        parts = [digests[order].tobytes(), offsets.tobytes(), blob]
        self.map = mmap.mmap(-1, max(1, sum(map(len, parts))))
        self.map.write(b"".join(parts))
        self.keys = np.frombuffer(self.map, np.uint64, self.n)
        self.offsets = np.frombuffer(self.map, np.int64, self.n + 1, 8 * self.n)
        self.blob_at = 8 * self.n + 8 * (self.n + 1)
        self.actions = [rules[i][2] for i in order]
        #: How much of a stored string is the host.
        self.hosts = [len(rules[i][0].encode()) for i in order]
        self.widths = sorted({len(path) for _, path, _ in rules})

    def stored(self, i: int) -> bytes:
        return self.map[self.blob_at + int(self.offsets[i]) : self.blob_at + int(self.offsets[i + 1])]

    def probe(self, candidates: list[tuple[bytes, int]]) -> np.ndarray:
        """For each (string, length of its host) the place of the equal rule, or -1."""
        digests = np.array([xxhash.xxh64_intdigest(s) for s, _ in candidates], np.uint64)
        at = np.searchsorted(self.keys, digests)
        out = np.full(len(candidates), -1, np.int64)
        for i in np.flatnonzero((at < self.n) & (self.keys[np.minimum(at, self.n - 1)] == digests)) if self.n else []:
            k = int(at[i])
            while k < self.n and self.keys[k] == digests[i]:
                if self.hosts[k] == candidates[i][1] and self.stored(k) == candidates[i][0]:
                    out[i] = k
                    break
                k += 1
        return out


def candidates_of(host: str, path: str, widths: list[int]) -> Iterator[tuple[bytes, int]]:
    """The strings of all rules that would fit this url."""
    at = 0
    while True:
        domain = host[at:].encode()
        for width in widths:
            if width > len(path):
                break
            yield domain + path[:width].encode(), len(domain)
        at = host.find(".", at) + 1
        if not at:
            return


def _pass(sent, names: list[str]):
    host_at, path_at, rule_at, action_at = (names.index(x) for x in ("host", "path", "rule", "action"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = None
        for batch in batches:
            array = array or DigestArray(sent.value)
            strings, owners = [], []
            for i, (host, path) in enumerate(zip(batch.column(host_at).to_pylist(), batch.column(path_at).to_pylist(), strict=True)):
                if host:
                    found = list(candidates_of(host, path, array.widths))
                    strings += found
                    owners += [i] * len(found)
            rules, actions = batch.column(rule_at).to_pylist(), batch.column(action_at).to_pylist()
            if strings:
                places = array.probe(strings)
                for k in np.flatnonzero(places >= 0):
                    i, place = owners[k], int(places[k])
                    rule = array.stored(place).decode()
                    if rules[i] is None or len(rule) > len(rules[i]):
                        rules[i], actions[i] = rule, array.actions[place]
            out = batch.set_column(rule_at, "rule", pa.array(rules, pa.string()))
            yield out.set_column(action_at, "action", pa.array(actions, pa.string()))

    return run


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """`pages` with host, path, rule and verdict.

    `rules` has host, path and action (allow or block). A rule fits its host and all
    subdomains where the path starts with the rule's; the longest wins (of equally long ones, that
    with the longest host). A url that no rule fits gets `otherwise`: absence from the array is the method's own answer.
    Urls of any length are taken whole. Null urls and those without `://` have an empty host and path, and no rule. Of equal
    rules with different actions block wins. Columns of `pages` with the name of an added one are replaced.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "action")
    names = pages.columns
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    out = (
        pages.withColumn("rest", F.coalesce(rest, F.lit("")))
        .withColumn("authority", F.regexp_extract("rest", r"^[^/?#]*", 0))
        .withColumn("path", F.regexp_extract(F.expr("substring(rest, length(authority) + 1)"), r"^[^?#]*", 0))
        .select(
            *names, F.translate("authority", UPPER, SMALL).alias("host"), "path",
            F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("action"),
        )
    )
    usable = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.max("action").alias("action"))
    total = usable.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 32)).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    for k in range(blocks):
        block = usable.where(F.pmod(F.xxhash64("host", "path"), F.lit(blocks)) == k).orderBy("host", "path").collect()
        sent = pages.sparkSession.sparkContext.broadcast([tuple(r) for r in block])
        out = out.mapInArrow(_pass(sent, out.columns), out.schema)
    return out.withColumn("verdict", F.coalesce("action", F.lit(otherwise))).drop("action")
