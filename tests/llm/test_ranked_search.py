"""Ranked search against a plain scan that scores every document by the formula."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

import cases
from gapscan.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(documents, items):
    """All (score, doc_id) above 0 of each item, best first."""
    bags = []
    for doc_id, text in documents:
        terms = TERM.findall((text or "").translate(LOWER))
        if terms:
            bags.append((doc_id, len(terms), {t: terms.count(t) for t in set(terms)}))
    n, total = len(bags), sum(b[1] for b in bags)
    out = []
    for item_id, text in items:
        asked, found = TERM.findall((text or "").translate(LOWER)), []
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in b[2] for b in bags) + 1))) for t in set(asked)}
        for doc_id, size, bag in bags:
            m = 25 + 75 * size * n // total
            score = sum(weight[t] * (1000000000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in asked if t in bag)
            if score > 0:
                found.append((-score, doc_id is None, doc_id, score))
        out += [(item_id, k, doc_id, score) for k, (_, _, doc_id, score) in enumerate(sorted(found, key=lambda x: x[:2] + (x[2] or 0,))[:10], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()], key=repr)


ITEMS = [(1, cases.prose(3, 12)), (2, "ONE two, two TWO"), (3, None), (4, ""), (5, "?!"), (6, "nowheretobefound"), (7, "Ünïcödé it's ½ 日本語"), (8, cases.prose(2, 40)), (8, cases.prose(1, 9)), (None, "ab x")]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, 0.5, "own") for i, t in ITEMS], "item_id bigint, text string, score double, rank string")


def test_search_equals_a_plain_scan(spark, items):
    docs, texts = cases.documents(spark)
    expected = plain(texts, [x for x in ITEMS if x[1]])
    assert rows(ranked_search.search(docs, items)) == expected
    assert len(expected) > 30


def test_small_blocks_segments_and_tasks_change_nothing(spark, items, monkeypatch):
    docs, texts = cases.documents(spark)
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", 200)
    monkeypatch.setattr(ranked_search, "DOCS_A_TASK", 4)
    monkeypatch.setattr(ranked_search, "POSTINGS_A_PART", 50)
    monkeypatch.setattr(ranked_search, "SEGMENT_DOCS", 3)
    assert rows(ranked_search.search(docs, items)) == plain(texts, [x for x in ITEMS if x[1]])


def test_equal_documents_come_by_id(spark, items):
    texts = [(i, "one two three") for i in range(300, 0, -1)] + [(None, "one two three"), (0, "one one two")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(7)
    assert rows(ranked_search.search(docs, items)) == plain(texts, [x for x in ITEMS if x[1]])


def test_empty_tables(spark, items):
    docs, _ = cases.documents(spark)
    assert rows(ranked_search.search(docs.limit(0), items)) == []
    assert rows(ranked_search.search(docs, items.limit(0))) == []
    assert [f.name for f in ranked_search.search(docs, items.limit(0)).schema] == ["item_id", "rank", "doc_id", "score"]


def test_a_long_text_is_counted_in_stretches(spark, items, monkeypatch):
    texts = [(1, cases.prose(2, 9000) * 60), (2, "one two"), (3, "y" * 5_000_000 + " one")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert rows(ranked_search.search(docs, items)) == plain(texts, [x for x in ITEMS if x[1]])
    data = np.frombuffer(("word " * 50 + "z" * 100).encode(), np.uint8)
    parts = list(ranked_search.stretches(data, 7))
    assert np.array_equal(np.concatenate(parts), data) and max(map(len, parts)) <= 110


def test_terms_with_one_hash_are_told_apart(monkeypatch):
    from gapscan.llm.common import Words

    vocabulary = ranked_search.Vocabulary([b"ab", b"abc", b"cd"])
    vocabulary.keys[:] = 7
    words = Words(pa.array([b"cd xy abc ab abd"], pa.binary()))
    words.hashes[:] = 7
    assert vocabulary.find(words).tolist() == [2, -1, 1, 0, -1]
