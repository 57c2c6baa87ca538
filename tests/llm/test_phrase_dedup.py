"""Removal of repeated phrases against counting all windows."""

import random
from collections import Counter

import pytest

import cases
from gapscan.llm import phrase_dedup


def plain(texts, size=35):
    """(words, removed, kept) of each text."""
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def removed(docs, **options):
    rows, texts = phrase_dedup.remove_phrases(docs, **options)
    found = [(r.doc_id, r.n_words, sum(b - a for a, b in zip(r.starts, r.ends)), r.kept) for r in rows.join(texts, "digest").collect()]
    return sorted(found, key=repr)


def expected(texts, **options):
    return sorted([(i, *p) for (i, _), p in zip(texts, plain([t for _, t in texts], **options))], key=repr)


def frame(spark, texts):
    return spark.createDataFrame(texts, "doc_id bigint, text string").repartition(6)


def shared_passages(seed, n=60, words=90):
    """Texts with passages at random places, some cut short, and runs of few words."""
    rng = random.Random(seed)
    word = lambda k: f"w{rng.randrange(k)}"
    passages = [[word(300) for _ in range(rng.choice((20, 34, 35, 36, 60, 130)))] for _ in range(8)]
    out = []
    for i in range(n):
        text = [word(300) for _ in range(rng.randrange(words))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(8)
            text += p[a:] + [word(300) for _ in range(rng.randrange(30))]
        if rng.random() < 0.2:
            text += [rng.choice("ab")] * rng.randrange(90)
        out.append((i, "".join(w + rng.choice((" ", "  ", "\n", "\t", "\x0b ")) for w in text)))
    return out


def test_awkward_documents(spark):
    docs, texts = cases.documents(spark)
    assert removed(docs) == expected(texts)


@pytest.mark.parametrize("seed", range(2))
def test_passages(spark, seed):
    texts = shared_passages(seed)
    found = removed(frame(spark, texts))
    assert found == expected(texts) and sum(f[2] for f in found) > 500


def test_small_shards_and_crowded_anchors_change_nothing(spark, monkeypatch):
    for name, value in (("SHARD_WINDOWS", 30), ("ANCHOR_WINDOWS", 3), ("STREAMED", 4)):
        monkeypatch.setattr(phrase_dedup, name, value)
    line = " ".join(f"x{i}" for i in range(12))
    texts = shared_passages(7, 40) + [(100 + i, f"{cases.prose(i % 20, 40)} {line} {cases.prose(1000 + i % 15, 40)}") for i in range(60)]
    assert removed(frame(spark, texts)) == expected(texts)


def test_repeated_rows_under_one_id_or_none(spark):
    text = cases.prose(1, 50)
    texts = [(None, text)] * 40 + [(5, cases.prose(i, 45)) for i in range(300)] + [(5, text)] * 30 + [(6, cases.prose(4, 36))]
    assert removed(frame(spark, texts)) == expected(texts)


def test_other_white_space_and_non_ascii_words(spark):
    words = " ".join(f"é {i} ß\x1c" for i in range(40))
    texts = [(1, words), (2, words.replace(" ", "\r\n")), (3, words.upper())]
    assert removed(frame(spark, texts)) == expected(texts)


def test_long_texts_are_taken_in_parts(spark):
    long = " ".join(f"v{i % 70001}" for i in range(600_000))
    texts = [(1, long), (2, " ".join(f"v{i}" for i in range(69_980, 70_000)) + " " + cases.prose(1, 40)), (3, "z" * 3_000_000 + " end")]
    assert removed(frame(spark, texts)) == expected(texts)


def test_parts_share_their_overlap(monkeypatch):
    monkeypatch.setattr(phrase_dedup, "PART_BYTES", 50)
    text = b" ".join(b"w%d" % i for i in range(500))
    for overlap in (0, 3, 34):
        words = []
        for offset, part in phrase_dedup.parts_of(text, overlap):
            assert part[: len(words) - offset] == words[offset:] and len(words) - offset == (min(overlap, len(words)) if offset else 0)
            words = words[:offset] + part
        assert words == text.split()


def test_empty_table(spark):
    assert removed(frame(spark, [(1, "a")]).limit(0)) == []
