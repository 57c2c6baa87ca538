"""Operators on documents against brute force: repeats, near-duplicates, benchmark, personal data."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cases import CLASHES, documents, edited, prose

from gapscan.llm import common, decontaminate, minhash, pii, suffix_dedup

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return WORD.findall((text or "").translate(SMALL))


@pytest.fixture(scope="module")
def given(spark):
    return documents(spark)


# --- repeated strings -----------------------------------------------------------------------


def brute_repeats(texts, span):
    seen = Counter(b[k : k + span] for b in texts for k in range(len(b) - span + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - span + 1):
            if seen[b[k : k + span]] > 1:
                gone[k] += 1
                gone[k + span] -= 1
        mask = np.cumsum(gone[:-1]) > 0
        starts = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        out.append((len(b), starts, np.frombuffer(b, np.uint8)[~mask].tobytes()))
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_SEGMENTS, 0])
def test_repeats_equal_brute_force(given, hot):
    docs, rows = given
    got = suffix_dedup.remove_repeats(docs, hot=hot).collect()
    want = brute_repeats([(t or "").encode() for _, t in rows], suffix_dedup.SPAN)
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(((r.doc_id, r.n_bytes, len(r.starts), bytes(r.kept)) for r in got), key=key) == sorted(((i, *w) for (i, _), w in zip(rows, want, strict=True)), key=key)


def test_texts_under_one_id_or_none_and_many_equal_rows(spark):
    texts = [prose(1000 + i, 45) for i in range(120)] + [prose(1, 60)] * 200 + [prose(2, 50) + prose(1, 60)] + [prose(5, 70)]
    rows = [(None if i % 2 else 5, t) for i, t in enumerate(texts)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)).collect()
    want = brute_repeats([t.encode() for _, t in rows], suffix_dedup.SPAN)
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(((r.doc_id, r.n_bytes, len(r.starts), bytes(r.kept)) for r in got), key=key) == sorted(((i, *w) for (i, _), w in zip(rows, want, strict=True)), key=key)


def test_common_prefixes_on_random_strings():
    rng = np.random.default_rng(1)
    for _ in range(30):
        parts = ["".join(rng.choice(list("ab"), rng.integers(6, 90))).encode() for _ in range(rng.integers(1, 12))]
        want = Counter(p[k : k + 6] for p in parts for k in range(len(p) - 5))
        for p, found in zip(parts, suffix_dedup.repeated_starts(parts, 6), strict=True):
            assert found.tolist() == [want[p[k : k + 6]] > 1 for k in range(len(p) - 5)]


def test_long_texts_are_taken_in_stretches(monkeypatch):
    import pyarrow as pa

    text = prose(31, 3000)
    batch = pa.RecordBatch.from_arrays([pa.array([b"1"]), pa.array([text])], names=["digest", "text"])
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 1000)
    found = list(suffix_dedup._segment_rows(200, 40)(iter([batch])))
    spans = sorted((s, c) for b in found for s, c in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True))
    assert sum(c for _, c in spans) == len(text.encode()) - 199 and [s for s, _ in spans[1:]] == [s + c for s, c in spans[:-1]]


# --- near-duplicates --------------------------------------------------------------------------


def bag(text):
    w = words_of(text)
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def probability_jaccard(a, b):
    keys = set(a) | set(b)
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in keys) for d in a if d in b)


def test_near_duplicates_equal_brute_force(given):
    docs, rows = given
    classes, links = minhash.near_duplicates(docs)
    got = defaultdict(set)
    for r in classes.collect():
        got[r.doc_id].add(r.class_id)
    by_id = {i: t for i, t in rows if i is not None}
    parent = {i: i for i in by_id}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    bags = {i: bag(t) for i, t in by_id.items()}
    for a in by_id:
        for b in by_id:
            if a < b and bags[a] and bags[b] and probability_jaccard(bags[a], bags[b]) >= 0.8:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert {i: got[i] for i in by_id} == {i: {root(i)} for i in by_id}
    assert got[None] == {None}
    assert classes.count() == len(rows)
    assert {3, 14} <= {r.b for r in links.collect()}


def test_similarity_is_exact_and_estimated_without_bias():
    import pyarrow as pa

    a, b = bag(prose(1, 300)), bag(edited(prose(1, 300), 20))
    keys = sorted(set(a) | set(b))
    vector = lambda c: (np.array([k for k, x in enumerate(keys) if c[x]], np.uint64), np.array([c[x] for x in keys if c[x]]))
    exact = probability_jaccard(a, b)
    assert abs(minhash.probability_jaccard(vector(a), vector(b)) - exact) < 1e-12
    words = minhash.Words(pa.array([prose(1, 300), edited(prose(1, 300), 20)]))
    signs = minhash.signatures(*minhash.shingles(words), 2)
    assert abs((signs[0] == signs[1]).mean() - exact) < 0.17
    weighted = np.array([5.0, 1.0]), np.array([1.0, 5.0])
    hashes = np.array([11, 22], np.uint64)
    same = [np.mean(np.equal(*minhash.signatures(np.array([0, 0, 1, 1]), np.concatenate([minhash.mix(hashes + np.uint64(99 * k))] * 2), np.concatenate(weighted), 2))) for k in range(60)]
    want = 1 / max(1 + 1 / 5, 1) * 0 + sum(1 / sum(max(weighted[0][e] / weighted[0][d], weighted[1][e] / weighted[1][d]) for e in (0, 1)) for d in (0, 1))
    assert abs(np.mean(same) - want) < 0.03


def test_members_apart_from_their_representatives_still_link(spark):
    """A chain of copies, each near the next only: the ends are unlike, the class is one."""
    text, rows = prose(40, 400), []
    for k in range(12):
        rows.append((k, text))
        words = text.split(" ")
        words[30 * k : 30 * k + 6] = [f"q{k}w{j}" for j in range(6)]
        text = " ".join(words)
    classes, _ = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.class_id for r in classes.collect()} == {0}


def test_equal_wordless_texts_are_one_class(spark):
    rows = [(1, "-----"), (2, "-----"), (3, ""), (4, ""), (5, " "), (6, None), (7, None), (8, "!!! ??"), (9, "!!! ??"), (10, "----"), (11, "one")]
    classes, links = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((r.doc_id, r.class_id) for r in classes.collect()) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 6), (7, 7), (8, 8), (9, 8), (10, 10), (11, 11)]
    assert links.count() == 0


# --- benchmark -----------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 300])
def test_contamination_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    items = [prose(60 + i, 25) for i in range(6)] + ["short item zzz", "one"]
    docs, rows = documents(spark, items)
    table = [*enumerate(items), (50, items[0]), (51, None), (52, "!!"), (53, ""), (0, items[0])]
    benchmark = spark.createDataFrame(table, "item_id bigint, text string")
    windows = defaultdict(set)
    for i, t in table:
        w = words_of(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    want = []
    for i, t in rows:
        w, hit, found = words_of(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                owners = windows.get(tuple(w[k : k + n]))
                if owners:
                    hit.update(range(k, k + n))
                    found |= owners
        want.append((str(i), len(w), len(hit), sorted(found)))
    result = decontaminate.find_contamination(docs, benchmark)
    got = [(str(r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in result.collect()]
    assert sorted(got) == sorted(want)
    cleaned = {r.doc_id: r for r in decontaminate.remove_contamination(docs, benchmark).collect()}
    assert not set(words_of(cleaned[106].text)) & {"short", "item"}
    assert cleaned[1].text == rows[0][1] and cleaned[1].key == CLASHES["key"] and cleaned[5].text is None
    again = decontaminate.find_contamination(spark.createDataFrame([(r.doc_id, r.text) for r in cleaned.values()], "doc_id bigint, text string"), benchmark)
    assert again.where("n_hit > 0").count() == 0


def test_index_finds_and_locates_all_occurrences():
    rng = np.random.default_rng(2)
    sequence = rng.integers(1, 5, 400)
    index = decontaminate.FMIndex(sequence)
    phrases = np.array([[a, b, c] for a in range(1, 7) for b in range(1, 5) for c in range(1, 5)])
    low, high = index.search(phrases)
    for phrase, a, b in zip(phrases, low, high, strict=True):
        want = [k for k in range(398) if (sequence[k : k + 3] == phrase).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# --- personal data ---------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"\D", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_equal_the_patterns():
    import random

    rng = random.Random(3)
    pieces = ["a@b.c", "@", ".", "x", "1.2.3.4", "256.1.1.1", "4041894974608795", "4111 1111 1111 1111", "+1 (262) 555-3752", "+", "12", " ", "-", "@x.y", "ü", "0", "007.1.2.3", "\n"]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randint(1, 9)))
        assert pii.base_spans(text) == brute_spans(text), text
    for text in ("a" * 200_000, "1" * 200_000, "+1 " * 60_000, "1.2.3." * 40_000, "a@" * 60_000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def field(spark):
    return pii.train(pii.labelled_table(spark))


def test_field_learns_its_table_and_leaves_prose_alone(spark, field):
    rows = pii.labelled_table(spark, rows=200, seed=99).collect()
    right = total = 0
    for words, labels in rows:
        found = pii.decode(field, pii.shapes(np.array([ord(c) for c in " ".join(words)], np.uint32)))
        right += sum(a == b for a, b in zip(found.tolist(), labels, strict=True))
        total += len(labels)
    assert right / total > 0.97
    assert not [s for _, spans in pii.all_spans([prose(k, 500) for k in range(10)], field) for s in spans]


def test_cuts_do_not_change_the_best_labels(field):
    text = "call (262) 555-3752 or a.b@c.org now " + prose(3, 30) + " 4041 8949 7460 8795 on 12.12.2020 at 10.0.0.1:80"
    words = pii.shapes(np.array([ord(c) for c in text], np.uint32))
    e = field.emissions[words.features].sum(axis=1)
    for line in np.unique(words.lines):
        mine = words.lines == line
        whole = pii.viterbi(e[mine][None], field.transitions, np.array([mine.sum()]))[0]
        assert whole.tolist() == pii.decode(field, words)[mine].tolist()


def test_personal_data_on_awkward_rows(given, field):
    docs, rows = given
    got = pii.find_personal_data(docs, field)
    assert got.count() == len(rows)
    for r in got.collect():
        assert [(s.kind, s.start, s.end) for s in r.base_spans] == brute_spans(r.text) and r.key == CLASHES["key"]
        assert set(map(tuple, r.base_spans)) <= set(map(tuple, r.spans))
    said = docs.sparkSession.createDataFrame([(1, "mail x.y@z.org, card 4041894974608795 or call (262) 555-3752."), (2, None)], "doc_id bigint, text string")
    masked = {r.doc_id: r.text for r in pii.mask_personal_data(said, field).collect()}
    assert masked == {1: "mail [EMAIL], card [CARD] or call [PHONE].", 2: None}


def test_empty_tables(given, field, spark):
    docs = given[0].limit(0)
    benchmark = spark.createDataFrame([], "item_id bigint, text string")
    assert suffix_dedup.remove_repeats(docs).count() == 0
    assert minhash.near_duplicates(docs)[0].count() == 0
    assert decontaminate.find_contamination(docs, benchmark).count() == 0
    assert pii.find_personal_data(docs, field).count() == 0
    assert decontaminate.find_contamination(given[0], benchmark).where("n_hit > 0").count() == 0


def test_digest_columns(spark, tmp_path, given):
    """The thin queries: digests of what the operators return."""
    from cases import save

    from gapscan.llm.queries import QUERIES

    docs, rows = given
    folder = save({"documents": docs}, tmp_path / "t")
    by_id = {i: t for i, t in rows}
    for r in QUERIES["op4_pii"](spark, folder).collect():
        if r.doc_id == 1:
            assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(by_id[1])).encode()).hexdigest()
    want = dict(zip([i for i, _ in rows], brute_repeats([(t or "").encode() for _, t in rows], 200), strict=True))
    for r in QUERIES["op3_suffix"](spark, folder).collect():
        if r.doc_id not in (None, 19):
            assert r.kept_sha256 == hashlib.sha256(want[r.doc_id][2]).hexdigest() and r.n_removed == r.n_bytes - len(want[r.doc_id][2])


def test_a_finished_task_leaves_nothing_in_its_worker():
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [prose(1, 300)], "digest": [b"d"]})
    assert sum(part.num_rows for part in minhash._sign(iter([batch]))) == 1
    assert [len(x) for x in common._POWERS] == [1, 1]
