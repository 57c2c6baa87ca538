"""Vectors, shards, chat, toxicity, urls, packing and the pipeline."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from cases import CLASHES, documents, edited, prose, save

from gapscan.llm import chat, embedding_pq, packing, sharding, toxicity, url_filter
from gapscan.llm.queries import QUERIES, URL_RULES, tokenizer_paths

# --- vectors ------------------------------------------------------------------------------------


def vectors(spark):
    rng = np.random.default_rng(4)
    rows = []
    for group in range(40):
        centre = rng.normal(size=24)
        for _ in range(rng.integers(1, 12)):
            rows.append((centre + rng.normal(size=24) * rng.choice([0.02, 0.1, 0.25])).tolist())
    rows = [(i, v, int(i % 3 == 0)) for i, v in enumerate(rows)]
    n = len(rows)
    nan, inf = float("nan"), float("inf")
    rows += [(n + i, rows[0][1], 1) for i in range(5)] + [(n + 5, None, 1), (n + 6, [0.0] * 24, 1), (n + 7, [nan] * 24, 1), (n + 8, [inf] + [1.0] * 23, 1)]
    rows += [(n + 9, [None] + [1.0] * 23, 1), (n + 10, rows[0][1], None), (n + 11, [2.0 * x for x in rows[0][1]], 1), (n + 12, [], 1), (n + 13, [1.0, 0.0], 1), (n + 14, [1.0, 0.1], 1)]
    return rows


@pytest.mark.parametrize("block", [embedding_pq.BLOCK, 8])
def test_vectors_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(embedding_pq, "BLOCK", block)
    rows = vectors(spark)
    df = spark.createDataFrame([(*r, "own") for r in rows], "vec_id bigint, embedding array<float>, label int, n bigint".replace("n bigint", "n string")).repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_pq.near_vectors(df).collect()}
    parent = {r[0]: r[0] for r in rows}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    links = Counter()
    good = [(i, np.array(v, np.float32).astype(float), label) for i, v, label in rows if v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    for k, (a, u, x) in enumerate(good):
        for b, w, y in good[:k]:
            if x == y and len(u) == len(w) and u @ w / math.sqrt((u @ u) * (w @ w)) >= 0.93:
                links[a] += 1
                links[b] += 1
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    assert sum(links.values()) > 100
    assert {i: g[:2] for i, g in got.items()} == {i: (links[i], root(i)) for i in parent}
    assert all(kept == (i == component) for i, (_, component, kept) in got.items())
    assert embedding_pq.near_vectors(df.limit(0)).count() == 0


def test_vectors_of_any_norm(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(i, ((centres[i % 12] + 0.15 * rng.normal(size=8)) * 10.0 ** rng.choice([-300, -200, -30, 0, 40, 150, 299])).tolist(), 1) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_pq.near_vectors(df).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.abs(x).max(axis=1)[:, None]
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= 0.93
    component = list(range(400))
    for _ in range(400):
        new = [min(component[j] for j in np.flatnonzero(linked[i])) for i in range(400)]
        if new == component:
            break
        component = new
    assert got == {i: (int(linked[i].sum()) - 1, component[i]) for i in range(400)} and linked.sum() > 800


def test_bounds_never_lose_a_link():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 20))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = x + rng.normal(size=x.shape) * 0.06
    y /= np.linalg.norm(y, axis=1)[:, None]
    q = embedding_pq.Quantiser(x, 7)
    own = q.nearest(y)
    codes, missed, product = q.encode(y, own)
    tables = q.tables(x)
    estimate = (x * q.centres[own]).sum(axis=1) + product + sum(tables[np.arange(400), m, codes[:, m]] for m in range(q.parts))
    linked = (x * y).sum(axis=1) >= embedding_pq.COSINE
    assert linked.sum() > 50 and (estimate + embedding_pq.RADIUS * missed >= embedding_pq.COSINE - 1e-5)[linked].all()


@pytest.mark.parametrize("spectrum", [[1.0] * 3 + [0.002] * 29, [0.5**k for k in range(32)]], ids=["low rank", "decaying"])
def test_no_link_is_lost_where_vectors_vary_in_few_directions(spark, spectrum):
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(900, 32)) * np.sqrt(spectrum) @ np.linalg.qr(rng.normal(size=(32, 32)))[0]).astype(np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    q = embedding_pq.Quantiser(unit, 30)
    own, probes = q.probes(unit)
    a, b = np.nonzero(np.triu(unit @ unit.T >= embedding_pq.COSINE, 1))
    assert len(a) > 300 and all(own[i] == own[j] or own[j] in probes[i] or own[i] in probes[j] for i, j in zip(a, b, strict=True))
    label = np.arange(900) % 2
    links = ((unit @ unit.T >= embedding_pq.COSINE) & (label[:, None] == label[None])).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label, strict=True))], "vec_id bigint, embedding array<float>, label int")
    assert [r.n_links for r in embedding_pq.near_vectors(df).orderBy("vec_id").collect()] == links.tolist()


# --- shards ----------------------------------------------------------------------------------------


def test_shards_are_even_gapless_and_complete(spark):
    docs, rows = documents(spark)
    more = spark.createDataFrame([(1000 + i, "same text" if i % 3 == 0 else prose(i, 5 + i % 40)) for i in range(3000)], "doc_id bigint, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    got = sharding.shard_by_size(both, 40).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in [*rows, *((r.doc_id, r.text) for r in more.collect())]
    )
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))
    usual = sharding.shard_by_size(more, 40).groupBy("shard").agg({"size": "sum"}).collect()
    sums = [r[1] for r in usual]
    assert len(sums) == 40 and max(sums) - min(sums) <= 2 * 400
    assert sharding.shard_by_size(docs.limit(0), 40).count() == 0
    assert {r.shard for r in sharding.shard_by_size(docs.limit(1), 40).collect()} <= set(range(40))


def test_overfull_ranges_are_divided(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SAMPLES_A_RANGE", 1)
    table = spark.createDataFrame([(i, "hot" if i % 2 else prose(i, 20)) for i in range(2000)], "doc_id bigint, text string")
    sums = [r[1] for r in sharding.shard_by_size(table, 8).groupBy("shard").agg({"size": "sum"}).collect()]
    assert len(sums) == 8 and max(sums) - min(sums) < 400


# --- chat ------------------------------------------------------------------------------------------


def conversations(spark):
    rng = random.Random(6)
    rows = [(None, 0, "user", "x"), (1, None, "user", "first"), (1, 0, None, None), (1, 0, "assistant", "a"), (1, 0, "assistant", "a"), (2, 0, "assistant", "### user: </turn>\n\\ \\\\ :<#")]
    rows += [(3, 0, "system", "be nice \\"), (3, 1, "user", prose(1, 3000)), (3, 2, "assistant", prose(2, 2500)), (3, 3, "assistant", "")]
    for c in range(4, 12):
        rows += [(c, t, "system" if t == 0 and c % 2 else rng.choice(["user", "assistant", "tool"]), prose(c * 100 + t, rng.randint(0, 200))) for t in range(rng.randint(1, 40))]
    rows += [(12, t, ["user", "assistant"][t % 2], "w " * (t % 7)) for t in range(900)]
    return rows


def test_chat_reads_back(spark):
    rows = conversations(spark)
    df = spark.createDataFrame([(*r, "own") for r in rows], "conv_id bigint, turn bigint, role string, text string, window string").repartition(4)
    windows = chat.format_windows(df)
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    by_conv = defaultdict(list)
    for c, t, role, text in rows:
        by_conv[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by_conv)
    for c, turns in by_conv.items():
        turns.sort(key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        r = got[c]
        learnt = "".join(x[3] for x in turns if x[2] == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(learnt))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
    made = windows.collect()
    for w in made:
        turns = chat.parse(w.formatted)
        new = turns[w.n_repeated :]
        cost = [len(t.split()) + 4 for _, t, _, _ in turns]
        assert sum(cost[w.n_repeated : -1]) <= chat.BUDGET and new
        assert all(any(a == s and b == e for _, _, s, e in new) for a, b in zip(w.loss_starts, w.loss_ends, strict=True))
        if w.window and w.conv_id == 3:
            assert turns[0][:2] == ("system", "be nice \\")
        history = [x for x in turns[: w.n_repeated] if x[0] != "system"]
        assert sum(len(x[1].split()) + 4 for x in history) <= chat.HISTORY
    assert sum(w.n_repeated > 0 for w in made) > 3
    assert chat.format_windows(df.limit(0)).count() == 0


def test_hard_conversation_of_the_query(spark, tmp_path):
    table = spark.createDataFrame([r for r in conversations(spark) if r[0]], "conv_id bigint, turn bigint, role string, text string")
    r = QUERIES["op6_chat"](spark, save({"conversations": table}, tmp_path / "t")).where("conv_id = -7").first()
    said = "\\### Assistant: </turn> ok"
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


# --- toxicity -----------------------------------------------------------------------------------------


def labelled(spark, n=700):
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = prose(2000 + i, 60).split(" ")
        if toxic:
            words[i % 50] = ["vilex", "scumbo", "lostra" + "abcdefgh"[i % 8]][i % 3]
        rows.append((i, " ".join(words), ["en", "de"][i % 2]))
        labels.append((i, 1, int(toxic)))
    labels += [(n + 5, 1, None), (None, 0, 1), (3, 1, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs.withColumn("flagged", docs.lang), model).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.9
    assert all((r.score >= 0.5) == bool(r.predicted) and 0 <= r.score <= 1 for r in got)
    awkward, rows = documents(spark)
    scored = toxicity.score(awkward, model).collect()
    assert len(scored) == len(rows) and all(r.key == CLASHES["key"] for r in scored)
    assert len({r.score for r in scored if not (r.text or "").strip(" \n!?")}) == 1 and not [r for r in scored if r.text == "" and r.predicted]
    same = defaultdict(set)
    for r in scored:
        same[r.text].add(r.score)
    assert all(len(s) == 1 for s in same.values())
    assert toxicity.score(awkward.limit(0), model).count() == 0
    nothing = toxicity.fit(docs, labels.limit(0))
    assert not toxicity.score(docs, nothing).where("predicted = 1").count()


def test_toxicity_learns_from_all_labelled_rows(spark):
    ids = spark.range(3000).where("crc32(cast(id as string)) % 5 <> 0")
    last = ids.orderBy(F.xxhash64("id").desc()).limit(40)
    toxic = ids.join(last.withColumn("late", F.lit("zzrareword")), "id", "left")
    docs = toxic.selectExpr("id as doc_id", "concat_ws(' ', 'vilex some words', late) as text", "'en' as lang")
    docs = docs.unionByName(spark.range(5000, 5200).selectExpr("id as doc_id", "'mild and some words' as text", "'en' as lang"))
    labels = docs.selectExpr("doc_id", "if(doc_id < 5000, 1, 0) as toxic")
    model = toxicity.fit(docs, labels)
    buckets, _ = toxicity.features(pa.array(["zzrareword"]))
    assert set(buckets[0].tolist()) <= set(model.buckets.tolist())


def test_a_shard_of_toxicity_is_whole_however_many_partitions_a_key_has(spark, monkeypatch):
    docs = spark.range(1200).selectExpr("id as doc_id", "concat('word', id % 7, ' and more') as text", "'en' as lang")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) as toxic")
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 200)
    kind = type(docs)
    dealt = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, n, *keys: dealt(self, max(n, 31) if keys else n, *keys))
    rows = toxicity._labelled(docs, labels)
    files = rows.select("shard", F.input_file_name().alias("file")).groupBy("shard", "file").count().collect()
    assert len(files) == len({r["shard"] for r in files}) == 5
    assert sum(r["count"] for r in files) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(1200))


def test_toxicity_in_many_shards(spark, monkeypatch):
    docs, labels = labelled(spark)
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 150)
    models = [toxicity.fit(docs, labels)]
    monkeypatch.setattr(toxicity, "SENT_IDS", 0)  # ids meet their texts in a shuffle
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        models.append(toxicity.fit(docs.repartition(5), labels))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert models[0].bias == models[1].bias and (models[0].vectors == models[1].vectors).all()
    held = [r for r in toxicity.score(docs, models[0]).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.9


def random_model(seed=1):
    rng = np.random.default_rng(seed)
    normal = lambda *shape: rng.normal(size=shape).astype(np.float32)
    buckets = np.sort(rng.choice(toxicity.BUCKETS, toxicity.BUCKETS // 2, replace=False)).astype(np.int32)
    return toxicity.Model(buckets=buckets, vectors=normal(len(buckets), toxicity.DIM), filters=normal(toxicity.DIM, toxicity.COLUMNS), offsets=normal(24), weights=normal(24), bias=0.25)


def plain_logit(m, text):
    """One text, word by word, filter by filter."""
    rows, _ = toxicity.features(pa.array([text], pa.string()))
    vector = dict(zip(m.buckets.tolist(), m.vectors.astype(float)))
    words = [sum((vector[b] for b in row if b in vector), np.zeros(toxicity.DIM)) for row in rows.tolist()]
    total, column, k = float(m.bias), 0, 0
    for width in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            filters = [m.filters[:, column + j * toxicity.FILTERS + f].astype(float) for j in range(width)]
            found = [sum(words[i + j] @ filters[j] for j in range(width) if i + j < len(words)) + float(m.offsets[k]) for i in range(len(words))]
            total += max([0.0, *found]) * float(m.weights[k])
            k += 1
        column += width * toxicity.FILTERS
    return total


def test_scores_equal_a_plain_forward_pass_whatever_the_batch(monkeypatch):
    texts = [prose(1, 300), None, "one", "", prose(2, 50), "two words", prose(3, 1)]
    m = random_model()
    products = m.products()
    alone = [toxicity.logits(m, products, *toxicity.features(pa.array([t], pa.string())))[0] for t in texts]
    assert np.allclose(alone, [plain_logit(m, t) for t in texts], rtol=1e-4, atol=1e-4)
    for n in (1, 2, 3, 7, 40, 200):
        batch = pa.array([prose(100 + i, 5 + i % 60) for i in range(n)] + texts)
        assert toxicity.logits(m, products, *toxicity.features(batch))[n:].tolist() == alone
    monkeypatch.setattr(toxicity, "CHUNK", 17)
    assert toxicity.logits(m, products, *toxicity.features(pa.array(texts))).tolist() == alone


def test_equal_texts_score_alike_in_any_partitioning(spark):
    m = random_model(2)
    texts = [prose(i % 7, 40) for i in range(300)] + [prose(i, 30) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    seen = defaultdict(set)
    for n in (1, 3, 8):
        for r in toxicity.score(docs.repartition(n), m).collect():
            seen[r.text].add(r.score)
    assert all(len(s) == 1 for s in seen.values())


# --- urls -----------------------------------------------------------------------------------------------


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), h + p, a) for h, p, a in URL_RULES if path.startswith(p) and (host == h or host.endswith("." + h))]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("block", [url_filter.BLOCK_BYTES, 40])
def test_urls_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(url_filter, "BLOCK_BYTES", block)
    urls = [None, "", "no scheme", "http://", "://x", "http://ORG/", "http://a.Example.ORG/es/x?y#z", "http://example.org/en/12", "http://example.org/en/2", "http://x.com?/fr/", "http://x.com/fr/a", "http://xcom/fr/",
            "http://com/de/", "http://.com/de/", "ftp://a://b.com/de/1", "http://Ünï.com/de/ü", "http://x.com\n/de/", "http://notexample.org/es/", "http://" + "a." * 3000 + "com/de/", "http://org", "HTTP://a.ORG/\n"]
    rng = random.Random(1)
    urls += ["http://" + rng.choice(["", "www.", "a.b."]) + rng.choice(["example.org", "example.com", "org", "x.net"]) + rng.choice(["/", "", "/es/", "/en/1", "/fr/", "/de/q", "/DE/"]) + rng.choice(["", "1", "?x=/de/"]) for _ in range(300)]
    pages = spark.createDataFrame([(i, u, "own", "own") for i, u in enumerate(urls)], "page_id bigint, url string, rule string, action string")
    rules = spark.createDataFrame([*URL_RULES, (None, "/", "block"), ("x", None, "block")], "host string, path string, action string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(urls)}
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert url_filter.filter_urls(pages, rules.limit(0)).where("verdict = 'allow' and rule is null").count() == len(urls)


def test_equal_digests_are_told_apart(monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s: 7)
    array = url_filter.DigestArray([("a", "/", "allow"), ("b", "/", "block"), ("a.b", "/", "block")])
    assert [array.stored(i) for i in array.probe([(b"b/", 1), (b"c/", 1), (b"a/", 1)]) if i >= 0] == [b"b/", b"a/"]


# --- packing ----------------------------------------------------------------------------------------------


def test_tokens_equal_the_library(spark):
    from tokenizers import Tokenizer

    texts = ["", " ", "  ", "a  b", "it's  he'll\n\n x", "½ a", "a b <|endoftext|> x", "\n\n a\n b \n", "a\tb  \tc\n", "Übér 12ab_cd--  --x", "日本語", "é\u00a0x", None, "x×y÷z", "µ ª x  ", "a \x1c b", " \t lead", "12345 67", "ßa’s", prose(1, 500)]
    rng = random.Random(2)
    texts += ["".join(rng.choices(["a", "B", "é", " ", "  ", "\n", "1", "23", ".", "!?", "\t", "ñandú", "_"], k=rng.randint(1, 14))) for _ in range(1500)]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for paths in (tokenizer_paths(), (tokenizer_paths()[0], None, None)):
        ids, at = packing.tokens(*paths).encode(pa.array(texts))
        want = [[*e.ids, packing.END] for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


def test_packing_holds_every_id_once(spark):
    from tokenizers import Tokenizer

    docs, rows = documents(spark)
    more = spark.createDataFrame([(500 + i, prose(i, 20 + i % 90)) for i in range(400)], "doc_id bigint, text string")
    rows = [*rows, *((r.doc_id, r.text) for r in more.collect())]
    got = packing.pack(docs.select("doc_id", "text").unionByName(more), tokenizer_paths(), with_ids=True).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((i, tuple([*library.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in rows)
    seen, at = Counter(), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length <= 2048 and zlib.crc32(r.ids) == r.ids_crc32
        at[r.sequence_id].append((r.offset, r.length))
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())))
    for (i, ids), n in want.items():
        if n == 1 and sum(m for (j, _), m in want.items() if j == i) == 1:
            assert sum((p[1] for p in sorted(pieces[i])), ()) == ids
        seen[i] += n * len(ids)
    assert all(sum(len(p[1]) for p in pieces[i]) == n for i, n in seen.items())
    for parts in at.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(n for _, n in parts) <= 2048
    assert len(at) <= -(-sum(n for p in at.values() for _, n in p) // 2048) + 2
    assert packing.pack(docs.limit(0), tokenizer_paths()).count() == 0


def test_windows_are_filled_as_well_as_possible():
    import itertools

    rng = random.Random(3)
    for _ in range(200):
        counts = Counter(rng.choices(range(1, 30), k=rng.randint(1, 8)))
        lengths = sorted(counts, reverse=True)
        chosen = packing.closest_fill(lengths, counts, 40)
        rest = list((counts - Counter({lengths[0]: 1})).elements())
        best = max((sum(c) for k in range(len(rest) + 1) for c in itertools.combinations(rest, k) if sum(c) + lengths[0] <= 40), default=0)
        assert sum(a * b for a, b in chosen.items()) == lengths[0] + best and all(chosen[x] <= counts[x] for x in chosen)
    counts = {k: 1 + k % 5 * 1000 for k in range(1, 2048, 3)}
    plan = packing.plan_windows(counts, 2048)
    used = Counter()
    for chosen, times in plan:
        assert sum(a * b for a, b in chosen.items()) <= 2048
        for length, n in chosen.items():
            used[length] += n * times
    assert used == Counter(counts) and len(plan) <= len(counts)


# --- the pipeline ---------------------------------------------------------------------------------------------


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    items = [prose(60 + i, 25) for i in range(4)]
    docs, rows = documents(spark, items)
    toxic, labels = labelled(spark, 400)
    toxic = toxic.selectExpr("doc_id + 10000 as doc_id", "text", "lang", "'t' as source", "length(text) as n_chars", *[f"'own' as {c}" for c in CLASHES])
    secret = spark.createDataFrame([(5000, "write to x.y@z.org or 4041894974608795 " + prose(77, 40))], "doc_id bigint, text string")
    secret = secret.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "length(text) as n_chars", *[f"'own' as {c}" for c in CLASHES])
    whole = docs.unionByName(toxic).unionByName(secret)
    labels = labels.selectExpr("doc_id + 10000 as doc_id", "quality", "toxic")
    benchmark = spark.createDataFrame([*enumerate(items)], "item_id bigint, text string")
    folder = save({"documents": whole, "labels": labels, "benchmark": benchmark}, tmp_path / "t")
    kept, now = {}, spark.read.parquet(f"{folder}/documents.parquet")
    columns = now.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, folder).write.parquet(path := str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(path)
        kept[name] = {getattr(r, "doc_id"): r for r in now.collect()}
        if k < 4:
            assert now.columns == columns and all(r.key == "own" for r in kept[name].values())
            assert name == "toxicity" or not [r for r in kept[name].values() if r.n_chars != len(r.text or "")]
    first = {i for i in kept["toxicity"] if i and i >= 10000}
    bad = {10000 + i for i in range(0, 400, 4)}
    assert len(first & bad) < 12 and len({*range(10000, 10400)} - bad - first) < 6
    second = kept["near_duplicates"]
    assert {2, 3, 10, 12, 14} & set(second) == set() and {None, 1, 4, 5, 6, 7, 8, 9, 11, 13, 19} <= set(second)
    assert items[0].split(" ")[3] not in kept["decontamination"][100].text and kept["decontamination"][1].text == rows[0][1]
    assert kept["personal_data"][5000].text.startswith("write to [EMAIL] or [CARD] ")
    assert set(kept["packing"]) == {i for i in kept["personal_data"]}


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    import corpus_pipeline

    a, b, c, d = (prose(200 + k, 120) for k in range(4))
    rows = [(5, a), (5, b), (7, a), (8, b), (5, None), (5, None), (5, a), (9, edited(a, 60)), (3, edited(b, 60)), (6, c), (6, edited(c, 60)), (None, a)]
    rows += [(0, f"{k} {prose(300 + k, 40)}") for k in range(40)] + [(1, d), (0, d)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    kept = sorted(((r.doc_id, r.text) for r in got if r.doc_id is not None and r.doc_id != 6), key=str)
    assert kept == sorted([(5, a), (5, None), (3, edited(b, 60)), *rows[12:52], (0, d)], key=str)
    assert len([r for r in got if r.doc_id == 6]) == 1 and [r.text for r in got if r.doc_id is None] == [a]


def test_pipeline_on_no_rows(spark, tmp_path):
    import corpus_pipeline

    docs, _ = documents(spark)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    benchmark = spark.createDataFrame([], "item_id bigint, text string")
    folder = save({"documents": docs.limit(0), "labels": labels, "benchmark": benchmark}, tmp_path / "t")
    assert corpus_pipeline.run(spark, folder).count() == 0
    assert edited("a b c", 2) and corpus_pipeline.ORACLE_SQL is None
