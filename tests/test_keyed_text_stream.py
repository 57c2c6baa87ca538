import datetime as dt
import random

from pyspark.sql import functions as F

from gapscan.operators import keyed, snapshots, text
from gapscan.streaming.ingest import ingest_snapshots

from helpers import rows_by


def history(seed=0, n=600):
    """Key "hot" holds most rows; values may be null and stay over several pieces."""
    rng = random.Random(seed)
    return [(rng.choice(("hot",) * 6 + ("a", "b")), i, rng.choice((1, 1, 1, 2, None))) for i in range(n)]


def test_changes_equal_brute_force(spark):
    rows = history()
    expected, last = [], {}
    for key, i, value in rows:
        if key not in last or last[key] != value:
            expected.append(i)
        last[key] = value
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame(rows, "key string, i int, value int")
    for size in (1, 7, 1000):
        found = keyed.changes_only(table, ["key"], ["i"], "value", F.floor(F.col("i") / size))
        assert sorted(r.i for r in found.collect()) == expected
        assert found.columns == ["key", "i", "value"]


def test_changes_shuffle_the_table_once(spark, tmp_path):
    path = str(tmp_path / "history")
    spark.createDataFrame(history(), "key string, i int, value int").write.parquet(path)
    found = keyed.changes_only(spark.read.parquet(path), ["key"], ["i"], "value", F.floor(F.col("i") / 50))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_distinct_blocks_keep_the_first(spark):
    rows = [("k", 1, 1, "color", "red"), ("k", 1, 2, "size", "1"), ("k", 2, 3, "size", "1"), ("k", 2, 4, "color", "red"),
            ("k", 3, 5, "color", "red"), ("k", 3, 6, "size", "1"), ("j", 3, 7, "color", "red")]
    table = spark.createDataFrame(rows, "key string, block int, pos int, attribute string, value string")
    for size in (1, 2, 100):
        found = keyed.distinct_blocks(table, ["key"], "block", ["pos"], "attribute", "value", F.floor(F.col("pos") / size))
        assert found.columns == ["key", "block", "ordinal", "attribute", "value"]
        assert sorted(map(tuple, found.collect())) == [
            ("j", 3, 1, "color", "red"), ("k", 1, 1, "color", "red"), ("k", 1, 2, "size", "1"), ("k", 2, 1, "size", "1"), ("k", 2, 2, "color", "red")
        ]
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_busy_block_is_numbered_in_pieces(spark):
    """One key and one block hold most rows; null keys, null values and an equal later block."""
    rows = [("k", 1, i, "a", str(i % 7) if i % 5 else None) for i in range(3000)]
    rows += [("k", 2, 5000 + i, "a", str(i % 7) if i % 5 else None) for i in range(3000)]
    rows += [(None, 1, 9000, "a", None), (None, 2, 9001, "a", ""), (None, 3, 9002, "a", None)]
    random.Random(2).shuffle(rows)
    table = spark.createDataFrame(rows, "key string, block int, pos int, attribute string, value string")
    found = keyed.distinct_blocks(table, ["key"], "block", ["pos"], "attribute", "value", F.floor(F.col("pos") / 50)).collect()
    assert sorted((r.ordinal, r.value or "-") for r in found if r.key) == sorted((i + 1, str(i % 7) if i % 5 else "-") for i in range(3000))
    assert {r.block for r in found if r.key} == {1} and {r.block for r in found if not r.key} == {1, 2}


def test_groups_in_first_seen_order(spark):
    rows = [("b", 1), ("a", 2), ("b", 3), (None, 4), ("a", 5), (None, 6)]
    shuffled = spark.createDataFrame(rows, "key string, pos int").orderBy(F.rand(3))
    found = keyed.group_in_first_seen_order(shuffled, "key", ["pos"]).collect()
    assert [(r.key, r.pos, r.first_pos) for r in found] == [
        ("b", 1, 1), ("b", 3, 1), ("a", 2, 2), ("a", 5, 2), (None, 4, 4), (None, 6, 4)
    ]


PLAIN_RULE = r"([^{]+)\{([^}]+)\}"

SHEET = """
.late { nothing }
/* a { b: c } */
.box { color: red; size: 1 ; junk; url: http://x/y }
p { margin: 0 }
.box { color: red; size: 1; url: http://x/y }
.box { color: blue;
  size: 2; }
.box { color: red; size: 1 }
.box { color: blue; size: 2 }
.late { top: 1 }
"""


def clean_by_hand(css):
    """The same steps on one text, in plain Python."""
    import re

    groups = {}
    for selector, body in re.findall(PLAIN_RULE, css):
        groups.setdefault(selector.strip(), []).append(body)
    blocks = []
    for selector, bodies in groups.items():
        current, done = {}, set()
        for body in bodies:
            changed = []
            for part in body.split(";"):
                name, colon, value = part.partition(":")
                name, value = name.strip(), value.strip()
                if colon and current.get(name) != value:
                    current[name] = value
                    changed.append(f"{name}: {value}")
            if changed and tuple(changed) not in done:
                done.add(tuple(changed))
                blocks += [(selector, declaration) for declaration in changed]
    return blocks


def test_rules_are_those_of_the_plain_pattern(spark):
    import re

    rng = random.Random(4)
    texts = ["", "{", "}", "{}", "a{}b{c:d}", "a{b{c:d}", "{{a{b:c}", "a}b{c:d}e", "x{a:b}}{c:d}", "tail{a:b} none", "a{b:c"]
    texts += ["".join(rng.choices(["{", "}", "a", "b:c", " ", "\n", ";"], k=rng.randint(1, 14))) for _ in range(3000)]
    table = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "id int, css string")
    found = {}
    for r in text._rules(table, "css").collect():
        found.setdefault(r.id, []).append((r.pos, r.selector, r._body))
    for i, css in enumerate(texts):
        want = [(k, s.strip(), b) for k, (s, b) in enumerate(re.findall(PLAIN_RULE, css))]
        assert found.get(i, []) == want, css


def test_long_texts_take_linear_time(spark):
    import time

    texts = [("no brace " * 120_000,), (".a { b: c; d: e } " * 55_000,), ("{" * 1_000_000,), ("a{" * 500_000,), ("a}" * 500_000,), ("a{}" * 300_000,)]
    spark.createDataFrame([("a{b:c}",)], "css string").transform(text.extract_rules, "css").count()
    for (css,), rules in zip(texts, (0, 110_000, 0, 0, 0, 0)):
        start = time.time()
        assert text.extract_rules(spark.createDataFrame([(css,)], "css string"), "css").count() == rules
        assert time.time() - start < 8


def test_comments_and_rules(spark):
    pages = spark.createDataFrame([(1, SHEET), (2, "a/*x*/b/* y\n z */c"), (3, "/* open"), (4, None)], "id int, css string")
    stripped = text.strip_comments(pages, "css")
    found = rows_by(stripped, "id")
    assert (found[2].css, found[3].css, found[4].css) == ("abc", "/* open", None)
    rules = text.extract_rules(stripped.where("id = 1"), "css").orderBy("pos", "declaration_pos").collect()
    assert [(r.pos, r.selector, r.attribute, r.value) for r in rules][:4] == [
        (1, ".box", "color", "red"), (1, ".box", "size", "1"), (1, ".box", "url", "http://x/y"), (2, "p", "margin", "0")
    ]
    cleaned = text.clean_rules(stripped, "id", "css").where("id = 1").collect()
    assert [(r.selector, f"{r.attribute}: {r.value}") for r in cleaned] == clean_by_hand(found[1].css)
    assert len({(r.selector, r.pos) for r in cleaned}) == 5 and cleaned[0].selector == ".late"


def test_style_bodies(spark):
    page = "<html><STYLE type='x'>a{b:c}</STYLE><p>x</p><style>\nd{e:f}</style></html>"
    pages = spark.createDataFrame([(1, page), (2, "<p>none</p>")], "id int, html string")
    found = rows_by(text.style_bodies(pages, "html"), "id")
    assert (found[1].html, found[2].html) == ("a{b:c}\n\nd{e:f}", "")


def test_latest_snapshots(spark):
    table = spark.createDataFrame([(i, i // 3) for i in range(60)] + [(99, None)], "id int, snap int")
    assert sorted(r.id for r in snapshots.latest_snapshots(table, "snap", 2).collect()) == [54, 55, 56, 57, 58, 59]
    assert snapshots.latest_snapshots(table, "snap").count() == 30


def test_ingest_takes_each_file_once(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows = lambda n: spark.createDataFrame([(n, float(n))], "id int, value double")
    schema = rows(0).schema

    def run():
        query = ingest_snapshots(spark, source, target, schema, checkpoint, every=None, max_files=2)
        query.awaitTermination(120)
        assert query.exception() is None
        return spark.read.parquet(target)

    for n in range(3):
        rows(n).coalesce(1).write.mode("append").parquet(source)
    first = run().collect()
    assert sorted(r.id for r in first) == [0, 1, 2]
    assert all(isinstance(r.snapshot_time, dt.datetime) for r in first)
    rows(3).coalesce(1).write.mode("append").parquet(source)
    again = run()
    assert sorted(r.id for r in again.collect()) == [0, 1, 2, 3]
    newest = snapshots.latest_snapshots(again, "snapshot_time", 1).collect()
    assert [r.id for r in newest] == [3]


def test_cleaned_rules_shuffle_by_text_only(spark):
    sheets = spark.createDataFrame([(1, "a{x:1;y:2} a{x:1;y:2} b{x:1} a{x:3}"), (2, "a{x:1} a{y:1} a{x:1;y:2}")], "id int, text string")
    found = text.clean_rules(sheets, "id", "text")
    # one for the windows, two for the order; there were over ten
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 3
    rows = [tuple(r) for r in found.select("id", "selector", "first_pos", "pos", "ordinal", "attribute", "value").collect()]
    assert rows == [
        (1, "a", 0, 0, 1, "x", "1"), (1, "a", 0, 0, 2, "y", "2"), (1, "a", 0, 3, 1, "x", "3"), (1, "b", 2, 2, 1, "x", "1"),
        (2, "a", 0, 0, 1, "x", "1"), (2, "a", 0, 1, 1, "y", "1"), (2, "a", 0, 2, 1, "y", "2"),
    ]
