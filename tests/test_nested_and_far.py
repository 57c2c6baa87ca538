"""Nested style rules against a plain parser, first touches far on against a plain scan."""

import random
import time

import pytest
from pyspark.sql import functions as F

from gapscan.catalog import queries as catalog
from gapscan.operators import forward, text
from gapscan.sources.bars import bars as typed_bars
from gapscan.sources.bars import dedupe_bars

from helpers import bar, frame, random_bars

BLANKS = " \t\n\r\f\x0b"


def parsed(css):
    """(pos, depth, path, selector, attribute, value) of each declaration, by a stack."""
    out, stack, said, pos = [], [], "", 0
    for ch in css:
        if ch not in "{};":
            said += ch
            continue
        stretch = said.strip(BLANKS)
        if ch == "{":
            stack.append(stretch)
        elif stack and ":" in stretch:
            name, _, value = stretch.partition(":")
            out.append((pos, len(stack), stack[:-1], stack[-1], name.strip(BLANKS), value.strip(BLANKS)))
        if ch == "}" and stack:
            stack.pop()
        said, pos = "", pos + 1
    return out


def test_nested_rules_equal_a_parser(spark):
    rng = random.Random(4)
    texts = ["", "{", "}", "a{b:c", "@media x { .a { b: c; d : e:f } g: h } i: j;", "}}a{b:c}", "a{b:c}}d{e:f;", "a{}b{c:d}", "{{x:y}z:w}", "import x; a { b }", ";;{;:;}"]
    texts += ["".join(rng.choices(["{", "}", "a", "b:c", " ", "\n", ";", "é"], k=rng.randint(1, 40))) for _ in range(800)]
    table = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "id int, css string").repartition(4)
    found = {}
    for r in text.nested_rules(table, "id", "css").collect():
        found.setdefault(r.id, []).append((r.pos, r.depth, r.path, r.selector, r.attribute, r.value))
    assert {i: sorted(rows) for i, rows in found.items()} == {i: parsed(t) for i, t in enumerate(texts) if parsed(t)}
    assert text.nested_rules(table.limit(0), "id", "css").count() == 0


def test_nested_rules_agree_with_flat_ones(spark):
    css = "a { b: c; d: e } .x, .y { f: g; }\n@page { h: i }"
    table = spark.createDataFrame([(1, css)], "id int, css string")
    flat = [(r.selector, r.attribute, r.value) for r in text.extract_rules(table, "css").orderBy("pos", "declaration_pos").collect()]
    nested = [(r.selector, r.attribute, r.value) for r in text.nested_rules(table, "id", "css").orderBy("pos").collect()]
    assert flat == nested and len(flat) == 4


def test_long_nested_texts(spark):
    unit = "".join(f".l{i} {{ p{i}: {i}; " for i in range(50)) + "}" * 50
    deep = spark.createDataFrame([(1, unit * (1_000_000 // len(unit)))], "id int, css string")
    text.nested_rules(deep.where("id = 0"), "id", "css").count()
    for css, rules in (("{" * 2000, 0), ("}" * 300_000 + "a{b:c}", 1), ("x" * 1_000_000, 0)):
        start = time.time()
        assert text.nested_rules(spark.createDataFrame([(1, css)], "id int, css string"), "id", "css").count() == rules
        assert time.time() - start < 20
    start = time.time()
    assert text.nested_rules(deep, "id", "css").where("size(path) = 49").count() == 1_000_000 // len(unit)
    assert time.time() - start < 20
    plan = text.nested_rules(deep, "id", "css")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def touch_by_scan(path, i, level, up, bars=None, days=None):
    ahead = path[i + 1 :] if bars is None else path[i + 1 : i + 1 + bars]
    for n, r in enumerate(ahead, 1):
        if days is not None and (r.date - path[i].date).days > days:
            return None
        price = r.low if up else r.high
        if price is not None and (price <= level if up else price >= level):
            return n
    return None


@pytest.mark.parametrize("horizon", [{"bars": 1}, {"bars": 10}, {"bars": 63}, {"bars": 64}, {"bars": 250}, {"days": 1}, {"days": 90}, {"days": 400}])
@pytest.mark.parametrize("mode", ["up", "down"])
def test_far_touches_equal_a_scan(spark, mode, horizon):
    rows = [r if random.Random(i).random() > 0.05 else (*r[:3], None, None, *r[5:]) for i, r in enumerate(random_bars(8, symbols=("A", "B"), days=330))]
    rows += [bar("C", 5, 10.0)]
    unique = dedupe_bars(typed_bars(frame(spark, rows))).withColumn("level", F.expr("if(xxhash64(symbol, date) % 3 = 0, null, close * (1 + (xxhash64(date) % 100) / 400D))"))
    found = {(r.symbol, r.date): r.touch for r in forward.far_touch(unique, "level", mode, **horizon).collect()}
    history = {}
    for r in unique.orderBy("date").collect():
        history.setdefault(r.symbol, []).append(r)
    wanted = {(s, r.date): touch_by_scan(path, i, r.level, mode == "up", **horizon) for s, path in history.items() for i, r in enumerate(path) if r.level is not None}
    assert found == wanted


def test_far_touch_needs_few_columns_and_a_horizon(spark):
    table = frame(spark, [bar("A", n, 10.0 + n) for n in range(5)]).withColumn("level", F.lit(9.0))
    plan = forward.far_touch(table, "level", "up", bars=250)._jdf.queryExecution().optimizedPlan().toString()
    assert "lead" not in plan.lower() and plan.count("low") < 20
    assert forward.far_touch(table.limit(0), "level", "up", bars=250).count() == 0
    for bad in ({}, {"bars": 5, "days": 5}, {"bars": 0}):
        with pytest.raises(ValueError):
            forward.far_touch(table, "level", "up", **bad)
    with pytest.raises(ValueError):
        forward.far_touch(table, "level", "both", bars=5)


def test_far_touches_of_both_modes_come_from_one_pass(spark, tmp_path):
    unique = dedupe_bars(typed_bars(frame(spark, random_bars(9, symbols=("A", "B"), days=200)))).withColumn("level", F.expr("close * 1.02"))
    both = forward.far_touches(unique, {"up": "level", "down": "level"}, bars=60).collect()
    single = [(m, *r) for m in ("up", "down") for r in forward.far_touch(unique, "level", m, bars=60).collect()]
    assert sorted(map(tuple, both), key=repr) == sorted(single, key=repr)
    lines = spark.range(50).selectExpr("1 + id % 2 as l_suppkey", "100D + id as l_extendedprice", "1D as l_quantity", "timestamp '2020-01-01' + make_interval(0, 0, 0, int(id)) as l_shipdate")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = catalog.QUERIES["first_touch_250"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "Join" not in plan  # lines, and lines by date for the benchmark
