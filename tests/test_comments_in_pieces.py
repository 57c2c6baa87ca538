"""Comments of texts in pieces: any cutting gives what the whole text gives."""

import random
import re

from pyspark.sql import functions as F

from gapscan.operators import text


def cut(rng, whole, n):
    places = sorted(rng.randrange(len(whole) + 1) for _ in range(n - 1))
    return [whole[a:b] for a, b in zip([0, *places], [*places, len(whole)])]


def test_any_cutting_gives_the_whole_result(spark):
    rng = random.Random(6)
    texts = ["", "/", "*", "/*", "*/", "/*/", "/**/", "/*/*/", "*/*", "a/*b*/c", "a/*b", "a*/b/*c*/d/*e", "//**//", "/*a*/*b*/", "/" * 30, "/*" * 20, "*/" * 20, "/*/" * 15, "x/*y*//*z"]
    texts += ["".join(rng.choices(["/", "*", "/*", "*/", "a", "\n", "é"], k=rng.randrange(40))) for _ in range(600)]
    rows = []
    for i, whole in enumerate(texts):
        parts = cut(rng, whole, rng.randrange(1, 9))
        if rng.random() < 0.2:
            parts = list(whole) or [""]
        rows += [(i, 3 * k + 1, part if part or rng.random() < 0.5 else None) for k, part in enumerate(parts)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "id int, no int, css string").repartition(6)
    found = {}
    for r in text.strip_comments_in_pieces(table, "id", "no", "css").collect():
        found.setdefault(r.id, []).append((r.no, r.css))
    assert sorted((i, no) for i, parts in found.items() for no, _ in parts) == sorted((i, no) for i, no, _ in rows)
    for i, whole in enumerate(texts):
        assert "".join(part for _, part in sorted(found[i])) == re.sub(text.COMMENT_PATTERN, "", whole), (i, whole)


def test_one_text_of_many_pieces_and_none(spark):
    pieces = spark.range(5000).selectExpr("cast(null as int) as id", "id as no", "case id % 5 when 0 then 'a/' when 1 then '*b' when 2 then repeat('c', 50) when 3 then 'd*' else '/e' end as css")
    found = text.strip_comments_in_pieces(pieces, "id", "no", "css")
    assert found.count() == 5000 and found.agg(F.sum(F.length("css"))).first()[0] == 2 * 1000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan
    assert text.strip_comments_in_pieces(pieces.limit(0), "id", "no", "css").count() == 0
