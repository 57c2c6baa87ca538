"""Hard negatives against all pairs in whole numbers."""

import math

import numpy as np
import pytest

from gapscan.llm import hard_negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int, score string, rank string"


def plain(table, step=50):
    taken = []
    for vec_id, x, label, *_ in table:
        if vec_id is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        taken.append((vec_id, [math.floor(256 * v) for v in x], int(math.fmod(label + 1, 10)) if vec_id % 7 == 0 else label))
    out = []
    clipped = lambda s: max(-(2**63) + 1, min(2**63 - 1, s))
    for k, (anchor, a, label) in enumerate(taken):
        if anchor % step:
            continue
        found = [(-clipped(sum(p * q for p, q in zip(a, b))), other, i, own) for i, (other, b, own) in enumerate(taken) if i != k and len(a) == len(b)]
        found.sort(key=lambda f: f[:3])
        for score, positive, _, own in [f for f in found if f[3] == label][:5]:
            ps = -score
            fitting = [f for f in found if f[3] != label and 50 * ps <= -100 * f[0] <= 95 * ps][:3]
            out += [(anchor, positive, rank, f[1], ps, -f[0]) for rank, f in enumerate(fitting, 1)]
    return sorted(out)


def mined(spark, table, **options):
    df = spark.createDataFrame([(*row, "own", "own")[:5] for row in table], SCHEMA).repartition(4)
    return sorted(map(tuple, hard_negatives.mine(df, **options).collect()))


def clustered(seed, n, dim=16, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (labels, dim)) + 0.5
    return [(i, (centres[i % labels] + rng.normal(0, 0.7, dim)).round(3).tolist(), i % labels) for i in range(n)]


@pytest.mark.parametrize("dim", [1, 3, 16, 40])
def test_mining_equals_all_pairs(spark, dim):
    table = clustered(dim, 700, dim)
    expected = plain(table)
    assert mined(spark, table) == expected and expected


def test_small_groups_and_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS_A_TASK", 40)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BYTES", 900)
    table = clustered(5, 400)
    assert mined(spark, table, anchor_step=5) == plain(table, 5)


def test_one_hot_label_many_equal_vectors_and_awkward_rows(spark):
    table = [(i, [1.0, 2.0, -0.5], 1) for i in range(300)] + [(1000 + i, [0.5, 1.0, 0.1 * (i % 7)], i % 3) for i in range(200)]
    table += [(50, None, 1), (100, [1.0, None, 2.0], 1), (150, [math.nan, 1.0, 1.0], 1), (200, [1.0, math.inf, 1.0], 0), (None, [1.0, 1.0, 1.0], 1)]
    table += [(2000, [], 1), (2001, [], 1), (2002, [], 2), (2050, [0.0, 0.0, 0.0], 1), (-50, [1.0, 2.0, 3.0], -1), (-49, [1.0, 2.0, 3.0], -1), (3000, [1.0, 2.0], 1), (3001, [1.0, 1.5], 1), (3003, [0.6, 1.2], 2)]
    table += [(4000, [1.0, 1.0, 1.0], None)]
    expected = plain(table)
    assert mined(spark, table) == expected and {a for a, *_ in expected} >= {50, 3000}


def test_huge_and_tiny_components(spark):
    table = clustered(9, 150, 6) + [(5000, [1e17] * 6, 0), (5001, [2e9, -3e8, 1.0, 5.0, 1e-300, 0.0], 0), (5050, [1e30, -1e30, 1e12, 0.0, 1.0, 1.0], 1), (5051, [1e9] * 6, 1), (5052, [7e8] * 6, 2)]
    assert mined(spark, table) == plain(table)


def test_equal_ids_are_rows_of_their_own(spark):
    table = [(50, [1.0, 1.0], 1), (50, [1.0, 1.0], 1), (51, [0.9, 1.0], 1), (52, [0.8, 0.6], 2), (52, [0.8, 0.6], 2), (53, [0.7, 0.6], 2)]
    assert mined(spark, table) == plain(table)


def test_empty_table(spark):
    assert mined(spark, []) == []


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for dim in (1, 5, 64):
        v = np.floor(rng.normal(0, 300, (60, dim)))
        summary = hard_negatives.summaries(v)
        block = hard_negatives.Block(dim, *[np.arange(60)] * 3, [x.tobytes() for x in v], [x.tobytes() for x in summary])
        exact, widths = v @ v.T, []
        for means, deviations in block.levels:
            middle, spread = means @ means.T, deviations @ deviations.T + 1e-6
            assert (exact >= middle - spread).all() and (exact <= middle + spread).all()
            widths.append(spread.mean())
        assert widths == sorted(widths, reverse=True)
