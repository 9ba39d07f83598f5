import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import hard_negatives as H


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 64, 300), (33, 17, 40), (200, 130, 97), (64, 64, 64), (16, 0, 16)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(3)
    m, d, n = shape
    a, b = rng.integers(-2**27, 2**27, (m, d)), rng.integers(-2**27, 2**27, (d, n))
    assert (H.strassen(a, b) == a @ b).all() and H.strassen(a, b).shape == (m, n)


def brute(rows, anchor, n_pos=5, n_neg=10, low=30, high=90):
    live = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows
            if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, lab, v) in enumerate(live):
        if not anchor(i):
            continue
        others = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for k, (j, other, w) in enumerate(live) if k != at)
        for s, j, other in [o for o in others if o[2] == lab][:n_pos]:
            window = [o for o in others if o[2] != lab and low * -s <= 100 * -o[0] <= high * -s][:n_neg]
            out += [(i, j, r + 1, o[1], -s, -o[0]) for r, o in enumerate(window)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, label int, tag string, v int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "z", 1) for i, v, lab in rows], SCHEMA)


@pytest.mark.parametrize("tile,block", [(7, 4), (1024, 1024)])
def test_against_brute_force(spark, monkeypatch, tile, block):
    monkeypatch.setattr(H, "TILE_ROWS", tile)
    monkeypatch.setattr(H, "ANCHOR_ROWS", block)
    rng = random.Random(11)
    rows = [(i, [rng.choice([-0.5, -0.25, 0.0, 0.125, 0.5, 1.0]) for _ in range(6)], rng.randint(0, 3)) for i in range(200)]
    rows += [(300, None, 1), (301, [1.0] * 6, None), (302, [None] + [1.0] * 5, 1), (303, [math.nan] * 6, 1), (304, [math.inf] * 6, 1),
             (None, [1.0] * 6, 1), (305, [], 1), (306, [1.0, 1.0], 2), (310, [0.0] * 6, 3), (320, [100.0] * 9, 0)]
    got = sorted(map(tuple, H.mine(frame(spark, rows).repartition(5), F.col("id") % 10 == 0).collect()))
    assert got == brute(rows, lambda i: i % 10 == 0) and got


def test_repeated_rows_and_a_common_vector(spark):
    """A third of all rows hold one vector, some ids come twice."""
    rng = random.Random(2)
    rows = [(i, [1.0, 0.5, 0.25], i % 3) for i in range(150)] + [(i, [rng.uniform(0, 1) for _ in range(3)], i % 3) for i in range(150, 450)]
    rows += rows[:40] + rows[200:220]
    got = sorted(map(tuple, H.mine(frame(spark, rows).repartition(4), F.col("id") % 50 == 0).collect()))
    assert got == brute(rows, lambda i: i % 50 == 0) and got


def test_empty(spark):
    rows = [(1, [1.0], 1), (2, [1.0], 2)]
    assert H.mine(frame(spark, rows).limit(0), F.col("id") >= 0).count() == 0
    assert H.mine(frame(spark, rows), F.col("id") > 5).columns == H.mine(frame(spark, rows), F.col("id") > 0).columns
