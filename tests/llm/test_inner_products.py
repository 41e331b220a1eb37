"""Top-k inner products against all products."""

import math
import random

import numpy as np
import pytest

from orograph.llm import inner_products
from orograph.llm.queries import QUERIES
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>"


def held(score):
    return max(-(2 ** 63 - 1), min(2 ** 63 - 1, score))


def plain(rows, k=5):
    """(query id, rank, id, score) of all queries; the rows of one id are told apart by their index."""
    usable = [
        (n, i, [math.floor(256 * float(np.float32(x))) for x in v]) for n, (i, v) in enumerate(rows)
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for n, i, q in usable:
        if i is not None and i % 50 == 0:
            scores = [(-held(sum(a * b for a, b in zip(q, v))), j is None, j or 0, j) for m, j, v in usable if m != n and len(v) == len(q)]
            out += [(i, rank, j, -s) for rank, (s, _, _, j) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def found(spark, rows, k=5):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "1 AS id", "2 AS v", "3 AS norm", "4 AS row", "5 AS score", "6 AS rank")
    return sorted(map(tuple, inner_products.top_products(df, F.col("id") % 50 == 0, k).collect()), key=repr)


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(inner_products, "GROUP", 60)
    monkeypatch.setattr(inner_products, "BUCKET", 16)
    monkeypatch.setattr(inner_products, "SEEDS", 8)


@pytest.mark.parametrize("spread", [0.0, 1.0, 3.0])
def test_equals_all_products(spark, small, spread):
    rng = np.random.default_rng(int(spread * 10))
    v = rng.normal(size=(700, 8)) * np.exp(spread * rng.normal(size=(700, 1)))
    v[rng.random(700) < 0.3] = v[0]  # many equal vectors
    v[300:400] = v[50:150] * 1.01
    v[600:] = 0
    rows = list(zip(range(700), v.astype(np.float32).tolist()))
    random.Random(1).shuffle(rows)
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, 1) == plain(rows, 1)


def test_odd_rows(spark, small):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, [0.5, -1.0]), (100, None), (150, [1.0, None]), (200, [nan, 1.0]), (250, [inf, 1.0]), (300, []), (350, []),
        (400, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]), (None, [1.0, 2.0]), (7, [1.0, 2.0]), (-50, [-1.0, -2.0]), (9, [1e30, 1e30]), (450, [1e30, 1.0]), (11, [-1e30, 0.0]),
    ]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == [] and found(spark, [(1, [1.0])]) == [] and found(spark, [(0, [1.0])]) == []


def test_pruning_by_coordinates_loses_nothing():
    rng = np.random.default_rng(3)
    unit = rng.normal(size=(4000, 6))
    unit[:2000] = unit[0] + 0.3 * unit[:2000]
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for q in [unit[0], np.eye(6)[2], -np.eye(6)[2]]:
        for t in (0.9, 0.95, 0.999, 1.0):
            stays = inner_products.feasible(q, t, unit)
            assert stays[unit @ q >= t].all() and stays.sum() < 3000


def test_the_query_equals_all_products(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op12_exact_top_k"](spark, sf).collect()), key=repr) == plain(rows)
