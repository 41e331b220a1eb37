"""Scattering against loops, with caps and crowded tiles."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orograph.operators import grids, scatter

from .test_expressions import mulberry

SETTINGS = scatter.ScatterSettings(density=0.25, cap=40, seed=9)
TILE = "tile int, width_m double, height_m double, offset_x double, offset_z double"


def tiles(spark, *rows):
    return spark.createDataFrame([(t, float(w), float(h), 0.0, 0.0) for t, w, h in rows], TILE)


def mask(spark, arrays):
    rows = [(t, x, y, int(v)) for t, a in arrays.items() for (y, x), v in np.ndenumerate(a) if v > 0]
    return spark.createDataFrame(rows, "tile int, x bigint, y bigint, v int")


def candidate_loop(w, h, s):
    spacing = 1 / math.sqrt(s.density)
    cols, rows = math.ceil(w / spacing), math.ceil(h / spacing)
    draws = mulberry(s.seed, 2 * rows * cols)
    out = []
    for i in range(rows * cols):
        r, c = divmod(i, cols)
        jx, jz = ((d * 2 - 1) * s.jitter * spacing / 2 for d in draws[2 * i:2 * i + 2])
        out.append((max(0, min(w, (c + 0.5) * spacing + jx)), max(0, min(h, (r + 0.5) * spacing + jz))))
    return out


def test_candidates_equal_the_loop(spark):
    got = {}
    for r in scatter.scatter_candidates(tiles(spark, (1, 23, 17), (2, 8.5, 3)), ["tile"], SETTINGS).collect():
        got[r["tile"], r["idx"]] = (r["px"], r["pz"])
    for t, w, h in ((1, 23, 17), (2, 8.5, 3)):
        want = candidate_loop(w, h, SETTINGS)
        assert len([k for k in got if k[0] == t]) == len(want)
        assert all(got[t, i] == pytest.approx(p) for i, p in enumerate(want))


def test_filter_and_exclusion(spark):
    rng = np.random.default_rng(2)
    plants, water = rng.integers(0, 256, (6, 8)), rng.integers(0, 2, (6, 8)) * 255
    found = scatter.scatter_filter(scatter.scatter_candidates(tiles(spark, (1, 30, 20)), ["tile"], SETTINGS), mask(spark, {1: plants}), ["tile"], 8, 6, 128, mask(spark, {1: water}))
    want = set()
    for i, (x, z) in enumerate(candidate_loop(30, 20, SETTINGS)):
        u, v = x / 30, 1 - z / 20
        mx, my = min(math.floor(u * 8), 7), min(math.floor(v * 6), 5)
        if water[my, mx] == 0 and plants[my, mx] >= 128:
            want.add(i)
    assert {r["idx"] for r in found.collect()} == want


def test_outside_reads_zero(spark):
    pts = spark.createDataFrame([(1, 1.5, 0.5), (1, -0.1, 0.5), (1, 1.0, 1.0), (1, 0.0, 0.0), (2, 0.5, 0.5)], "tile int, u double, v double")
    got = scatter.sample_mask_at_points(pts, mask(spark, {1: np.full((4, 4), 9)}), ["tile"], 4, 4, "u", "v").collect()
    assert {(r["tile"], r["u"]): r["mask_value"] for r in got} == {(1, 1.5): 0, (1, -0.1): 0, (1, 1.0): 9, (1, 0.0): 9, (2, 0.5): 0}


def numbered(spark, n, tile=1):
    return spark.range(n).select(F.lit(tile).alias("tile"), (F.col("id") * 3 + 1).alias("idx"))


def test_cap_is_exact_and_deterministic(spark):
    pts = numbered(spark, 5000).unionByName(numbered(spark, 20, 2)).unionByName(numbered(spark, 100, 3))
    runs = [sorted((r["tile"], r["idx"]) for r in scatter.cap_instances(pts.repartition(n), ["tile"], 100, 5, salts).collect()) for n, salts in ((1, 1), (7, 64))]
    assert runs[0] == runs[1]
    per = {t: [i for k, i in runs[0] if k == t] for t in (1, 2, 3)}
    assert {t: len(v) for t, v in per.items()} == {1: 100, 2: 20, 3: 100} and set(per[1]) <= {3 * i + 1 for i in range(5000)}


@pytest.mark.parametrize("block", [1, 10, 65536])
def test_numbers_without_one_task_per_key(spark, block):
    rng = random.Random(block)
    rows = [(k, v) for k in (1, 2, 3) for v in rng.sample(range(3000), 200 if k == 1 else 5)]
    got = grids.blocked_row_number(spark.createDataFrame(rows, "k int, v bigint"), ["k"], "v", "n", block).collect()
    for k in (1, 2, 3):
        assert [r["n"] for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["v"])] == list(range(1, sum(x == k for x, _ in rows) + 1))


def test_heights_between_grid_points(spark):
    a = np.random.default_rng(3).uniform(0, 100, (4, 4))
    grid = spark.createDataFrame([(1, x, y, float(a[y, x])) for x in range(4) for y in range(4)], "tile int, x bigint, y bigint, h double")
    pts = [(1, i, u, v) for i, (u, v) in enumerate([(0.0, 0.0), (1.0, 1.0), (0.5, 0.25), (-3.0, 0.4), (0.7, 9.0)])]
    got = {r["i"]: r["height"] for r in scatter.sample_height_at_points(spark.createDataFrame(pts, "tile int, i int, u double, v double"), grid, ["tile"], 3, "u", "v").collect()}
    for _, i, u, v in pts:
        gx, gz = min(max(u, 0), 1) * 3, min(max(v, 0), 1) * 3
        x, z = min(int(gx), 2), min(int(gz), 2)
        fx, fz = gx - x, gz - z
        want = (a[z, x] * (1 - fx) + a[z, x + 1] * fx) * (1 - fz) + (a[z + 1, x] * (1 - fx) + a[z + 1, x + 1] * fx) * fz
        assert got[i] == pytest.approx(want)


def test_whole_scatter(spark):
    t = tiles(spark, (1, 30, 20), (2, 30, 20))
    grid = spark.createDataFrame([(k, x, y, float(x + 10 * y)) for k in (1, 2) for x in range(5) for y in range(5)], "tile int, x bigint, y bigint, h double")
    plants = mask(spark, {1: np.full((6, 8), 200), 2: np.zeros((6, 8))})
    inst = scatter.scatter_instances(t, plants, grid, ["tile"], 8, 6, 4, SETTINGS)
    rows = inst.collect()
    assert len(rows) == 40 and {r["tile"] for r in rows} == {1}
    assert all(-15 <= r["world_x"] <= 15 and -10 <= r["world_z"] <= 10 and 0 <= r["y"] <= 44 for r in rows)
    mats = sorted(scatter.instance_transforms(inst, ["tile"], SETTINGS).collect(), key=lambda r: r["instance"])
    assert [r["instance"] for r in mats] == list(range(40)) and [r["idx"] for r in mats] == sorted(r["idx"] for r in rows)
    draws = mulberry(SETTINGS.seed + 2, 80)
    for i, r in enumerate(mats):
        m, s, a = r["matrix"], 0.6 + draws[2 * i] * (1.4 - 0.6), draws[2 * i + 1] * 2 * math.pi
        assert m[:11] == pytest.approx([s * math.cos(a), 0, s * math.sin(a), 0, 0, s, 0, 0, -s * math.sin(a), 0, s * math.cos(a)]) and m[15] == 1.0
    plain = scatter.instance_transforms(inst, ["tile"], scatter.ScatterSettings(seed=9, random_rotation=False)).collect()
    assert len(plain) == 40 and all(r["matrix"][2] == 0 and r["matrix"][0] == r["matrix"][5] for r in plain)


def test_more_vegetation_never_gives_fewer(spark):
    t, counts = tiles(spark, (1, 40, 40)), []
    for rows in (0, 2, 4, 8):
        a = np.zeros((8, 8))
        a[:rows] = 255
        found = scatter.scatter_filter(scatter.scatter_candidates(t, ["tile"], SETTINGS), mask(spark, {1: a}), ["tile"], 8, 8)
        counts.append(found.count())
    assert counts == sorted(counts) and counts[0] == 0 and counts[-1] == 400


def test_groups_with_a_bad_value_are_left_out(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, float("nan")]), (2, [0.0, 5.0]), (3, [float("inf"), 1.0])], "tile int, matrix array<double>")
    assert [r["tile"] for r in scatter.finite_groups(df, ["tile"]).collect()] == [2]
