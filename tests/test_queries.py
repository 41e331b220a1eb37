"""All registered queries against their SQL, and the shape of their plans."""

import os

import pytest

from workload import ORACLES, QUERIES
from workload.compare import compare, connect

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not found")
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_rows_equal_the_sql_without_pairing_all_rows(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert compare(df.toArrow(), con.sql(ORACLES[name]).to_arrow_table()) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_nearest_resize_and_ribbons_do_not_shuffle(spark):
    from orograph.operators import placement, resample

    pixels = spark.range(100).selectExpr("1 AS tile", "id % 10 AS x", "id div 10 AS y", "1 AS v")
    plan = resample.resample_nearest(pixels, ["tile"], 10, 10, 7, 23)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    roads = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 1.0)], 2.0)], "id int, points array<struct<x: double, z: double>>, width double")
    assert "Exchange" not in placement.road_ribbon_edges(roads)._jdf.queryExecution().executedPlan().toString()


def test_slope_shuffles_once(spark):
    from orograph.operators import surface

    pixels = spark.range(100).selectExpr("id % 3 AS tile", "id % 10 AS x", "id div 10 AS y", "CAST(id AS DOUBLE) AS z")
    plan = surface.slope_grid(pixels, ["tile"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def joins(df) -> str:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return " ".join(word for word in plan.split() if word.endswith("Join"))


@pytest.mark.parametrize("name", ["existing_masks_only", "heightmap_fallback"])
def test_listings_are_not_taken_for_small_tables(spark, name):
    assert "Broadcast" not in joins(QUERIES[name](spark, SF))


def test_tags_of_features_are_not_taken_for_a_small_table(spark):
    from workload.base import features

    assert joins(features(spark, SF)).split() == ["SortMergeJoin"]


def test_lines_of_files_are_not_taken_for_a_small_table(spark):
    from workload import exports

    tiles = spark.range(4).selectExpr("10 AS z", "id AS tile_x", "id AS tile_y")
    made = exports.files(spark, SF, tiles, exports.WEB, 256, exports.HEIGHT_RGB, "false")
    assert joins(made).split() == ["SortMergeJoin"]


def test_blocked_pixels_are_not_taken_for_a_small_table(spark):
    from orograph.operators import masks

    pixels = spark.range(100).selectExpr("id % 3 AS tile", "id % 10 AS x", "id div 10 AS y", "255 AS v")
    tiles = pixels.select("tile").distinct()
    assert joins(masks.subtract_masks(pixels, pixels, pixels, ["tile"], tiles, tiles)).startswith("SortMergeJoin")


def test_tags_of_given_features_are_not_broadcast(spark):
    """They are written for manifests and packages, beside queries whose own plan starts at what was written."""
    from workload.base import features

    plan = features(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_features_of_manifests_are_written_without_a_broadcast(spark, monkeypatch):
    """The plans of the stages that the query itself writes: its own plan starts behind them."""
    from orograph.plans.stages import StageStore

    keep, plans = StageStore.keep, {}

    def watched(self, name, df):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep(self, name, df)

    monkeypatch.setattr(StageStore, "keep", watched)
    QUERIES["write_manifests"](spark, SF)
    assert "SortMergeJoin" in plans["given_features"] and "Broadcast" not in plans["given_features"]
