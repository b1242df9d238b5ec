"""Physical plans: no all-pairs products, no Python in relational operators, hot keys spread out."""

import pytest

from checks.fixtures import cloud_lineitem
from checks.registry import QUERIES

PYTHON = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas")
WITH_PYTHON = {"knn_distance", "ms_bandwidth", "features_training", "features_extractor", "surface_atoms",
               "surface_distance"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "centroid", "center", "pca_aligned", "grid_gradients", "spatial_entropy", "radial_stats", "radius_pairs",
    "radius_pairs_pbc", "nearest_site_pbc", "ws_summary", "ws_vacancies", "ws_interstitials", "features_training",
    "method_comparison", "surface_atoms"])
def test_no_products(spark, small_sf, name):
    plan = plan_of(QUERIES[name](spark, small_sf))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in WITH_PYTHON:
        assert not any(node in plan for node in PYTHON)


def test_points_are_pruned_to_needed_columns(spark, small_sf):
    from voidscope.operators.alignment import centroid
    from voidscope.operators.dataset import vacancy_target

    points = cloud_lineitem(spark, small_sf)
    assert "ReadSchema: struct<snapshot_id:bigint>" in plan_of(vacancy_target(points))
    assert "ReadSchema: struct<snapshot_id:bigint,x:double,y:double,z:double>" in plan_of(centroid(points))


def test_statistics_join_is_chunked_when_not_broadcast(spark, small_sf):
    from voidscope.operators.alignment import center

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = center(cloud_lineitem(spark, small_sf))
        plan = plan_of(df)
        assert "SortMergeJoin [snapshot_id" in plan and "chunk" in plan
        assert df.count() == cloud_lineitem(spark, small_sf).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_sampling_limits_before_the_shuffle(spark, small_sf):
    from voidscope.operators.bandwidth import sample_points

    assert "WindowGroupLimit" in plan_of(sample_points(cloud_lineitem(spark, small_sf)))


def test_results_do_not_depend_on_broadcast(spark, small_sf):
    from checks.compare import connect, differences
    from checks.registry import ORACLES

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("features_training", "nearest_site_pbc", "ws_vacancies", "dump_scan"):
            assert differences(QUERIES[name](spark, small_sf), connect(small_sf), ORACLES[name]) == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_nearest_lookup_shuffles_only_the_best(spark, small_sf, monkeypatch):
    """Where the served cells fit the threshold, points look their cells up in the task that reads them."""
    from checks.fixtures import boxes_supplier, reference_box, sites_lattice
    from voidscope.operators import neighbors as nb

    plans = []
    lookup = nb._lookup_round
    monkeypatch.setattr(nb, "_lookup_round", lambda *a: plans.append(lookup(*a)) or plans[-1])
    args = (cloud_lineitem(spark, small_sf), sites_lattice(spark), boxes_supplier(spark, small_sf), reference_box())
    nb.nearest_site(*args).count()
    nb.nearest_site(*args, affine=True).count()
    nb.nearest_site(*args[:2], periodic=False).count()
    assert len(plans) == 3
    for best in plans:
        plan = plan_of(best)
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert plan.count("Exchange hashpartitioning") == 1 and "partial_min" in plan
