"""Plans of the queries that build on running values: each reads its tables a bounded number of times."""

import uuid

import pytest

from rivulant.operators.numeric import prefix_sum, softmax
from rivulant.operators.symbols import undefined_launches
from rivulant.workload import all_queries

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def work_of(spark, build):
    """Jobs that start and rows that are read from tables while a query is built and read to its end."""
    tracker, group = spark.sparkContext.statusTracker(), f"work-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        build().write.format("noop").mode("overwrite").save()
        return len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("name, jobs", [("U4_new_resolved", 34), ("K2_evolve_items", 75), ("W3_iteration_trend", 40), ("N5_integral_image", 18), ("K3_rank_providers", 12)])
def test_queries_do_a_bounded_number_of_jobs(spark, name, jobs):
    """What runs while the frame is built counts too, not only what is left in its plan."""
    assert 0 < work_of(spark, lambda: all_queries()[name](spark, SF)) <= jobs


def test_rank_needs_no_single_task_over_the_rows(spark):
    """The only unkeyed window runs over one row per range."""
    from rivulant.plans.scan import range_rank

    plan = plan_of(range_rank(spark.range(10_000).selectExpr("id % 97 AS a", "id AS b"), ["a", "b"]))
    window = plan[plan.index("Window ") :]
    assert "HashAggregate" in window[: window.index("Scan")] and plan.count("SinglePartition") == 1


def test_softmax_without_keys_leaves_the_vector_in_place(spark):
    plan = plan_of(softmax(spark.range(100).selectExpr("id AS idx", "double(id) AS v"), []))
    assert "hashpartitioning" not in plan


def test_words_that_launch_nothing(spark):
    calls = spark.createDataFrame([("a", n) for n in ("if", "hipLaunchKernelGGL", "static_cast", "ghost", "known")], "path string, name string")
    defs = spark.createDataFrame([("a", "known")], "path string, name string")
    assert [r.name for r in undefined_launches(calls, defs, ["path", "name"]).collect()] == ["ghost"]


def test_held_input_is_read_twice_and_not_written(spark, tmp_path):
    """A prefix sum over files: same result, no table written, and the sums leave out columns they do not need."""
    path = str(tmp_path / "vec")
    spark.range(5000).selectExpr("id AS idx", "id % 13 AS v", "cast(id AS string) AS name").write.parquet(path)
    vec = spark.read.parquet(path)
    lazy, written = prefix_sum(vec, 64, held=True), prefix_sum(vec, 64)
    assert sorted(lazy.collect()) == sorted(written.collect())
    plan = plan_of(lazy)
    assert "ExistingRDD" not in plan and "ExistingRDD" in plan_of(written)
    assert "ReadSchema: struct<idx:bigint,v:bigint>" in plan and "ReadSchema: struct<idx:bigint,v:bigint,name:string>" in plan
