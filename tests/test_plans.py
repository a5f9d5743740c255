"""Physical plans: what is pushed down, what is not shuffled, what stays in the JVM."""

import contextlib
import io

from pyspark.sql import functions as F

from ratelake.operators import pricing, query
from ratelake.plans import relational as R


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    p = f"file://{tmp_path}/p"
    spark.range(100).select(F.col("id").alias("product_id"), F.lit("L").alias("lender"), F.lit("Fixed").alias("rate_type"), (F.col("id") / 10).alias("rate"), F.lit("x" * 100).alias("body")).write.parquet(p)
    text = plan(query.products(spark.read.parquet(p), min_rate=2.0, max_rate=3.0).select("product_id", "rate"))
    assert "GreaterThanOrEqual(rate,2.0)" in text and "LessThanOrEqual(rate,3.0)" in text
    assert "body" not in text.split("ReadSchema")[1].split("\n")[0]
    assert "TakeOrderedAndProject" in text


def test_the_four_states_are_no_join(spark):
    text = plan(pricing.theoretical(spark.range(5).select(F.col("id").alias("product_id"))))
    assert "Generate" in text and "Join" not in text and "Exchange" not in text


def test_no_python_and_no_cartesian_product_in_relational_queries(spark, sf):
    for q in (R.closed_world_matrix, R.rate_by_lvr, R.rate_by_axes, R.merge_by_name, R.quality_issues, R.hash_dedupe, R.matrix3_missing, R.product_match, R.strategy_select):
        text = plan(q(spark, sf))
        assert "Python" not in text and "CartesianProduct" not in text and "InArrow" not in text, q.__name__


def scans(text: str) -> int:
    return text.count("lineitem.parquet]")


def test_one_pass_plans(spark, sf):
    """One scan of the components for the closed world, two with the tiers' checks; no sort-based
    aggregate."""
    for q, most in ((R.closed_world_matrix, 1), (R.state_explicit_doc, 1), (R.quality_summary, 2), (R.quality_issues, 2), (R.hash_dedupe, 1), (R.component_dedupe, 1), (R.merge_by_name, 1)):
        text = q(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert 1 <= scans(text) <= most, q.__name__
        assert "SortAggregate" not in text, q.__name__


def test_firsts_are_limited_before_the_shuffle(spark, sf):
    text = R.hash_dedupe(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2


def test_lookups_aggregate_before_the_shuffle(spark, sf):
    text = plan(R.band_conflicts(spark, sf))
    assert text.count("HashAggregate") >= 2 and "Window" not in text
