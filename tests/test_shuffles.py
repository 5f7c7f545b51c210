"""How often rows are shuffled and windows are made: plans, with no broadcast."""

from __future__ import annotations

import pytest

from tidemark.plans.queries import QUERIES, Models


@pytest.fixture
def plan(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_order_items_are_shuffled_once(spark, sf, plan):
    text = plan(Models(spark, sf)["stg_order_items"])
    assert text.count("Exchange hashpartitioning") == 2  # items, and the orders that they are held against


def test_the_ids_of_order_items_are_made_once(spark, sf, plan):
    assert "row_number" not in plan(QUERIES["inc_order_items"](spark, sf))
