"""Plan checks: no Python in any report plan; scans pruned and filtered."""

import os

import pytest

from cxlens.plans import all_reports
from cxlens.plans.order_view import materialize_order_view
from cxlens.sources import read_parquet_tables, write_tables

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
                "PythonUDF")


def _physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def loaded(spark, fixture_tables, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("warehouse"))
    write_tables(fixture_tables, os.path.join(root, "tables"))
    tables = read_parquet_tables(spark, os.path.join(root, "tables"))
    materialize_order_view(tables, os.path.join(root, "view"))
    return tables, spark.read.parquet(os.path.join(root, "view"))


@pytest.mark.parametrize("name", sorted(all_reports()))
def test_no_python_in_plan(loaded, name):
    tables, view = loaded
    rep = all_reports()[name]
    plan = _physical(rep.run(tables, view=None if rep.uses is None else view))
    assert not [n for n in PYTHON_NODES if n in plan]


def test_view_scan_is_pruned_and_filtered(loaded):
    tables, view = loaded
    rep = all_reports()["late_detractor_by_bucket"]
    plan = _physical(rep.run(tables, view))
    assert "PushedFilters: [IsNotNull(review_score)]" in plan
    assert "ReadSchema: struct<delivery_bucket:string,review_score:int,is_detractor:int,is_promoter:int>" in plan


def test_lazy_view_report_reads_only_needed_tables(loaded):
    tables, _ = loaded
    plan = _physical(all_reports()["rc_distribution"].run(tables))
    assert "payment_installments" not in plan and "customer_state" not in plan


def test_sequence_uses_partial_top_k(loaded):
    tables, view = loaded
    plan = _initial_plan(all_reports()["rpt_root_cause_sequence"].run(tables, view))
    # A partial limit below the shuffle on customer, and the final one above it.
    limits = [n for n in _walk(plan) if n.nodeName() == "WindowGroupLimit"]
    assert len(limits) == 2
    partial_below_exchange = any(
        k.nodeName() == "Exchange" and any(x.nodeName() == "WindowGroupLimit" for x in _walk(k))
        for k in _walk(plan))
    assert partial_below_exchange


def test_materialised_view_round_trips(loaded):
    tables, view = loaded
    from cxlens.plans import order_analysis
    assert view.count() == order_analysis(tables).count()


AGGS = ("HashAggregate", "ObjectHashAggregate", "SortAggregate")


def _children(node):
    kids = node.children()
    return [kids.apply(i) for i in range(kids.size())]


def _walk(node):
    yield node
    for k in _children(node):
        yield from _walk(k)


def _initial_plan(df):
    plan = df._jdf.queryExecution().executedPlan()
    return plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan


def _aggregated_before_scan(node) -> bool:
    """Every path from ``node`` down to a file scan passes an aggregate."""
    name = node.nodeName()
    if name.startswith(AGGS):
        return True
    if "Scan" in name:
        return False
    return all(_aggregated_before_scan(k) for k in _children(node))


ENTITIES = ("seller_id", "customer_unique_id", "order_id", "product_id", "customer_id")


def _one_row_per_entity(node) -> bool:
    """Whether what ``node`` hands on still has a row for each entity."""
    name = node.nodeName()
    if name.startswith(AGGS):
        return any(e in node.groupingExpressions().toString() for e in ENTITIES)
    return any(_one_row_per_entity(k) for k in _children(node))


def _one_row(node) -> bool:
    """A global aggregate (no grouping keys) under filters/projections/exchanges."""
    name = node.nodeName()
    if name.startswith(AGGS):
        return node.groupingExpressions().isEmpty()
    kids = _children(node)
    return len(kids) == 1 and _one_row(kids[0])


@pytest.mark.parametrize("name", sorted(all_reports()))
def test_scale_rules_in_plan(loaded, name):
    tables, view = loaded
    rep = all_reports()[name]
    plan = _initial_plan(rep.run(tables, view=None if rep.uses is None else view))
    for node in _walk(plan):
        n = node.nodeName()
        assert "CartesianProduct" not in n
        if n == "Exchange" and "SinglePartition" in node.outputPartitioning().toString():
            assert _aggregated_before_scan(node), f"single-partition shuffle of raw rows in {name}"
            assert not _one_row_per_entity(node), f"single-partition shuffle that grows with an entity in {name}"
        if n == "BroadcastNestedLoopJoin":
            build = _children(node)[1]
            assert _one_row(build), f"nested-loop join without a one-row side in {name}"


def test_month_partitioned_view_round_trips(spark, loaded, tmp_path):
    from cxlens.plans import order_analysis
    from cxlens.plans.order_view import read_order_view
    tables, _ = loaded
    materialize_order_view(tables, str(tmp_path / "by_month"), partition_by=("order_month",))
    back = read_order_view(spark, str(tmp_path / "by_month"))
    for month in (tmp_path / "by_month").glob("order_month=*"):
        assert len(list(month.glob("*.parquet"))) <= 2
    lazy = order_analysis(tables)
    assert back.dtypes == lazy.dtypes
    assert back.exceptAll(lazy).count() == 0 and lazy.exceptAll(back).count() == 0
