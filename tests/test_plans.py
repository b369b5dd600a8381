"""Plan shapes: no single-partition exchange over row-sized input, no cartesian
products, broadcast where the operator says so, pushed-down projections."""
import pytest

import __spark_entry__ as E
from conftest import SF01
from textstrata.plans.bindings import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Single-partition steps are allowed only over aggregated tables: one-row
# global aggregates of per-task partial results, or windows over one row per
# label / label combination, cut-off, epoch or range of a running total.
BOUNDED_SINGLE_PARTITION = {"argmax_accuracy", "association", "association_orders", "best_cutoffs", "best_epoch", "class_weights", "op13_importance",
                            "group_sizes", "labels_by_first_seen", "metric_trio", "weighted_ce"}


@pytest.mark.parametrize("name", sorted(set(E.oracle_sql()) | {"stratified_split", "idem_expand"}))
def test_no_cartesian_and_no_single_partition_over_rows(spark, name):
    p = plan(E.queries()[name](spark, SF01))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    if "SinglePartition" in p:
        assert name in BOUNDED_SINGLE_PARTITION, name


def test_split_broadcasts_thresholds_and_reads_two_columns(spark):
    p = plan(E.queries()["stratified_split"](spark, SF01))
    assert "BroadcastHashJoin" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderpriority:string>" in p


def test_pick_is_row_local(spark):
    p = plan(E.queries()["pick_labels"](spark, SF01))
    assert "Exchange" not in p


# The library's own operators; the optional subpackage sets its own rule per operator.
@pytest.mark.parametrize("name", sorted(set(E.oracle_sql()) & set(QUERIES)))
def test_sql_checked_queries_stay_in_the_jvm(spark, name):
    p = plan(E.queries()[name](spark, SF01))
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert node not in p, (name, node)
