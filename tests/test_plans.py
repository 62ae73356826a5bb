"""Plan checks: pruned scans, pushed filters, no single-partition exchange
on fact tables for the partitioned operators."""
from quarry.operators.sequence import lag_features
from quarry.operators.split import split_stratified
from quarry.session import table

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_profile_reads_only_selected_columns(spark):
    from quarry.functions.stats import _long
    from quarry.operators.profile import profile_nulls

    li = table(spark, SF, "lineitem")
    assert "ReadSchema: struct<l_quantity:double,l_discount:double>" in _plan(profile_nulls(li, ["l_quantity", "l_discount"]))
    # the exact-quantile passes scan only the profiled columns too
    assert "ReadSchema: struct<l_quantity:double,l_discount:double>" in _plan(_long(li, ["l_quantity", "l_discount"]))


def test_filter_pushed_to_scan(spark):
    from pyspark.sql import functions as F

    p = _plan(table(spark, SF, "orders").where(F.col("o_orderstatus") == "P").select("o_orderkey"))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,P)]" in p


def _single_partition_inputs(plan: str) -> list[str]:
    lines = plan.splitlines()
    return [lines[i + 1] for i, ln in enumerate(lines) if "Exchange SinglePartition" in ln]


def test_lags_and_splits_avoid_single_partition(spark):
    """Only the small per-bucket count tables may meet in one partition
    (a global series / split has a constant group key); fact rows never do."""
    ev = table(spark, SF, "events")
    o = table(spark, SF, "orders").select("o_orderkey", "o_orderpriority")
    for df in (lag_features(ev, ["value"], "value", "ts", "event_id", None, 10, 1),
               lag_features(ev, ["value"], "value", "ts", "event_id", "user_id", 10, 1),
               split_stratified(o, "o_orderkey", "o_orderpriority")):
        for child in _single_partition_inputs(_plan(df)):
            assert "HashAggregate" in child, child
