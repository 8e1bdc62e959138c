"""Plans of all lazily built queries: no products, no join on a constant, pruned scans."""

import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES = {n: q for n, q in entry.queries().items() if n != "pipeline" and not n.startswith("op")}
#: these write and read files, iterate or stream while they are built; what they run is seen in their own tests
EAGER = {"near_dup_lookup", "near_dup_prune", "sink_dedupe_audit", "funnel_news", "funnel_feeds"}
NAMES = sorted(n for n in QUERIES if n not in EAGER and not n.startswith(("src_", "sink_", "stream_")))
#: one row of totals, or a handful of literal periods, on one side
SCALAR_SIDE: set[str] = set()
PERIOD = ["period_verdict", "competitor_verdict", "market_vs_own", "log_attribution", "basis_gap", "period_overlay",
          "axis_event_lists"]
#: the ledger meets one verdict a series: these are sent to it, it isn't dealt by series
MOVED = ["direction_match", "carry_base_factors"]


def plan_of(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_products_and_no_constant_keys(spark, name):
    plan = plan_of(spark, name)
    if name not in SCALAR_SIDE:
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    for keys in re.findall(r"(?:SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin) \[([^\]]*)\], \[([^\]]*)\]", plan):
        for side in keys:
            assert "#" in side, f"a join key of {name} is no column: {keys}"


@pytest.mark.parametrize("name", PERIOD)
def test_period_bounds_reach_the_fact_scan(spark, name):
    scans = [s for s in plan_of(spark, name).splitlines() if "FileScan" in s and "l_shipdate" in s and "l_orderkey" in s]
    assert scans and all(re.search(r"PushedFilters: \[.*l_shipdate", s) for s in scans)


@pytest.mark.parametrize("name", MOVED)
def test_ledger_is_not_dealt_by_series_for_its_verdicts(spark, name):
    df = QUERIES[name](spark, SF)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    joins = [k for k in re.findall(r"(SortMergeJoin|ShuffledHashJoin) \[series_id", plan)]
    assert not joins and re.search(r"BroadcastHashJoin \[series_id", plan)


def test_ranks_are_not_got_by_dealing_the_ledger_by_series(spark):
    plan = plan_of(spark, "rank_events")
    assert not re.search(r"hashpartitioning\(series_id#\d+, \d+\)", plan)


def test_scans_read_only_what_is_used(spark):
    line = [s for s in re.findall(r"ReadSchema: (\S+)", plan_of(spark, "period_verdict")) if "l_orderkey" in s]
    assert line and all("l_tax" not in s and "l_quantity" not in s for s in line)


@pytest.mark.parametrize("name", ["pressure_correlation", "event_window_join", "hit_scores", "hit_summary"])
def test_series_are_summed_once_for_all_their_uses(spark, name):
    assert not [s for s in re.findall(r"ReadSchema: (\S+)", plan_of(spark, name)) if "l_extendedprice" in s]


def test_series_documents_keep_no_table_of_every_point(spark):
    from pulsetrail.catalog.bindings import Views
    from pulsetrail.catalog.series import series_documents
    plan = series_documents(Views(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" in plan and not re.search(r"Aggregate\(keys=\[[^\]]*order_id", plan)
