"""Registered graph queries: neither the tables they write on the way nor their own plan sends rows through the driver."""

import pytest

from trackloom.operators import graph, lifecycle
from trackloom.plans import registry, registry_documented, registry_sources, registry_tracking  # noqa: F401

SF = "/root/testdata/sf0.001"
QUERIES = ("e8_jaywalking_edge", "e8_loitering_edge", "e8_near_miss_edge", "edge_occurred_in", "q10_crowd_then_loiter", "q14_audit", "q2_events_of_object", "q4_near_misses_in_condition", "q7_convoys", "q9_loiter_hotspots", "z12_graph_rules",)


@pytest.mark.parametrize("name", QUERIES)
def test_no_step_is_broadcast(spark, monkeypatch, name):
    plans, write_once = [], graph.write_once
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for module in (graph, lifecycle):
        monkeypatch.setattr(module, "write_once", lambda df: plans.append(plan(df)) or write_once(df))
    plans.append(plan(registry.QUERIES[name](spark, SF)))
    kept = [x for p in plans for x in p.splitlines() if "BroadcastHashJoin" in x and "name#" not in x]  # the twelve classes are broadcast on purpose
    assert len(plans) >= 3 and not kept


def test_answers_on_classes_compute_no_events(spark, monkeypatch):
    def none(*a, **k):
        raise AssertionError("events are not asked for")

    monkeypatch.setattr(graph.E, "all_events", none)
    assert {r.kind for r in registry.QUERIES["q19_fallback"](spark, SF).collect()} == {"inventory", "counts", "direct"}
