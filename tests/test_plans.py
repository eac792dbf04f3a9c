"""Plan-shape guards for every registered batch query: no Cartesian products
or nested-loop joins, and the raw log is scanned with a pruned schema."""

import pytest

from lagscope.plans import catalog
from tests.conftest import SF_SMALL

BATCH = sorted(n for n in catalog.queries() if not n.startswith(("streaming_", "live_", "batch_sink")))


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_or_nested_loop_joins(spark, name):
    df = catalog.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan


def test_event_scan_is_pruned(spark):
    from lagscope.sources.fixtures import Fixture, build_series_counts
    fx = Fixture(spark, SF_SMALL, "H")
    plan = build_series_counts(fx.base, fx.grid)._jdf.queryExecution().executedPlan().toString()
    # only the three columns the counts need are read from events
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan
