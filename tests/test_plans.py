"""Plan guards: no cartesian or nested-loop joins, no row-at-a-time Python
UDFs in any registered batch query."""

import pytest

from runlens.plans import registry
from tests.conftest import SMOKE

registry.load_all()
BATCH = sorted(n for n in registry.QUERIES if not n.startswith("stream_"))
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


@pytest.mark.parametrize("name", BATCH)
def test_plan_has_no_forbidden_operator(spark, name):
    plan = registry.QUERIES[name](spark, SMOKE)._jdf.queryExecution().executedPlan().toString()
    assert not [op for op in FORBIDDEN if op in plan], name
