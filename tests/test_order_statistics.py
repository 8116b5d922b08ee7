import math
import random

import numpy as np
import pytest

from ledgerloom.operators import evaluation as ev
from ledgerloom.operators import order_statistics as os_


@pytest.mark.parametrize("few", [0, 5_000])
@pytest.mark.parametrize("kind", ["spread", "ties", "wide", "tiny"])
def test_ranks_are_exact(spark, monkeypatch, few, kind):
    monkeypatch.setattr(os_, "FEW_ROWS", few)
    monkeypatch.setattr(os_, "BINS", 16)
    rng = random.Random(7)
    make = {"spread": lambda: rng.gauss(0, 1), "ties": lambda: float(rng.randrange(3)), "wide": lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 308), "tiny": lambda: rng.randrange(9) * 5e-324}[kind]
    x = [make() for _ in range(400)]
    got = os_.order_statistics(spark.createDataFrame([(v,) for v in [*x, None, None]], "v double"), "v", [0, 1, 57, 199, 200, 398, 399])
    assert got == {r: sorted(x)[r] for r in (0, 1, 57, 199, 200, 398, 399)}


def test_ends(spark):
    rows = spark.createDataFrame([(v,) for v in (math.inf, -math.inf, math.nan, 2.0, -math.inf, 1.0, None)], "v double")
    got = os_.order_statistics(rows, "v", [*range(6)])
    assert [got[r] for r in range(5)] == [-math.inf, -math.inf, 1.0, 2.0, math.inf] and math.isnan(got[5])
    assert os_.quantiles(rows.limit(0), "v", [0.5]) == (0, {0.5: None})


def test_distribution_and_threshold(spark):
    x = np.random.default_rng(3).exponential(size=3000)
    rows = spark.createDataFrame([(float(v),) for v in x], "score double")
    d = ev.distribution(rows, "score").first()
    assert (d["count"], d["min"], d["max"]) == (3000, x.min(), x.max())
    for q in (10, 50, 90, 95):
        assert d[f"p{q}"] == pytest.approx(np.quantile(x, q / 100), rel=1e-12)
    t = ev.threshold(rows).first()["threshold"]
    assert (x >= t).sum() == 150 and t == math.nextafter(np.sort(x)[-151], math.inf)
    one = spark.createDataFrame([(1.0,), (None,)], "score double")
    assert ev.threshold(one).first()["threshold"] > 1.0 and ev.threshold(one.where("score > 5")).first()["threshold"] is None
    assert tuple(ev.distribution(one.where("score > 5"), "score").first()) == (0, None, None, None, None, None, None)


def test_plan_has_no_growing_state(spark):
    """Neither a percentile nor a top list of a share of all rows."""
    rows = spark.range(10_000).selectExpr("cast(id as double) score")
    plan = ev.distribution(rows, "score")._jdf.queryExecution().toString() + ev.threshold(rows)._jdf.queryExecution().toString()
    assert "percentile" not in plan.lower() and "TakeOrdered" not in plan


def test_commands_are_strings(spark):
    lines = [f'{{"item": {{"type": "command_execution", "command": {c}}}}}' for c in ('"ls"', '["ls", "-l"]', "7", "null", '{"a": 1}', '""')]
    lines += ['{"item": {"type": "command_execution"}}', '{"item": {"type": "reasoning", "command": "x"}}', "not json", "[1]"]
    assert ev.event_log_totals(spark.createDataFrame([(x,) for x in lines], "raw string")).first()["commands"] == 2
