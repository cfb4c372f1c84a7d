"""A view whose events and rounds are written once gives the rows of the plain view."""
import pytest
from pyspark.sql import functions as F

from matchloom.plans import reports, timeline
from matchloom.plans.registry import View, running

SMALL = "/root/testdata/sf0.001"


def test_settled_view_equals_the_plain_one(spark):
    plain = View(spark, SMALL)
    kept = plain.settled()
    rows = lambda df: sorted(map(repr, df.collect()))
    for of in (lambda v: v.m, lambda v: v.attached(), lambda v: v.rounds(), reports.death_offsets, timeline.round_samples):
        assert of(kept).columns == of(plain).columns and rows(of(kept)) == rows(of(plain))
    with pytest.raises(ValueError):
        kept.attached(total={"other": F.lit(1)})


def test_suggestions_read_the_events_once(spark):
    """Neither sessions nor event payloads are worked out again by what reads the settled view."""
    kept = View(spark, SMALL).settled()
    for df in (kept.rounds(), reports.death_offsets(kept), timeline.round_samples(kept)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "get_json_object" not in plan
    assert set(running()) == {"last", "nxt", "ahead"}
