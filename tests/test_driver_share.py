"""Evidence and timelines of all events send no table that grows with events through the driver."""

import re

from test_evidence import inputs

from linkscope.operators import case_evidence


def test_evidence_of_all_events_broadcasts_only_single_rows(spark):
    key, events, chosen, ranked, entries, qualities = inputs(spark, "AMBIGUOUS")
    items = case_evidence.evidence(events, events, chosen, ranked, entries, qualities, None, every=True)
    plan = items._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"BroadcastHashJoin", plan) and plan.count("BroadcastNestedLoopJoin") <= 2 * len(qualities)  # the captures' quality, a row each
    few = case_evidence.evidence(key, events, chosen, ranked, entries, qualities, None)
    assert sorted(map(str, items.where("event_id = 'E1'").collect())) == sorted(map(str, few.collect()))
    assert items.where("event_id = 'E2'").count() == 7  # logged, two captures, no ping, three caveats
