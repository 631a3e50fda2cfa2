"""The settings' JSON is parsed once for each thing that is asked of it, not once a path."""

from parley.plans import live


def test_json_is_parsed_once_for_problems_and_once_for_the_threads(spark, small):
    plan = live.settings_problems(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") == 2
