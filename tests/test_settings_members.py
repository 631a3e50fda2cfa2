"""Odd objects in both forms: null values, nested objects in nested objects, unknown keys, kinds of numbers, no objects."""

import json
import re

from pyspark.sql import functions as F

from parley.functions import validation
from parley.functions.validation import Field
from parley.plans import live

TREE = {"b": Field("flag", False), "a": {"x": Field("number", 1, low=0, high=9), "in": {"t": Field("text", "d"), "n": Field("names")}, "o": Field("optional")}, "c": Field("choice", "p", ("p", "q"))}


def both(spark, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, json string")
    rows = df.select("k", validation.problems(F.col("json"), TREE).alias("p"), validation.repaired(F.col("json"), TREE).alias("r")).orderBy("k").collect()
    return [([tuple(p) for p in row.p], [tuple(x) for x in row.r.repairs], row.r.rest, row.r.value) for row in rows]


def test_objects_in_objects_are_checked_in_the_trees_order(spark):
    bad = {"c": "z", "a": {"o": 1, "in": {"n": {"y": 1}, "t": " ", "u": 2}, "x": [1]}, "b": 0, "more": {"b": 1}}
    problems, repairs, rest, value = both(spark, json.dumps(bad))[0]
    assert problems == [("$.b", "wrong type", "0"), ("$.a.x", "wrong type", "[1]"), ("$.a.in.t", "not usable", '" "'), ("$.a.in.n", "wrong type", '{"y":1}'), ("$.a.o", "wrong type", "1"), ("$.c", "not one of the choices", '"z"')]
    assert [r[:2] for r in repairs] == [(p, f) for p, _, f in problems] and rest == {"more": '{"b":1}'}
    assert (value.b, value.a.x, value.a["in"].t, value.a["in"].n, value.a.o, value.c) == (False, 1.0, "d", [], None, "p")


def test_null_values_are_there_and_missing_ones_are_not(spark):
    got = both(spark, '{"b":null,"a":null,"c":null}', '{"a":{"in":null,"o":null}}', '{"a":{"in":{}}}', '{"a":{"in":[{"t":3}]}}', '{"a":"in"}')
    assert [[p[:2] for p in g[0]] for g in got] == [[("$.b", "wrong type"), ("$.a", "wrong type"), ("$.c", "wrong type")], [("$.a.in", "wrong type")], [], [("$.a.in", "wrong type")], [("$.a", "wrong type")]]
    assert [[r[0] for r in g[1]] for g in got] == [["$.b", "$.c"], [], [], [], []]


def test_kinds_of_numbers_and_no_objects(spark):
    numbers = ["3", "-0.5", "1e300", "12345678901234567890123", "0.10", "true", '"3"']
    assert [len(g[0]) for g in both(spark, *[f'{{"a":{{"x":{n}}}}}' for n in numbers])] == [0, 0, 0, 0, 0, 1, 1]
    texts = [None, "", "  ", "{}", "[]", '[{"b":1}]', "null", "7", '"b"', "{", '{"b":1,"b":2}']
    got = both(spark, *texts)
    assert [[p[1] for p in g[0]] for g in got] == [[]] * 4 + [["not an object"]] * 5 + [["not JSON"]] * 2
    assert [g[0][0] for g in got[4:]] == [("$", p[0][1], t) for p, t in zip([g[0] for g in got[4:]], texts[4:])]
    assert all(g[1] == [] and g[2] == {} and g[3] == got[3][3] for g in got)


def test_fields_are_looked_up_and_not_searched_for_path_by_path(spark, small):
    """Only the threads, one field, are read by a path."""
    plan = live.settings_problems(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert set(re.findall(r"variant_?get\([^,]+, (\S+),", plan.lower())) == {"$", "$.numthreads"} and "regexp_extract" not in plan
