"""Settings against the tree of fields, rejecting and repairing."""

import json

import pytest
from pyspark.sql import functions as F

from parley.functions import validation
from parley.functions.validation import Field


def problems(spark, *texts, tree=validation.SETTINGS):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, json string")
    return [[(p.path, p.problem, p.found) for p in r.p] for r in df.select("k", validation.problems(F.col("json"), tree).alias("p")).orderBy("k").collect()]


def repaired(spark, *texts, tree=validation.SETTINGS):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, json string")
    return [r.r for r in df.select("k", validation.repaired(F.col("json"), tree).alias("r")).orderBy("k").collect()]


def test_every_failing_path_is_found(spark):
    bad = {"captureMic": "yes", "micMode": "crowd", "numThreads": "4", "micDevice": 7, "hotkeys": {"hint": "Shift+A", "recap": 3, "toggle": "Ctrl+B"}, "myNames": 1, "other": {"x": [1]}}
    assert problems(spark, json.dumps(bad)) == [
        [("$.numThreads", "wrong type", '"4"'), ("$.captureMic", "wrong type", '"yes"'), ("$.micMode", "not one of the choices", '"crowd"'), ("$.micDevice", "wrong type", "7"), ("$.myNames", "wrong type", "1"), ("$.hotkeys.hint", "not usable", '"Shift+A"'), ("$.hotkeys.recap", "wrong type", "3")]
    ]


def test_fine_missing_and_no_objects(spark):
    fine = json.dumps({"numThreads": 64, "micDevice": None, "profile": "", "hotkeys": {}, "rollingSummaryMinutes": 2.5})
    got = problems(spark, fine, None, "  ", "{}", "[1, 2]", "oops", "null", '{"sttModel": "  "}', '{"hotkeys": []}')
    assert got[:4] == [[]] * 4
    assert [p[0][:2] for p in got[4:]] == [("$", "not an object"), ("$", "not JSON"), ("$", "not an object"), ("$.sttModel", "not usable"), ("$.hotkeys", "wrong type")]


def test_repairs_and_what_is_put(spark):
    given = {"numThreads": 64, "rollingSummaryMinutes": -1, "captureMic": "yes", "micMode": "room", "micDevice": "", "myNames": " Анна ;анна, Пётр", "hotkeys": {"hint": "Alt+F1", "recap": "x"}, "sttBackend": 5, "uiOnly": {"x": 1}, "profile": "я"}
    r = repaired(spark, json.dumps(given, ensure_ascii=False))[0]
    v = r.value
    assert (v.numThreads, v.rollingSummaryMinutes, v.captureMic, v.micMode, v.micDevice, v.myNames, v.sttBackend, v.profile) == (32, 0.0, True, "room", None, ["Анна", "Пётр"], "auto", "я")
    assert tuple(v.hotkeys) == ("Alt+F1", "CommandOrControl+Alt+KeyK", "CommandOrControl+Alt+KeyP") and v.summaryEffort == "high"
    assert r.rest == {"uiOnly": '{"x":1}'}
    assert {x.path: (x.found, x.put) for x in r.repairs} == {
        "$.numThreads": ("64", "32"), "$.rollingSummaryMinutes": ("-1", "0.0"), "$.captureMic": ('"yes"', "true"), "$.micDevice": ('""', "null"),
        "$.myNames": ('" Анна ;анна, Пётр"', '["Анна","Пётр"]'), "$.hotkeys.recap": ('"x"', '"CommandOrControl+Alt+KeyK"'), "$.sttBackend": ("5", '"auto"'),
    }


def test_what_is_no_object_becomes_the_defaults(spark):
    rows = repaired(spark, None, "oops", "[1]", "{}", '{"numThreads": 7, "myNames": ["b"], "micDevice": null}')
    assert all(tuple(r.value) == tuple(rows[3].value) and not r.repairs and r.rest == {} for r in rows[:4])
    assert rows[3].value.numThreads == 4 and rows[3].value.myNames == [] and rows[3].value.captureSystem is True
    assert rows[4].value.numThreads == 7 and rows[4].value.myNames == ["b"] and not rows[4].repairs


@pytest.mark.parametrize("text", ['{"a": {"b": {"c": 5}}}', '{"a": {"b": {"c": "x"}}}', '{"a": 1}', "{}"])
def test_own_trees(spark, text):
    tree = {"a": {"b": {"c": Field("number", 1, low=0, high=9)}}}
    found, fixed = problems(spark, text, tree=tree)[0], repaired(spark, text, tree=tree)[0]
    c = fixed.value.a.b.c
    assert (c, [p[0] for p in found]) == {'{"a": {"b": {"c": 5}}}': (5.0, []), '{"a": {"b": {"c": "x"}}}': (1.0, ["$.a.b.c"]), '{"a": 1}': (1.0, ["$.a"]), "{}": (1.0, [])}[text]
