"""Markdown blocks and spans."""

from pyspark.sql import functions as F

from parley.functions import markdown


def spans(spark, text):
    return [tuple(s) for s in spark.createDataFrame([(text,)], "t string").select(markdown.spans(F.col("t")).alias("s")).first().s]


def test_spans(spark):
    assert spans(spark, "a **b c** and *d*, `e*f*` _g_!") == [("text", "a "), ("strong", "b c"), ("text", " and "), ("em", "d"), ("text", ", "), ("code", "e*f*"), ("text", " "), ("em", "g"), ("text", "!")]
    assert spans(spark, r"snake_case_name \*no\* 2 * 3 ** 4 `x") == [("text", "snake_case_name *no* 2 * 3 ** 4 `x")]
    assert spans(spark, "__я__ _и_ы_ **") == [("strong", "я"), ("text", " _и_ы_ **")]
    assert spans(spark, "") == []


TEXT = """# Title *x* #

First line
second  line
- one
  more of one
    - deep **b**
12) twelve
> quoted
> again
***
```py
- not an item

| x |
```
| a | b |
|---|:--:|
| 1 | 2 |
no table | here
####### seven"""


def test_blocks(spark):
    df = spark.createDataFrame([("k", TEXT), ("empty", " \n"), ("null", None), ("open", "```\ncode\n\n# x"), ("crlf", "a\r\nb\r\rc | d")], "k string, t string")
    rows = markdown.blocks(df, ["k"], "t").orderBy("k", "n").collect()
    got = lambda k: [(r.kind, r.level, r.number, r.text) for r in rows if r.k == k]
    assert got("k") == [
        ("heading", 1, None, "Title *x*"), ("text", None, None, "First line\nsecond  line"), ("item", 0, None, "one\nmore of one"), ("item", 4, None, "deep **b**"), ("item", 0, 12, "twelve"),
        ("quote", None, None, "quoted\nagain"), ("rule", None, None, "***"), ("code", None, None, "- not an item\n\n| x |"), ("table", None, None, "| a | b |\n| 1 | 2 |\nno table | here"), ("text", None, None, "####### seven"),
    ]
    assert got("empty") == got("null") == []
    assert got("open") == [("code", None, None, "code\n\n# x")]
    assert got("crlf") == [("text", None, None, "a\nb"), ("text", None, None, "c | d")]
    assert [tuple(s) for s in next(r for r in rows if r.k == "k").spans] == [("text", "Title "), ("em", "x")]
    assert [r.n for r in rows if r.k == "k"] == list(range(10))
