"""Markdown as rows of blocks with inline spans: lines become blocks by windows, a block's text becomes spans by one pattern.

Known blocks: headings, rules, quotes, bulleted and numbered items with their depth, fenced code, tables and
paragraphs; known spans: code, strong and emphasised text. Anything else is text. Blocks are flat: an item has a depth
instead of a parent, a quote's text is not parsed for blocks, and a span holds no spans.

Cases: null and blank texts have no blocks; a fence that is not closed ends with the text; an escaped mark is
itself; marks that open nothing are text; rows of one key and different texts would mix, so keys must differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADING = r"^ {0,3}(#{1,6})\s+(.*?)\s*#*\s*$"
RULE = r"^\s*(?:(?:\*\s*){3,}|(?:-\s*){3,}|(?:_\s*){3,})$"
QUOTE = r"^\s*>\s?(.*)$"
ITEM = r"^(\s*)(?:[-*+•]|(\d{1,3})[.)])\s+(.*)$"
FENCE = r"^\s*```"
TABLE_LINE = r"^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)*\|?\s*$"
MOST_LEVEL = 4
TAB = 4

#: One alternative a kind of span; text is what no mark begins.
SPAN = r"`[^`]+`|\*\*(?=\S).+?(?<=\S)\*\*|__(?=\S).+?(?<=\S)__|\*(?=[^\s*])[^*]*(?<=[^\s*])\*|(?<![\p{L}\p{N}])_(?=[^\s_])[^_]*(?<=[^\s_])_(?![\p{L}\p{N}])|\\[\\`*_#>|-]|[^`*_\\]+|[`*_\\]"


def spans(text: Column) -> Column:
    """Array of (style, text): code, strong, em or text, in order; neighbouring text is one span."""
    tokens = F.regexp_extract_all(text, F.lit(f"({SPAN})"), F.lit(1))
    inner = lambda t, n: F.substring(t, n + 1, F.length(t) - 2 * n)

    def span(t: Column) -> Column:
        long, first = F.length(t) > 2, F.substring(t, 1, 1)
        two = t.rlike(r"^(?:\*\*.+\*\*|__.+__)$") & (F.length(t) > 4)
        style = F.when(two, "strong").when(long & (first == "`"), "code").when(long & first.isin("*", "_"), "em").otherwise("text")
        return F.struct(style.alias("style"), F.when(two, inner(t, F.lit(2))).when(long & first.isin("`", "*", "_"), inner(t, F.lit(1))).when(t.rlike(r"^\\.$"), F.substring(t, 2, 1)).otherwise(t).alias("text"))

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["style"] == "text") & (s["style"] == "text")
        return F.when(joins, F.array_append(F.slice(done, 1, F.size(done) - 1), F.struct(F.lit("text").alias("style"), F.concat(last["text"], s["text"]).alias("text")))).otherwise(F.array_append(done, s))

    return F.aggregate(F.transform(tokens, span), F.array().cast("array<struct<style:string,text:string>>"), add)


def blocks(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, n (from 0), kind (heading, rule, quote, item, code, table or text), level, number, text, spans.

    level is a heading's (``MOST_LEVEL`` at most) or an item's depth in columns; number is a numbered item's.
    """
    w = Window.partitionBy(*keys).orderBy("at")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    lines = df.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n?|\n")).alias("at", "line"))
    fence = F.col("line").rlike(FENCE)
    fenced = lines.withColumn("inside", F.coalesce(F.sum(fence.cast("int")).over(before), F.lit(0)) % 2 == 1).withColumn("fence", fence)
    lead = F.lead("line").over(w)
    head = F.col("line").contains("|") & F.coalesce(lead.rlike(TABLE_LINE), F.lit(False))
    kind = (
        F.when(F.col("inside") & ~fence, "code")
        .when(fence, "fence")
        .when(F.trim("line") == "", "blank")
        .when(F.col("line").rlike(HEADING), "heading")
        .when(F.col("line").rlike(RULE), "rule")
        .when(F.col("line").rlike(QUOTE), "quote")
        .when(head, "table head")
        .when(F.col("line").rlike(ITEM), "item")
        .when(F.col("line").contains("|"), "table?")
        .otherwise("text")
    )
    known = fenced.withColumn("kind", kind)
    # lines with bars are a table's as long as they follow its head without a break
    breaks = F.sum((~F.col("kind").isin("table head", "table?")).cast("int")).over(w)
    known = known.withColumn("part", breaks)
    heads = F.max(F.when(F.col("kind") == "table head", 1)).over(Window.partitionBy(*keys, "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    known = known.withColumn("kind", F.when((F.col("kind") == "table?") & heads.isNotNull(), "table").when(F.col("kind") == "table?", "text").when(F.col("kind") == "table head", "table").otherwise(F.col("kind")))
    indented = F.col("line").rlike(r"^\s+\S")
    last = F.lag("kind").over(w)
    known = known.withColumn("kind", F.when((F.col("kind") == "text") & indented & last.isin("item"), "more").otherwise(F.col("kind")))
    alone = F.col("kind").isin("heading", "rule", "item", "fence", "blank")
    starts = alone | (F.coalesce(last, F.lit("")) != F.col("kind")) & ~((F.col("kind") == "more") & (last == "item"))
    numbered = known.withColumn("block", F.sum(starts.cast("int")).over(w)).filter(~F.col("kind").isin("blank", "fence"))
    line = F.when(F.col("kind") == "heading", F.regexp_extract("line", HEADING, 2)).when(F.col("kind") == "quote", F.regexp_extract("line", QUOTE, 1)).when(F.col("kind") == "item", F.regexp_extract("line", ITEM, 3)).when(F.col("kind").isin("text", "more"), F.trim("line")).otherwise(F.col("line"))
    depth = F.length(F.replace(F.regexp_extract("line", ITEM, 1), F.lit("\t"), F.lit(" " * TAB)))
    level = F.when(F.col("kind") == "heading", F.least(F.length(F.regexp_extract("line", HEADING, 1)), F.lit(MOST_LEVEL))).when(F.col("kind") == "item", depth)
    number = F.when(F.col("kind") == "item", F.regexp_extract("line", ITEM, 2).try_cast("int"))
    kept = numbered.filter(~((F.col("kind") == "table") & F.col("line").rlike(TABLE_LINE))).select(*keys, "block", "at", "kind", line.alias("line"), level.alias("level"), number.alias("number"))
    rows = F.sort_array(F.collect_list(F.struct("at", "line")))
    whole = kept.groupBy(*keys, "block").agg(F.min_by("kind", "at").alias("kind"), F.min_by("level", "at").alias("level"), F.min_by("number", "at").alias("number"), F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"))
    n = (F.row_number().over(Window.partitionBy(*keys).orderBy("block")) - 1).alias("n")
    plain = F.array(F.struct(F.lit("text").alias("style"), F.col("text").alias("text")))
    return whole.select(*keys, n, "kind", "level", "number", "text", F.when(F.col("kind").isin("code", "rule"), plain).otherwise(spans(F.col("text"))).alias("spans"))
