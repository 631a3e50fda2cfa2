"""Shuffle files go with the step that wrote them, and not when the driver happens to collect its garbage."""

import time

from pyspark.sql import functions as F

from parley.llm import linededup
from parley.llm.common import FREES, settle, stored


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {str(blocks.apply(k)) for k in range(blocks.size()) if str(blocks.apply(k)).startswith("shuffle_")}


def left_over(spark, before):
    for _ in range(50):  # they are deleted beside other work
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return left


def test_a_step_frees_its_shuffle_files_and_can_be_read_again(spark):
    before = shuffle_files(spark)
    sums = spark.range(2000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("n"))
    tables = [stored(sums, "sums"), settle(sums), settle(settle(sums).groupBy("n").count())]
    assert not left_over(spark, before)
    assert tables[0].exceptAll(tables[1]).count() == 0 and tables[0].count() == tables[1].count() == tables[2].count() == 7
    assert sums.count() == 7 and spark.conf.get(FREES) == "false"


def test_a_setting_of_the_session_stays(spark):
    spark.conf.set(FREES, "true")
    try:
        settle(spark.range(9).repartition(3))
        assert spark.conf.get(FREES) == "true"
    finally:
        spark.conf.unset(FREES)


def test_line_dedup_leaves_the_disk_to_the_join_of_the_texts(spark):
    lines = [" ".join(f"w{k}x{j}" for j in range(12)) for k in range(40)]
    docs = spark.createDataFrame([(k, "\n".join(lines[k : k + 5] + [f"own line of {k} alone"])) for k in range(40)], "doc_id long, text string")
    before = shuffle_files(spark)
    plan = linededup.dedup_lines(docs)
    assert not left_over(spark, before)
    kept = [line for r in plan.orderBy("doc_id").collect() for line in r.text.split("\n")]
    assert sorted(x for x in kept if x.startswith("w")) == sorted(lines) and len(kept) == 80
