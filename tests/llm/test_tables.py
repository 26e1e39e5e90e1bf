"""Intermediate tables."""

import os

from pyspark.sql import functions as F

from linkspark.llm.tables import collected, releasing


def shuffle_files(spark):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    dirs = [str(d) for d in env.blockManager().diskBlockManager().localDirs()]
    return sum(name.startswith("shuffle_") for d in dirs for _, _, names in os.walk(d) for name in names)


def test_collected_rows_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    rows = collected(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n")))
    assert sorted(tuple(r) for r in rows) == [(k, 143 if k < 6 else 142) for k in range(7)]
    assert shuffle_files(spark) <= before


def test_releasing_restores_the_setting(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    with releasing(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name, None) == before
