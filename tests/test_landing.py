from __future__ import annotations

from pyspark.sql import functions as F

from weft.streaming import jobs


def test_a_hot_group_lands_in_several_files(spark):
    df = spark.range(0, 1000, 1, 4).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("wave"))
    root = jobs.land(df, jobs.work_dir(spark, "landing"), by="wave", whole=False)
    landed = spark.read.parquet(root)
    files = landed.select("wave", F.input_file_name().alias("file")).distinct().groupBy("wave").agg(F.count("*").alias("n")).collect()
    assert {r["wave"]: r["n"] for r in files} == {0: 4, 1: 4}
    assert sorted(r["id"] for r in landed.collect()) == list(range(1000))
