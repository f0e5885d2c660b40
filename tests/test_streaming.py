from pyspark.sql import functions as F

from pulsegrid.streaming import windows as ws


def run(spark, df, name, mode="complete"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path))
    return spark.readStream.schema(schema).parquet(str(tmp_path))


def test_bins_and_runs(spark, tmp_path):
    rows = [(0, s) for s in (1, 2, 3, 50, 51, 120)]
    p = stream(spark, tmp_path / "p", rows, "unit int, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = run(spark, ws.binned_counts(p, "60 seconds", "10 minutes"), "bins")
    assert sorted(r.n for r in got) == [1, 5]
    got = run(spark, ws.merged_runs(p, "10 seconds", "10 minutes"), "runs")
    assert sorted(r.n for r in got) == [1, 2, 3]


def test_join_of_streams(spark, tmp_path):
    p = stream(spark, tmp_path / "p", [(0, 10), (0, 14), (0, 90)], "unit int, s int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    r = stream(spark, tmp_path / "r", [(7, 12)], "ref_id int, s int").withColumn("ref_ts", F.timestamp_seconds("s")).drop("s")
    got = run(spark, ws.around(p, r, 5.0, 5.0, "1 minute"), "joined", "append")
    assert sorted(x.lag for x in got) == [-2.0, 2.0]
