from pyspark.sql import functions as F

from quern.streaming.windows import windowed_counts


def test_stream_gives_what_the_batch_gives(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = windowed_counts(stream).writeStream.format("memory").queryName("quern_counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(spark.table("quern_counts").collect()) == sorted(windowed_counts(events).collect())
