"""Campaigns over streams: the same as over a table, for windows that are over."""

from datetime import datetime, timedelta

from siftwright.streaming import watch

SCHEMA = "report_id string, type string, value string, at timestamp"


def test_campaigns_of_a_stream(spark, tmp_path):
    t = datetime(2024, 1, 1, 10, 5)
    rows = [("r1", "domain", "x.test", t), ("r1", "domain", "x.test", t + timedelta(minutes=3)), ("r2", "domain", "x.test", t + timedelta(minutes=20)), ("r3", "domain", "y.test", t + timedelta(hours=1))]
    late = [("r9", "url", "z", t + timedelta(days=9))]
    for i, part in enumerate((rows[:2], rows[2:], late)):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    table = {tuple(r) for r in watch.campaign_windows(spark.createDataFrame(rows, SCHEMA), "at").select("type", "value", "reports").collect()}
    assert table == {("domain", "x.test", 2), ("domain", "y.test", 1)}

    def streamed(plan, name):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        plan(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}-c").trigger(availableNow=True).start(f"{tmp_path}/{name}").awaitTermination()
        return spark.read.parquet(f"{tmp_path}/{name}")

    got = {tuple(r) for r in streamed(lambda s: watch.campaign_windows(s, "at"), "windows").filter("type = 'domain'").select("type", "value", "reports").collect()}
    assert got == table
    runs = {tuple(r) for r in streamed(lambda s: watch.campaign_sessions(s, "at"), "sessions").filter("type = 'domain'").select("value", "seen").collect()}
    assert runs == {("x.test", 3), ("y.test", 1)}
