"""The streaming timeline closes the sessions that the batch timeline finds, but each device's last."""

from pyspark.sql import functions as F

from beaconry.operators import timeline
from beaconry.plans import telemetry_view as view
from beaconry.streaming import timeline as streaming

SF = "/root/testdata/sf0.001"


def test_closed_sessions(spark, tmp_path):
    users = spark.read.parquet(f"{SF}/events.parquet").select(F.col("event_id").alias("record_index"), F.col("user_id").alias("device"))
    flat = view.events(spark, SF).join(users, "record_index").select("device", "record_index", F.col("tag").cast("int").alias("tag"), "heartbeat.uptime_s", "heartbeat.seq")
    for i, part in enumerate(("record_index < 400", "record_index >= 400")):
        flat.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{i}"))
    source = spark.readStream.schema(flat.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path))
    q = streaming.closed_sessions(source).writeStream.outputMode("append").format("memory").queryName("closed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "_ck")).start()
    q.awaitTermination(120)
    got = {(r["device"], r["session"]): (r["uptime_s"], r["record_count"]) for r in spark.table("closed").collect()}
    batch = timeline.sessions(view.events(spark, SF).join(users, "record_index"), ("device",)).collect()
    last = {}
    for r in batch:
        last[r["device"]] = max(last.get(r["device"], -1), r["session"])
    assert got == {(r["device"], r["session"]): (r["uptime_s"], r["record_count"]) for r in batch if r["session"] < last[r["device"]]}
