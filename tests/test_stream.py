from pyspark.sql import functions as F

from meterlake.operators import sessions
from meterlake.plans import contract, queries
from meterlake.streaming import meter_stream as ms

SCHEMA = "pkt_no long, ts_ns long, orig_len long, link_type int, data binary"


def test_stream_equals_batch(spark, tmp_path):
    """Packets in five files, cut across ticks, then the marks that close the books: the same records as the batch."""
    ms.use_rocksdb(spark)
    plan = queries.plan(spark, "/root/testdata/sf0.001", queries.CUTTING)
    packets = plan.packets.cache()
    edges = [0, 137, 400, 401, 800, 10**9]
    by_time = packets.withColumn("r", F.expr("row_number() over (order by ts_ns, pkt_no)")).cache()
    for k in range(5):
        by_time.where((F.col("r") > edges[k]) & (F.col("r") <= edges[k + 1])).drop("r").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    bindings = sessions.bindings(plan.sessions)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    ticks = ms.usage_ticks(stream, bindings, None, contract.START_NS, queries.CUTTING)
    marks = tmp_path / "marks"
    marks.mkdir()
    closing = spark.readStream.schema(ticks.schema).parquet(str(marks))
    out = ms.records(ticks.unionByName(closing), queries.CUTTING)
    write = lambda: out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    write()
    zero = F.lit(0).cast("long")
    bindings.select("imsi").distinct().select("imsi", F.lit(-1).cast("long").alias("tick"), *(zero.alias(c) for c in ms.SUMS)).coalesce(1).write.mode("append").parquet(str(marks))
    write()
    columns = ["imsi", "seq", "reason", "start_tick", "end_tick", "ul_bytes", "dl_bytes", "ul_packets", "dl_packets"]
    got, want = spark.read.parquet(str(tmp_path / "out")).select(*columns), plan.records(contract.START_NS).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
