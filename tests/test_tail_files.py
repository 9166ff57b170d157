"""The deliveries of a client are gathered before they are written."""

from ridgelog.session import folder_system, scratch_path
from ridgelog.streaming import clients as tails
from ridgelog.streaming import jobs as j


def test_a_client_gets_few_files(spark, make_logs):
    source, path = scratch_path(spark, "few-in"), scratch_path(spark, "few-out")
    logs = make_logs([{"id": f"l{i}", "level": "info", "message": f"m{i % 7}"} for i in range(400)])
    logs.repartition(4).write.parquet(source)
    stream = j.stream_files(spark, source, logs.schema)
    clients = {f"c{i}": [{"field": "message", "operator": "contains", "value": f"m{i}"}, {"field": "level", "operator": "!=", "value": "debug"}] for i in range(7)}
    clients["all"] = []
    # so small that nothing is joined to fewer tasks
    least, spark_least = "spark.sql.adaptive.coalescePartitions.enabled", spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set(least, "false")
    try:
        tails.clients_sink(stream, clients, path, scratch_path(spark, "few-check"), trigger={"availableNow": True}).awaitTermination()
    finally:
        spark.conf.set(least, spark_least)
    found = {r["client"]: r["n"] for r in tails.delivered(spark, path).groupBy("client").count().withColumnRenamed("count", "n").collect()}
    assert found["all"] == 400 and {c: found[c] for c in ("c0", "c1", "c2")} == {"c0": 58, "c1": 57, "c2": 57}
    system, folder = folder_system(spark, f"{path}/batch=0/client=all")
    assert sum(e.getPath().getName().endswith(".parquet") for e in system.listStatus(folder)) == 1
