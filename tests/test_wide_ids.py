"""Ids of flows beyond the ten-thousandth keep all digits, so no two flows share one."""

from pyspark.sql import functions as F

from linkscope.operators import dual


def test_more_than_9999_flows(spark):
    s = spark.range(10_050).select(
        F.lit("c").alias("client_ip"), F.col("id").cast("int").alias("client_port"), F.lit("s").alias("server_ip"), F.lit(1).alias("server_port"), F.col("id").alias("session_id"), F.col("id").alias("session_ord"),
        F.lit(0.0).alias("start_time"), F.lit(9.0).alias("end_time"), F.lit(None).cast("long").alias("syn_seq"),
    )
    flows = dual.match_flows(s, s)
    assert flows.agg(F.countDistinct("correlation_id")).first()[0] == 10_050
    assert flows.where("client_port IN (0, 10049)").orderBy("client_port").select("correlation_id").collect() == [("CF0001",), ("CF10050",)]
