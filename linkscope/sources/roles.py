"""Which side a capture was taken at, from its packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The TTLs that systems start with.
INITIAL_TTLS = (32, 64, 128, 255)


def probe(packets: DataFrame, server_ip: str | None, server_port: int | None, max_packets: int | None = 4000) -> DataFrame:
    """One row: counts to and from the server, the time span, addresses, the usual TTL of either side, and the role that follows.

    max_packets bounds the look at a capture's start; None takes all of it.
    """
    p = packets if max_packets is None else packets.orderBy("pkt_ord").limit(max_packets)
    return _probed(p, [], server_ip, server_port)


def probe_each(packets: DataFrame, server_ip: str | None, server_port: int | None, max_packets: int | None = 4000) -> DataFrame:
    """probe() of each capture_id by itself: a row a capture."""
    if max_packets is not None:
        order = Window.partitionBy("capture_id").orderBy("pkt_ord")
        packets = packets.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= max_packets).drop("_nth")
    return _probed(packets, ["capture_id"], server_ip, server_port)


def _probed(p: DataFrame, by: list[str], server_ip: str | None, server_port: int | None) -> DataFrame:
    to = (F.col("dst_ip") == server_ip) & (F.col("dst_port") == server_port) if server_ip and server_port else F.lit(False)
    back = (F.col("src_ip") == server_ip) & (F.col("src_port") == server_port) if server_ip and server_port else F.lit(False)
    p = p.select(*by, "timestamp", "src_ip", "dst_ip", "ttl", "pkt_ord", to.alias("to_s"), back.alias("from_s"))
    one = p.groupBy(*by).agg(F.count(F.lit(1)).alias("packets"), F.count_if("to_s").alias("to_server"), F.count_if("from_s").alias("from_server"), F.min("timestamp").alias("time_start"), F.max("timestamp").alias("time_end"))
    every = p.select(*by, F.explode(F.array("src_ip", "dst_ip")).alias("ip")).distinct()
    first = every.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy("ip"))).where("_nth <= 12") if by else every.orderBy("ip").limit(12)
    ips = first.groupBy(*by).agg(F.array_sort(F.collect_list("ip")).alias("ips"))  # twelve at most
    side = p.where("ttl IS NOT NULL AND (to_s OR from_s)").groupBy(*by, F.when(F.col("from_s"), "server").otherwise("client").alias("side"), "ttl").agg(F.count(F.lit(1)).alias("n"), F.min("pkt_ord").alias("first"))
    modes = side.groupBy(*by).agg(*[F.max_by("ttl", F.when(F.col("side") == s, F.struct("n", -F.col("first")))).alias(f"{s}_ttl") for s in ("server", "client")])
    j = one.join(modes, by, "left").join(ips, by, "left") if by else one.join(modes).join(ips)  # a row each
    s, c, t, f = F.col("server_ttl"), F.col("client_ttl"), F.col("to_server"), F.col("from_server")
    role = (
        F.when(F.lit(not (server_ip and server_port)), "AMBIGUOUS")
        .when((s != c) & c.isin(*INITIAL_TTLS) & (c > s), "APP")
        .when((s != c) & s.isin(*INITIAL_TTLS) & (s > c), "DB")
        .when((t == 0) & (f == 0), "AMBIGUOUS")
        .when((t >= 3) & (t >= 2 * f), "APP")
        .when((f >= 3) & (f >= 2 * t), "DB")
        .otherwise("AMBIGUOUS")
    )
    return j.withColumn("role", role)
