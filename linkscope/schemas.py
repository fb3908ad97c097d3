"""Schemas of the relations, and the constants that appear in them."""

PACKETS = (
    "capture_id string, pkt_ord long, timestamp double, src_ip string, dst_ip string, src_port int, dst_port int, tcp_flags int, "
    "tcp_seq long, tcp_ack long, tcp_window long, tcp_len int, frame_number long, tcp_stream long, frame_len int, cap_len int, payload_hex string"
)
JDBC_LINES = "source_file string, line_no int, value string"

#: Ports of databases by name.
DB_PORTS = {"mysql": 3306, "postgresql": 5432, "oracle": 1521, "mssql": 1433, "dameng": 5236, "redis": 6379, "mongodb": 27017}

C2S, S2C, UNKNOWN = "client_to_server", "server_to_client", "unknown"
KEYS = ["capture_id", "session_id"]
