"""Capture files as packets: a Python data source that reads a file in ranges of bytes.

A range begins at the first place where a chain of plausible records starts, and its records are
those that begin within it. Each record says where the next one begins; if the ranges of a file do not fit together
that way (bytes within a packet looked like records, or a file describes its interfaces anew half
way), the file is read once more as one range. A record that the file's end cuts short is a row with cut.

Both formats are read: the classic one (either byte order, micro- or nanoseconds) and the one of
blocks. Frames of Ethernet (with VLAN tags), Linux cooked captures, loopback and raw IP are
looked into; frames that are no TCP over IPv4 or IPv6 count as frames and are no packets.
"""

from __future__ import annotations

import ipaddress
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = (
    "capture_id string, block long, idx long, offset long, next_offset long, cut boolean, timestamp double, frame_len int, cap_len int, src_ip string, dst_ip string, src_port int, dst_port int, "
    "tcp_flags int, raw_seq long, raw_ack long, raw_window int, scale int, tcp_len int, ttl int, payload_hex string, tcp_options_tsval long, tcp_options_tsecr long, file_size long"
)
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
SPLIT = 64 << 20
#: Bytes that a record may hold, records of a chain that are looked at, and bytes read at a time.
LARGEST, CHAIN, CHUNK = 1 << 20, 4, 4 << 20
#: Seconds that a record may lie before or after the file's first one.
SPAN = 20 * 366 * 86400
#: Classic magics (byte order, ticks a second), link types, and kinds of blocks.
CLASSIC = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9)}
NULL, ETHERNET, RAW, RAW_OLD, LOOP, COOKED, COOKED2 = 0, 1, 101, 12, 108, 113, 276
SECTION, INTERFACE, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 3, 6


@dataclass
class Layout:
    """What a file's head says. links: (link type, ticks a second) of each interface."""

    blocks: bool
    order: str
    links: list[tuple[int, int]]
    first: int
    begins: float = 0.0


@dataclass
class Range(InputPartition):
    path: str
    size: int
    start: int
    end: int
    layout: Layout

    def __post_init__(self):
        InputPartition.__init__(self, None)


def open_file(path: str):
    fs, at = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
    return fs.open_input_file(at)


def files_of(path: str) -> list[tuple[str, int]]:
    """Files under a path (a file or a folder), in order, with their sizes."""
    fs, at = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
    info = fs.get_file_info(at)
    if info.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    found = [info] if info.is_file else fs.get_file_info(pyarrow.fs.FileSelector(at))
    return sorted((prefix + f.path, f.size) for f in found if f.is_file)


def layout_of(head: bytes, path: str) -> Layout:
    """From the first bytes of a file. Interfaces have to come before packets."""
    if head[:4] in CLASSIC and len(head) >= 24:
        order, ticks = CLASSIC[head[:4]]
        link = struct.unpack(order + "I", head[20:24])[0] & 0xFFFF
        begins = struct.unpack(order + "I", head[24:28])[0] if len(head) >= 28 else 0
        return Layout(False, order, [(link, ticks)], 24, float(begins))
    if head[:4] == b"\x0a\x0d\x0d\x0a" and len(head) >= 28:
        order = "<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"
        links, at = [], 0
        while at + 12 <= len(head):
            kind, size = struct.unpack(order + "II", head[at : at + 8])
            if kind not in (SECTION, INTERFACE) or size < 12:
                break
            if kind == INTERFACE:
                links.append(interface(head[at : at + size], order))
            at += size
        return Layout(True, order, links, at)
    raise ValueError(f"no capture file: {path}")


def interface(block: bytes, order: str) -> tuple[int, int]:
    """Link type and ticks a second of an interface block."""
    link, ticks, at = struct.unpack(order + "H", block[8:10])[0], 10**6, 16
    while at + 4 <= len(block) - 4:
        code, size = struct.unpack(order + "HH", block[at : at + 4])
        if code == 0:
            break
        if code == 9 and size:
            x = block[at + 4]
            ticks = 2 ** (x & 127) if x & 128 else 10**x
        at += 4 + (size + 3) // 4 * 4
    return link, ticks


def record_at(data: bytes, at: int, layout: Layout, whole: bool) -> int:
    """Length of the record that seems to begin there; 0: none; -1: more bytes are needed. whole: data reach to the file's end."""
    order = layout.order
    if layout.blocks:
        if at + 8 > len(data):
            return 0 if whole else -1
        kind, size = struct.unpack_from(order + "II", data, at)
        if size < 12 or size % 4 or size > LARGEST or not (kind < 32 or kind == SECTION):
            return 0
        if at + size > len(data):
            return 0 if whole else -1
        return size if struct.unpack_from(order + "I", data, at + size - 4)[0] == size else 0
    if at + 16 > len(data):
        return 0 if whole else -1
    seconds, ticks, size, full = struct.unpack_from(order + "IIII", data, at)
    fine = size <= LARGEST and size <= full <= 16 * LARGEST and ticks < layout.links[0][1] and abs(seconds - layout.begins) <= SPAN
    return 16 + size if fine else 0


def first_record(data: bytes, layout: Layout, whole: bool) -> int | None:
    """Where a chain of CHAIN records (or of fewer, up to the very end of the file) begins in data."""
    step = 4 if layout.blocks else 1
    for at in range(0, len(data), step):
        place, n = at, 0
        while n < CHAIN:
            size = record_at(data, place, layout, whole)
            if size <= 0:
                break
            place, n = place + size, n + 1
            if whole and place >= len(data):
                break
        if n == CHAIN or (n and size < 0) or (n and whole and place >= len(data)):
            return at
    return None


def segment(frame: bytes, link: int) -> tuple | None:
    """(src, dst, sport, dport, flags, seq, ack, window, scale, length, ttl, payload, tsval, tsecr) of a TCP frame."""
    if link == ETHERNET:
        at, kind = 14, frame[12:14]
        while kind in (b"\x81\x00", b"\x88\xa8", b"\x91\x00"):
            kind, at = frame[at + 2 : at + 4], at + 4
        if kind not in (b"\x08\x00", b"\x86\xdd"):
            return None
    else:
        at = {COOKED: 16, COOKED2: 20, NULL: 4, LOOP: 4, RAW: 0, RAW_OLD: 0}.get(link)
        if at is None:
            return None
    ip = frame[at:]
    if len(ip) < 20:
        return None
    if ip[0] >> 4 == 4:
        head = (ip[0] & 15) * 4
        if ip[9] != 6 or struct.unpack(">H", ip[6:8])[0] & 0x1FFF:
            return None
        total, ttl, src, dst = struct.unpack(">H", ip[2:4])[0], ip[8], ip[12:16], ip[16:20]
        total = total or len(ip)  # segments that the sender's card has yet to cut have none
    elif ip[0] >> 4 == 6 and len(ip) >= 40:
        head, following = 40, ip[6]
        while following in (0, 43, 60) and head + 8 <= len(ip):
            following, head = ip[head], head + 8 + 8 * ip[head + 1]
        if following != 6:
            return None
        total, ttl, src, dst = 40 + struct.unpack(">H", ip[4:6])[0], ip[7], ip[8:24], ip[24:40]
    else:
        return None
    tcp = ip[head:]
    if len(tcp) < 20:
        return None
    sport, dport, seq, ack, bits, window = struct.unpack(">HHIIHH", tcp[:16])
    size = (bits >> 12) * 4
    scale = tsval = tsecr = None
    place = 20
    while place < min(size, len(tcp)):
        kind = tcp[place]
        if kind == 0:
            break
        n = 1 if kind == 1 else tcp[place + 1] if place + 1 < len(tcp) else 0
        if n == 0 or place + n > len(tcp):
            break
        if kind == 3 and n == 3:
            scale = min(tcp[place + 2], 14)
        if kind == 8 and n == 10:
            tsval, tsecr = struct.unpack(">II", tcp[place + 2 : place + 10])
        place += n
    length = max(0, total - head - size)
    return str(ipaddress.ip_address(src)), str(ipaddress.ip_address(dst)), sport, dport, bits & 0x1FF, seq, ack, window, scale, length, ttl, tcp[size : size + length].hex(), tsval, tsecr


class CaptureReader(DataSourceReader):
    def __init__(self, paths: list[str], split: int | None, strict: bool = True):
        self.paths, self.split, self.strict = paths, split, strict

    def partitions(self) -> list[Range]:
        out = []
        for path, size in (found for p in self.paths for found in files_of(p)):
            with open_file(path) as f:
                try:
                    layout = layout_of(f.read(1 << 16), path)
                except (ValueError, struct.error):
                    if self.strict:
                        raise
                    continue
            step = self.split or max(size, 1)
            out += [Range(path, size, at, min(at + step, size), layout) for at in range(0, max(size, 1), step)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        layout, rows, n = part.layout, [], 0
        links = list(layout.links)
        with open_file(part.path) as f:
            at = part.start
            if at == 0:
                at = layout.first
                rows.append(self.row(part, 0, at, at, None))  # so that a file's first range has a row
            else:
                window = f.read_at(min((CHAIN + 1) * LARGEST + part.end - part.start, part.size - at), at)
                found = first_record(window, layout, at + len(window) == part.size)
                if found is None:
                    return
                at += found
            data, base = b"", at
            while at < part.end:
                if at - base + LARGEST + 64 > len(data) and base + len(data) < part.size:
                    data, base = f.read_at(min(CHUNK, part.size - at), at), at
                place, left = at - base, part.size - at
                size, body, wrong = self.one(data, place, left, layout)
                if size is None or size > left:
                    rows.append(self.row(part, n, at, part.size, True))
                    break
                if wrong:  # a new section: what it says cannot be known in other ranges
                    if self.split:
                        rows.append(self.row(part, n, at, -1, None))
                    else:
                        links = [*links, interface(data[place : place + size], layout.order)] if wrong == INTERFACE else []
                elif body is not None:
                    rows.append(self.packet(part, n, at, at + size, links, *body))
                    n += 1
                else:
                    rows.append(self.row(part, n, at, at + size, None))
                at += size
                if len(rows) >= 5000:
                    yield self.batch(rows)
                    rows = []
        yield self.batch(rows)

    @staticmethod
    def one(data: bytes, place: int, left: int, layout: Layout):
        """Size of the record at a place (None: not even its head is there), (time in ticks, interface, frame, full length) and the kind of block that describes others."""
        order = layout.order
        if not layout.blocks:
            if left < 16:
                return None, None, 0
            seconds, ticks, size, full = struct.unpack_from(order + "IIII", data, place)
            return 16 + size, (seconds, ticks, 0, data[place + 16 : place + 16 + size], full), 0
        if left < 12:
            return None, None, 0
        kind, size = struct.unpack_from(order + "II", data, place)
        if size < 12:
            return None, None, 0
        if kind in (SECTION, INTERFACE):
            return size, None, kind
        if kind == ENHANCED and size >= 32 and size <= left:
            number, high, low, cap, full = struct.unpack_from(order + "IIIII", data, place + 8)
            return size, (None, (high << 32) | low, number, data[place + 28 : place + 28 + cap], full), 0
        if kind == SIMPLE and size >= 16 and size <= left:
            full = struct.unpack_from(order + "I", data, place + 8)[0]
            return size, (None, None, 0, data[place + 12 : place + size - 4][:full], full), 0
        return size, None, 0

    @staticmethod
    def row(part: Range, n: int, at: int, to: int, cut: bool | None) -> tuple:
        return (part.path, part.start, None if cut is None else n, at, to, bool(cut), *[None] * (len(NAMES) - 7), part.size)

    @staticmethod
    def packet(part: Range, n: int, at: int, to: int, links, seconds, ticks, number, frame, full) -> tuple:
        link, rate = links[number] if number < len(links) else (None, 10**6)
        time = None if ticks is None else ticks / rate if seconds is None else seconds + ticks / rate
        try:
            said = segment(frame, link)
        except (IndexError, struct.error):  # cut within its heads
            said = None
        return (part.path, part.start, n, at, to, False, time, full, len(frame), *(said or [None] * 14), part.size)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
        columns = list(zip(*rows)) if rows else [()] * len(NAMES)
        return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[x.split()[1]]) for c, x in zip(columns, SCHEMA.split(", "))], NAMES)


class CaptureSource(DataSource):
    """spark.read.format("capture").load(path).

    Options: split, the bytes of a range, 0 for whole files; paths, a JSON list instead of one path; strict, false to pass over
    files that are no captures.
    """

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptureReader:
        split = int(self.options.get("split", SPLIT))
        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        return CaptureReader(paths, split or None, self.options.get("strict", "true") == "true")


def records(spark: SparkSession, path: str | list[str], split: int = SPLIT, strict: bool = True) -> DataFrame:
    """Records of all files under path. Ranges of a file that do not fit together are taken from one more read of it, as a whole."""
    spark.dataSource.register(CaptureSource)
    of = lambda paths, split: spark.read.format("capture").options(split=str(split), paths=json.dumps(paths), strict=str(strict).lower()).load()
    df = of([path] if isinstance(path, str) else path, split)
    ends = df.groupBy("capture_id", "block").agg(F.min("offset").alias("first"), F.max("next_offset").alias("last"), F.min("next_offset").alias("least"), F.max("file_size").alias("size"))
    order = Window.partitionBy("capture_id").orderBy("block")  # a row a range
    ends = ends.withColumns({"before": F.lag("last").over(order), "after": F.lead("first").over(order)})
    torn = ends.where("before <> first OR least < 0 OR (after IS NULL AND last <> size)").select("capture_id").distinct().collect()
    if not torn:
        return df
    names = [r.capture_id for r in torn]
    return df.where(~F.col("capture_id").isin(names)).unionByName(of(names, 0))


def read(spark: SparkSession, path: str | list[str], port: int | None = None, max_packets: int | None = None, split: int = SPLIT, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Packets in the shape of field text, with ttl, and a row a file: capture_id, frames, packets, file_cut_short.

    Frames are numbered by their place in the file: a range adds the counts of earlier ones. Sequence
    numbers count from the first of each direction, windows are scaled where both sides agreed on it.
    A file of which nothing can be read, but its beginning, is an error; an empty one is not. Unless strict, its row (cut short,
    without frames) tells it, and what is no capture at all has no row.
    """
    rows = records(spark, path, split, strict)
    sizes = rows.groupBy("capture_id", "block").agg(F.count("idx").alias("n"), F.max("cut").alias("cut"))
    order = Window.partitionBy("capture_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    status = rows.groupBy("capture_id").agg(F.count_if(F.col("idx").isNotNull() & ~F.col("cut")).alias("frames"), F.count("raw_seq").alias("packets"), F.max("cut").alias("file_cut_short"))
    broken = status.where("file_cut_short AND frames = 0").limit(1).collect() if strict else []
    if broken:
        raise RuntimeError(f"no packet can be read of {broken[0].capture_id}: its first record is cut short")
    p = rows.where("raw_seq IS NOT NULL AND timestamp IS NOT NULL").join(before.select("capture_id", "block", "before"), ["capture_id", "block"])
    p = p.withColumn("frame_number", F.col("before") + F.col("idx") + 1).drop("before", "block", "idx", "offset", "next_offset", "cut", "file_size")
    p = p if port is None else p.where((F.col("src_port") == port) | (F.col("dst_port") == port))
    way = ["capture_id", "src_ip", "src_port", "dst_ip", "dst_port"]
    syn = F.col("tcp_flags").bitwiseAND(2) != 0
    start = p.groupBy(*way).agg(F.min_by(F.struct("raw_seq", "raw_ack", syn.alias("syn")), "frame_number").alias("f"), F.min_by("scale", F.when(syn, F.col("frame_number"))).alias("own_scale"))
    start = start.select(*way, F.when(F.col("f.syn"), F.col("f.raw_seq")).otherwise(F.col("f.raw_seq") - 1).alias("base"), (F.col("f.raw_ack") - 1).alias("ack_base"), "own_scale")
    turned = start.select("capture_id", F.col("dst_ip").alias("src_ip"), F.col("dst_port").alias("src_port"), F.col("src_ip").alias("dst_ip"), F.col("src_port").alias("dst_port"), F.col("base").alias("peer_base"), F.col("own_scale").alias("peer_scale"))
    p = p.join(start, way).join(turned, way, "left")
    wrap = lambda c: F.pmod(c, F.lit(1 << 32)).cast("long")
    scaled = F.when(~syn & F.col("own_scale").isNotNull() & F.col("peer_scale").isNotNull(), F.col("raw_window") * F.pow(F.lit(2), F.col("own_scale"))).otherwise(F.col("raw_window")).cast("long")
    ack = F.when(F.col("tcp_flags").bitwiseAND(16) == 0, F.lit(0)).otherwise(wrap(F.col("raw_ack") - F.coalesce("peer_base", "ack_base")))
    no = F.lit(False)
    out = p.select(
        "capture_id", F.col("frame_number").alias("pkt_ord"), "timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "tcp_flags", wrap(F.col("raw_seq") - F.col("base")).alias("tcp_seq"), ack.cast("long").alias("tcp_ack"), scaled.alias("tcp_window"), "tcp_len", "frame_number",
        F.lit(None).cast("long").alias("tcp_stream"), "frame_len", "cap_len", "payload_hex", no.alias("ws_retransmission"), no.alias("ws_fast_retransmission"), no.alias("ws_spurious_retransmission"), "tcp_options_tsval", "tcp_options_tsecr", "ttl",
    )
    return (out if max_packets is None else out.orderBy("capture_id", "pkt_ord").limit(max_packets)), status
