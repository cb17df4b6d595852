"""Files of the kinds the sources read, written by Spark from the tables."""

from __future__ import annotations

import ipaddress
import struct
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from flowloom.runtime import new_table_path

PER_FILE = 2000


@lru_cache(1 << 16)
def _packed(ip: str) -> bytes:
    return ipaddress.ip_address(ip).packed


def _frame(row) -> bytes:
    """An Ethernet frame with the header fields of a packet row."""
    if row.source_ip is None or row.protocol_number == 0:
        return b"\x00" * 12 + b"\x08\x06" + b"\x00" * 28
    flags = row.syn_flag * 2 | row.rst_flag * 4 | row.psh_flag * 8 | row.ack_flag * 16
    if row.protocol == "TCP":
        body = struct.pack(">HHIIBBHHH", int(row.source_port), int(row.destination_port), 0, 0, 0x50, flags, 0, 0, 0)
    elif row.protocol == "UDP":
        body = struct.pack(">HHHH", int(row.source_port), int(row.destination_port), 8, 0)
    else:
        body = b"\x08\x00\x00\x00"
    body = body.ljust(row.length, b"\x00")
    ends = _packed(row.source_ip) + _packed(row.destination_ip)
    head = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 0, 0, row.ttl, row.protocol_number, 0) + ends
    return b"\x00" * 12 + b"\x08\x00" + head + body


def write_captures(packets: DataFrame) -> str:
    """One capture file per sensor and stretch of ``PER_FILE`` numbers."""
    folder = new_table_path(packets.sparkSession, "captures")

    def write(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs
        where, name = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        where.create_dir(name, recursive=True)
        parts = [struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)]
        for row in pdf.sort_values("seq").astype(object).where(pdf.notna(), None).itertuples(index=False):
            data = _frame(row)
            parts.append(struct.pack("<IIII", row.ts_us // 1_000_000, row.ts_us % 1_000_000, len(data), len(data)) + data)
        with where.open_output_stream(f"{name}/{key[0]}-{key[1]}.pcap") as out:
            out.write(b"".join(parts))
        return pd.DataFrame({"packets": [len(pdf)]})

    stretch = F.floor(F.col("seq") / PER_FILE).alias("stretch")
    packets.groupBy("sensor_id", stretch).applyInPandas(write, "packets long").agg(F.sum("packets")).collect()
    return folder


def write_csv(df: DataFrame, name: str, padded: bool = False) -> str:
    """CSV with a header, its names padded as public files have them."""
    path = new_table_path(df.sparkSession, name)
    named = df.toDF(*[f" {c.title()}" for c in df.columns]) if padded else df
    named.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path
