"""Stateless packet expressions: ports, flow keys, flags, addresses."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from ..config import ENCRYPTED_PORTS, TRUSTED_PORTS
from .columns import filled, is_true, short_digest, text

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_PATTERN = rf"^{_OCTET}(\.{_OCTET}){{3}}$"


def either_port_in(ports) -> Column:
    return is_true(F.col("source_port").isin(*ports)) | is_true(F.col("destination_port").isin(*ports))


def encrypted_likely() -> Column:
    """Either end on a port that usually carries encrypted traffic."""
    return either_port_in(ENCRYPTED_PORTS)


def trusted_port() -> Column:
    """Either end on a port of known high-bandwidth traffic."""
    return either_port_in(TRUSTED_PORTS)


def portless() -> Column:
    """No port on either end: fragments and all ICMP."""
    return F.col("source_port").isNull() & F.col("destination_port").isNull()


def protocol_key() -> Column:
    """The protocol number, or the protocol name where the number is absent or 0."""
    number = F.col("protocol_number")
    return F.when(number != 0, number.cast("string")).otherwise(F.col("protocol"))


def flow_key() -> Column:
    """Source, destination and protocol as one never-null text: the grouping
    key of a flow. Directional, and without ports."""
    parts = [F.col("source_ip"), F.col("destination_ip"), protocol_key()]
    return F.concat_ws("|", *[F.coalesce(p, F.lit("None")) for p in parts])


def flow_id(key: Column | str | None = None) -> Column:
    """Short display id of a flow key. 32 bits, so distinct flows may share it."""
    return short_digest(flow_key() if key is None else text(key))


def flag_sum() -> Column:
    zero = F.lit(0)
    return sum((F.coalesce(F.col(f"{n}_flag"), zero) for n in ("syn", "ack", "rst", "psh")), zero)


def tcp_flag_columns(flags: Column) -> dict[str, Column]:
    """The four flag columns from a raw TCP flag byte."""
    masks = {"syn_flag": 0x02, "ack_flag": 0x10, "rst_flag": 0x04, "psh_flag": 0x08}
    return {n: (flags.bitwiseAND(F.lit(m)) != 0).cast("int") for n, m in masks.items()}


def endpoint(ip: Column | str, port: Column | str) -> Column:
    """``ip:port``, ``ip`` without a port (0 is none), ``-`` without an ip."""
    ip, port = filled(ip), text(port)
    shown = F.when(is_true(port != 0), F.concat_ws(":", ip, port.cast("string"))).otherwise(ip)
    return F.coalesce(F.when(ip.isNotNull(), shown), F.lit("-"))


def is_ipv4(col: Column | str) -> Column:
    return is_true(text(col).rlike(IPV4_PATTERN))


def is_ipv6(col: Column | str) -> Column:
    """Eight groups, or fewer with one ``::``; the last two may be written as
    an IPv4 address, and a zone may follow."""
    plain = F.regexp_replace(text(col), "%[^%]+$", "")
    tail = F.regexp_extract(plain, ":([0-9.]+)$", 1)
    plain = F.when(tail.contains(".") & is_ipv4(tail), F.regexp_replace(plain, ":[0-9.]+$", ":0:0")).otherwise(plain)
    group = "[0-9a-fA-F]{1,4}"
    groups = F.size(F.filter(F.split(plain, ":"), lambda g: g != ""))
    short = plain.rlike(f"^({group}(:{group})*)?::({group}(:{group})*)?$") & (groups <= 7)
    return is_true(plain.rlike(f"^({group}:){{7}}{group}$") | short)


@F.pandas_udf(T.StringType())
def _canonical_ipv6(texts: pd.Series) -> pd.Series:
    def one(value):
        try:
            return str(ipaddress.ip_address(value))
        except ValueError:
            return None
    seen = {v: one(v) for v in texts.dropna().unique()}
    return pd.Series([seen.get(v) for v in texts], index=texts.index, dtype=object)


def normalise_ip(col: Column | str) -> Column:
    """Canonical text of an address, null if it is none. IPv4 stays in the JVM;
    only texts with a colon go through Arrow. Meant for small inputs such as
    block commands and blocking candidates."""
    c = text(col)
    return F.when(is_ipv4(c), c).otherwise(_canonical_ipv6(F.when(c.contains(":"), c)))
