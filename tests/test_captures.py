import struct

import pytest

from flowloom.operators import features as feat
from flowloom.sources.captures import capture_filter, capture_rejects, read_captures


def ethernet(kind, body, vlan=False):
    tag = struct.pack(">HH", 0x8100, 7) if vlan else b""
    return b"\x00" * 12 + tag + struct.pack(">H", kind) + body


def ipv4(proto, body, src="10.0.0.1", dst="10.0.0.2", frag=0, ttl=64):
    head = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 1, frag, ttl, proto, 0)
    return head + bytes(map(int, src.split("."))) + bytes(map(int, dst.split("."))) + body


def ipv6(nxt, body, hop=60):
    return struct.pack(">IHBB", 6 << 28, len(body), nxt, hop) + b"\x20\x01" + b"\x00" * 13 + b"\x01" + \
        b"\x20\x01" + b"\x00" * 13 + b"\x02" + body


def tcp(sport, dport, flags):
    return struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 0x50, flags, 0, 0, 0)


def udp(sport, dport, body=b""):
    return struct.pack(">HHHH", sport, dport, 8 + len(body), 0) + body


PACKETS = [
    (ethernet(0x0800, ipv4(6, tcp(1234, 443, 0x12))), ("10.0.0.1", "10.0.0.2", 1234, 443, "TCP", 6, 64, 1, 1, 0, 0)),
    (ethernet(0x0800, ipv4(17, udp(53, 5353, b"xy"), ttl=9), True), ("10.0.0.1", "10.0.0.2", 53, 5353, "UDP", 17, 9, 0, 0, 0, 0)),
    (ethernet(0x0800, ipv4(1, b"\x08\x00\x00\x00")), ("10.0.0.1", "10.0.0.2", None, None, "ICMP", 1, 64, 0, 0, 0, 0)),
    (ethernet(0x0800, ipv4(6, tcp(1, 2, 0xFF), frag=5)), ("10.0.0.1", "10.0.0.2", None, None, "IP", 6, 64, 0, 0, 0, 0)),
    (ethernet(0x86DD, ipv6(6, tcp(80, 9, 0x0C))), ("2001::1", "2001::2", 80, 9, "TCP", 6, 60, 0, 0, 1, 1)),
    (ethernet(0x86DD, ipv6(0, bytes([17, 0]) + b"\x00" * 6 + udp(7, 8))), ("2001::1", "2001::2", 7, 8, "UDP", 0, 60, 0, 0, 0, 0)),
    (ethernet(0x0800, ipv4(4, ipv4(6, tcp(5, 6, 2), "1.1.1.1", "2.2.2.2"))), ("10.0.0.1", "10.0.0.2", 5, 6, "TCP", 4, 64, 1, 0, 0, 0)),
    (ethernet(0x0806, b"\x00" * 28), (None, None, None, None, "ARP", 0, 0, 0, 0, 0, 0)),
    (ethernet(0x0800, b"\x45"), (None, None, None, None, "UNKNOWN", 0, 0, 0, 0, 0, 0)),
]


def write_pcap(path, packets, order="<", nano=False):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    with open(path, "wb") as f:
        f.write(struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1))
        for i, data in enumerate(packets):
            f.write(struct.pack(order + "IIII", 1_700_000_000, i * (1000 if nano else 1), len(data), len(data)) + data)


def write_pcapng(path, packets):
    def block(kind, body):
        size = 12 + len(body)
        return struct.pack("<II", kind, size) + body + struct.pack("<I", size)
    with open(path, "wb") as f:
        f.write(block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)))
        f.write(block(1, struct.pack("<HHI", 1, 0, 0) + struct.pack("<HHB3xHH", 9, 1, 9, 0, 0)))
        for i, data in enumerate(packets):
            stamp = 1_700_000_000_000_000_000 + i * 1000
            pad = b"\x00" * (-len(data) % 4)
            f.write(block(6, struct.pack("<IIIII", 0, stamp >> 32, stamp & 0xFFFFFFFF, len(data), len(data)) + data + pad))


FIELDS = ("source_ip", "destination_ip", "source_port", "destination_port", "protocol", "protocol_number", "ttl",
          "syn_flag", "ack_flag", "rst_flag", "psh_flag")


@pytest.mark.parametrize("chunk, size", [(2, 64 << 20), (1000, 64 << 20), (1000, 150), (2, 37)])
def test_all_formats(spark, folder, chunk, size):
    raw = [p for p, _ in PACKETS]
    write_pcap(f"{folder}/a.pcap", raw)
    write_pcap(f"{folder}/b.CAP", raw, ">", nano=True)
    write_pcapng(f"{folder}/c.pcapng", raw)
    with open(f"{folder}/notes.txt", "wb") as f:
        f.write(b"no capture")
    with open(f"{folder}/broken.pcap", "wb") as f:
        f.write(b"\x00\x01")
    rows = read_captures(spark, folder, chunk_packets=chunk, chunk_bytes=size).collect()
    assert len({r.session_id for r in rows}) == 3 and len(rows) == 3 * len(PACKETS)
    for r in rows:
        data, want = PACKETS[r.seq]
        assert tuple(r[f] for f in FIELDS) == want, r
        assert r.length == len(data) and r.ts_us == 1_700_000_000_000_000 + r.seq


def test_limit_and_cut_off_file(spark, folder):
    write_pcap(f"{folder}/a.pcap", [PACKETS[0][0]] * 20)
    assert read_captures(spark, folder, packet_limit=5, chunk_packets=3).count() == 5
    with pytest.raises(ValueError):
        read_captures(spark, folder, packet_limit=0)
    assert read_captures(spark, folder, packet_limit=60_000).count() == 20
    with open(f"{folder}/a.pcap", "rb") as f:
        whole = f.read()
    with open(f"{folder}/b.pcap", "wb") as f:
        f.write(whole[:-10])
    assert read_captures(spark, folder).count() == 39
    with open(f"{folder}/c.pcap", "wb") as f:
        f.write(b"\x00\x01")
    found = {(r.path.rsplit("/", 1)[1], r.at > 0) for r in capture_rejects(spark, folder).collect()}
    assert found == {("b.pcap", True), ("c.pcap", False)}


@pytest.mark.parametrize("size", [100, 1000, 5000])
def test_ranges_of_one_file(spark, folder, size):
    """Ranges are surveyed by themselves; payloads that hold whole captures, and
    zeros, lead to wrong guesses, which are walked again."""
    plain = [PACKETS[i % 3][0] + bytes(i % 50) for i in range(60)]
    write_pcap(f"{folder}/inner", plain)
    write_pcapng(f"{folder}/innerng", plain)
    decoys = [open(f"{folder}/{n}", "rb").read() for n in ("inner", "innerng")]
    raw = plain + [PACKETS[1][0] + decoys[0]] + plain + [PACKETS[1][0] + decoys[1], bytes(3000)] + plain
    write_pcap(f"{folder}/a.pcap", raw)
    write_pcapng(f"{folder}/b.pcapng", raw)
    whole = open(f"{folder}/b.pcapng", "rb").read()
    with open(f"{folder}/c.pcapng", "wb") as f:
        f.write(whole + whole[:-30])  # a second section, cut off
    with open(f"{folder}/d.pcap", "wb") as f:  # a length of nearly 4 GB in the middle
        f.write(open(f"{folder}/a.pcap", "rb").read() + b"\xff" * 16 + open(f"{folder}/a.pcap", "rb").read()[24:])
    def rows(chunk_bytes):
        found = read_captures(spark, folder, chunk_bytes=chunk_bytes, chunk_packets=100)
        return sorted(tuple(str(v) for v in r) for r in found.collect())
    got = rows(size)
    assert len(got) == 2 * len(raw) + 2 * len(raw) - 1 + len(raw) and got == rows(64 << 20)
    by_file = {}
    for r in read_captures(spark, folder, chunk_bytes=size).select("session_id", "seq", "length").collect():
        by_file.setdefault(r.session_id.rsplit("/", 1)[1], {})[r.seq] = r.length
    lengths = dict(enumerate(map(len, raw)))
    assert by_file["a.pcap"] == by_file["b.pcapng"] == by_file["d.pcap"] == lengths
    faults = {(r.path.rsplit("/", 1)[1], r.at) for r in capture_rejects(spark, folder, chunk_bytes=size).collect()}
    cut = len(whole) * 2 - 30
    assert {n for n, _ in faults} == {"c.pcapng", "d.pcap"} and all(len(whole) < at < cut for n, at in faults if n == "c.pcapng")
    if size == 1000:
        from flowloom.sources import captures
        assert captures._indexed(spark, folder, 100, size).filter("path LIKE '%a.pcap'").count() > 10


def test_filter_comes_before_running_features(spark, folder):
    write_pcap(f"{folder}/a.pcap", [p for p, _ in PACKETS])
    packets = read_captures(spark, folder)
    kept = capture_filter(packets, protocols=("tcp",))
    assert kept.count() == 3
    assert capture_filter(packets, ports=(53,)).count() == 1
    assert capture_filter(packets, hosts=("2001::2",)).count() == 2
    rows = feat.packet_features(kept, skew="whole").filter("source_ip = '10.0.0.1'").collect()
    assert sorted(r.total_packets for r in rows) == [1, 1]


def test_files_are_assembled_by_many_tasks(spark, folder):
    """However few bytes the surveyed ranges have: most of the work is to open the files."""
    from pyspark.sql import functions as F
    from flowloom.sources import captures
    for i in range(24):
        write_pcap(f"{folder}/{i}.pcap", [p for p, _ in PACKETS])
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        index = captures._indexed(spark, folder, 100, 1 << 16)
        assert index.filter("packets > 0").count() == 24
        assert index.select(F.spark_partition_id()).distinct().count() > 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
