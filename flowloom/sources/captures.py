"""Capture files (pcap, pcapng) to packet rows.

One huge file is not one task's work. Byte ranges of all files are surveyed in
parallel: a task looks for a place in its range from which a chain of plausible
record headers starts, and hops on to the end of the range. The few rows this
gives of each file are then put in order: a range counts as read if it started
where the one before it ended, so a wrong guess is always found out, and that
range alone is walked again from the true place. Chunks with their packet
numbers follow, and are parsed in parallel with numpy.
"""

from __future__ import annotations

import ipaddress
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import network as net
from ..schemas import PACKETS

# --- Fixed values: file formats and protocol numbers ------------------------
EXTENSIONS = ("pcap", "pcapng", "cap")
PCAP_MAGICS = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1),
               b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
PCAPNG_MAGIC = b"\x0a\x0d\x0d\x0a"
BLOCK_SECTION, BLOCK_INTERFACE, BLOCK_PACKET = 0x0A0D0D0A, 1, 6
BLOCKS_UNREAD = (2, 3)  # packet blocks without time or of old captures
LINK_NULL, LINK_ETHERNET, LINK_RAW, LINK_SLL = 0, 1, 101, 113
RAW_LINKS = (12, 14, LINK_RAW, 228, 229)
ETHER_IPV4, ETHER_IPV6, ETHER_ARP = 0x0800, 0x86DD, 0x0806
ETHER_VLAN = (0x8100, 0x88A8)
PROTO_ICMP, PROTO_IPIP, PROTO_TCP, PROTO_UDP, PROTO_IPV6 = 1, 4, 6, 17, 41
IPV6_EXTENSIONS = (0, 43, 60)
# --- End of fixed values ----------------------------------------------------

CHUNKS = "path string, start bigint, stop bigint, first_seq bigint, packets bigint, about string"
SURVEY = ("path string, size bigint, at bigint, upto bigint, start bigint, stop bigint, packets bigint, "
          "news string, unread bigint, ended boolean")
INDEX = f"{CHUNKS}, at bigint, reason string"
HEADER_BYTES = 256  # more than any header chain that is looked into
PACKETS_AT_ONCE, BYTES_AT_ONCE = 1 << 14, 16 << 20  # small chunks are parsed together up to either
GUESS_BYTES = 1 << 20  # bytes whose places are tried at once
GUESS_CHAIN = 6        # plausible headers in a row that make a guess
LIKELY_LENGTH = 1 << 18
LIKELY_STEP = 7 * 86400  # seconds between packets that follow each other


class _File:
    """Random access with read-ahead, on any file system pyarrow knows."""

    def __init__(self, path: str):
        from pyarrow import fs
        uri = path if "://" in path else path.replace("file:", "file://", 1)
        where, name = fs.FileSystem.from_uri(uri)
        self._file = where.open_input_file(name)
        self.size = self._file.size()
        self._at, self._block = 0, b""

    def read(self, at: int, n: int) -> bytes:
        if at < self._at or at + n > self._at + len(self._block):
            self._file.seek(at)
            self._at, self._block = at, self._file.read(max(n, 1 << 20))
        return self._block[at - self._at: at - self._at + n]

    def close(self) -> None:
        self._file.close()


@dataclass
class _Record:
    at: int        # file offset of the record
    end: int       # offset of the next one
    data: int      # offset of the packet bytes
    length: int    # captured bytes
    ts_us: int
    link: int


def _resolution(options: bytes, order: str) -> int:
    """Ticks per second of a pcapng interface."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "HH", options, at)
        if code == 9 and size:
            value = options[at + 4]
            return 1 << (value & 0x7F) if value & 0x80 else 10 ** value
        if code == 0:
            break
        at += 4 + size + (-size) % 4
    return 1_000_000


def _records(f: _File, start: int, stop: int, about: dict) -> Iterator[_Record]:
    """Packet records in a stretch of a file. ``about`` carries byte order and
    interfaces, and is kept up to date as blocks are passed. A record cut off by
    the end of the file ends the stretch, at offset ``about["at"]``; packet
    blocks of kinds that are not read are counted in ``about["unread"]``."""
    at = start
    if about["format"] == "pcap":
        order, ticks = about["order"], about["ticks"]
        while at + 16 <= stop:
            about["at"] = at
            sec, sub, size, _ = struct.unpack(order + "IIII", f.read(at, 16))
            if at + 16 + size > f.size:
                return
            yield _Record(at, at + 16 + size, at + 16, size, sec * 1_000_000 + sub // ticks, about["link"])
            at += 16 + size
        about["at"] = at
        return
    while at + 12 <= stop:
        about["at"] = at
        head = f.read(at, 12)
        if head[:4] == PCAPNG_MAGIC:
            about["order"] = "<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"
            about["links"] = []
        order = about["order"]
        kind, size = struct.unpack(order + "II", head[:8])
        if size < 12 or at + size > f.size:
            return
        if kind == BLOCK_INTERFACE:
            body = f.read(at, size)
            link = struct.unpack_from(order + "H", body, 8)[0]
            about["links"] = about["links"] + [[link, _resolution(body[16:-4], order)]]
        elif kind == BLOCK_PACKET:
            which, high, low, length = struct.unpack(order + "IIII", f.read(at + 8, 16))
            link, ticks = about["links"][which]
            stamp = ((high << 32) | low) * 1_000_000 // ticks
            yield _Record(at, at + size, at + 28, length, stamp, link)
        elif kind in BLOCKS_UNREAD:
            about["unread"] = about.get("unread", 0) + 1
        at += size
    about["at"] = at


def _open(path: str) -> tuple[_File, int, dict] | None:
    f = _File(path)
    magic = f.read(0, 4)
    if magic in PCAP_MAGICS and f.size >= 24:
        order, ticks = PCAP_MAGICS[magic]
        link = struct.unpack(order + "I", f.read(20, 4))[0] & 0xFFFF
        return f, 24, {"format": "pcap", "order": order, "ticks": ticks, "link": link}
    if magic == PCAPNG_MAGIC:
        return f, 0, {"format": "pcapng", "order": "<", "links": []}
    f.close()
    return None


def _first_packets(limit: int, chunk_packets: int, chunk_bytes: int):
    """Chunks of the first packets of each file: one task reads no further."""
    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                opened = _open(path)
                if opened is None:
                    continue
                f, start, about = opened
                state, first, count, stop, out = json.dumps(about), 0, 0, start, []
                for n, rec in enumerate(islice(_records(f, start, f.size, about), limit)):
                    count, stop = count + 1, rec.end
                    if count >= chunk_packets or stop - start >= chunk_bytes:
                        out.append((path, start, stop, first, count, state))
                        state, first, count, start = json.dumps(about), n + 1, 0, stop
                if count:
                    out.append((path, start, stop, first, count, state))
                f.close()
                yield pd.DataFrame(out, columns=["path", "start", "stop", "first_seq", "packets", "about"])
    return index


@dataclass
class _Piece:
    """A stretch of whole records. ``news``: sections and interfaces in it;
    ``ended``: the record after it is cut off or corrupt."""
    start: int
    stop: int
    packets: int = 0
    news: list = field(default_factory=list)
    unread: int = 0
    ended: bool = False


def _hop(f: _File, start: int, upto: int, about: dict, most: int) -> list[_Piece]:
    """The records that begin before ``upto``, from one that begins at
    ``start``, in pieces of at most ``most`` packets; none is taken apart."""
    pcap, order, size = about["format"] == "pcap", about["order"], f.size
    header = 16 if pcap else 12
    piece = _Piece(start, start)
    pieces = [piece]
    while piece.stop < upto and piece.stop + header <= size:
        if piece.packets >= most:
            piece = _Piece(piece.stop, piece.stop)
            pieces.append(piece)
        at = piece.stop
        head = f.read(at, header)
        if pcap:
            kind, length = BLOCK_PACKET, 16 + struct.unpack_from(order + "I", head, 8)[0]
        else:
            if head[:4] == PCAPNG_MAGIC:
                order = "<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"
            kind, length = struct.unpack_from(order + "II", head)
        if length < header or at + length > size:
            piece.ended = True
            return pieces
        if kind == BLOCK_PACKET:
            piece.packets += 1
        elif kind == BLOCK_SECTION:
            piece.news.append([order])
        elif kind == BLOCK_INTERFACE:
            body = f.read(at, length)
            piece.news.append([struct.unpack_from(order + "H", body, 8)[0], _resolution(body[16:-4], order)])
        elif kind in BLOCKS_UNREAD:
            piece.unread += 1
        piece.stop = at + length
    piece.ended = size - header < piece.stop < size  # less than a header is left
    return pieces


def _after(about: dict, news: list) -> dict:
    """What holds behind a piece with these sections and interfaces."""
    for item in news:
        if len(item) == 1:
            about = {**about, "order": item[0], "links": []}
        else:
            about = {**about, "links": about["links"] + [item]}
    return about


def _plausible(f: _File, at: int, about: dict) -> tuple[int, int] | None:
    """(next offset, second) if a record header may be at ``at``."""
    order = about["order"]
    if about["format"] == "pcap":
        head = f.read(at, 16)
        if len(head) < 16:
            return None
        sec, sub, length, whole = struct.unpack(order + "IIII", head)
        good = 0 < length <= min(whole, LIKELY_LENGTH) and sub < 1_000_000 * about["ticks"] and at + 16 + length <= f.size
        return (at + 16 + length, sec) if good else None
    head = f.read(at, 8)
    if len(head) < 8:
        return None
    length = struct.unpack(order + "II", head)[1]
    if not 12 <= length <= 16 * LIKELY_LENGTH or length % 4 or at + length > f.size:
        return None
    return (at + length, 0) if f.read(at + length - 4, 4) == head[4:8] else None


def _chained(f: _File, at: int, about: dict) -> bool:
    second = None
    for _ in range(GUESS_CHAIN):
        found = _plausible(f, at, about)
        if found is None or (second is not None and abs(found[1] - second) > LIKELY_STEP):
            return False
        at, second = found
        if at == f.size:
            return True
    return True


def _guess(f: _File, at: int, upto: int, about: dict) -> int | None:
    """The first place from ``at`` on, before ``upto``, that looks like a record."""
    step = 1 if about["format"] == "pcap" else 4
    at += -at % step
    while at < upto:
        n = min(GUESS_BYTES, upto - at)
        places = np.arange(0, n, step)
        buf = np.frombuffer(f.read(at, min(n + 16, f.size - at)), dtype=np.uint8)
        places = places[places + 16 <= len(buf)]
        little = about["order"] == "<"
        if step == 1:
            length, whole = _number(buf, places + 8, little), _number(buf, places + 12, little)
            places = places[(length > 0) & (length <= whole) & (length <= LIKELY_LENGTH)
                            & (_number(buf, places + 4, little) < 1_000_000 * about["ticks"])]
        else:
            length = _number(buf, places + 4, little)
            places = places[(length >= 12) & (length % 4 == 0) & (length <= 16 * LIKELY_LENGTH)]
        for place in places.tolist():
            if _chained(f, at + place, about):
                return at + place
        at += n
    return None


def _number(buf: np.ndarray, at: np.ndarray, little: bool) -> np.ndarray:
    """Unsigned numbers of four bytes at the given places."""
    out = np.zeros(len(at), dtype=np.int64)
    for i in range(4):
        out = (out << 8) | buf[at + (3 - i if little else i)]
    return out


def _survey(chunk_packets: int):
    """Each byte range on its own; a range without a likely record gives a row
    without ``start``, a file of an unknown format one row at 0."""
    def survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, size, at, upto in batch[["path", "size", "at", "upto"]].itertuples(index=False):
                opened = _open(path)
                if opened is None:
                    continue
                f, first, about = opened
                if about["format"] == "pcapng":
                    about["order"] = "<" if f.read(8, 4) == b"\x4d\x3c\x2b\x1a" else ">"
                start = first if at <= first < upto else None if upto <= first else _guess(f, at, upto, about)
                for p in [] if start is None else _hop(f, start, upto, about, chunk_packets):
                    out.append((path, size, at, upto, p.start, p.stop, p.packets, json.dumps(p.news), p.unread, p.ended))
                if start is None:
                    out.append((path, size, at, upto, None, None, 0, "[]", 0, False))
                f.close()
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in SURVEY.split(", ")])
            yield frame.astype({"start": "Int64", "stop": "Int64"})
    return survey


def _assemble(chunk_packets: int):
    """The surveyed ranges of one file (a row for each ``chunk_packets`` packets
    or range, not for a packet) to its chunks, and to rows with a reason for
    what is not read. A range whose guess is not where the records before it
    end is walked again here."""
    def assemble(rows: pd.DataFrame) -> pd.DataFrame:
        out, seq, unread = [], 0, 0
        path, size = str(rows["path"].iloc[0]), int(rows["size"].iloc[0])
        f, at, about = _open(path)
        if about["format"] == "pcapng":
            about["order"] = "<" if f.read(8, 4) == b"\x4d\x3c\x2b\x1a" else ">"
        ended = False
        # plain rows, as most files have a few: frames of frames cost more than the walk
        names = ["at", "upto", "start", "stop", "packets", "news", "unread", "ended"]
        found = sorted(zip(*[(rows[c].fillna(-1) if c in ("start", "stop") else rows[c]).tolist() for c in names]), key=itemgetter(0, 2))
        for (_, upto), own in groupby(found, key=itemgetter(0, 1)):
            if ended or at >= upto:
                continue
            own = list(own)
            if own[0][2] == at:
                pieces = [_Piece(int(r[2]), int(r[3]), int(r[4]), json.loads(r[5]), int(r[6]), bool(r[7])) for r in own]
            else:
                pieces = _hop(f, at, int(upto), about, chunk_packets)
            for p in pieces:
                if p.packets:
                    out.append((path, p.start, p.stop, seq, p.packets, json.dumps(about), None, None))
                seq, unread, about, at, ended = seq + p.packets, unread + p.unread, _after(about, p.news), p.stop, p.ended
        f.close()
        if at < size:
            out.append((path, None, None, None, 0, None, at, "cut off or corrupt from here on"))
        if unread:
            out.append((path, None, None, None, 0, None, 0, f"{unread} packet blocks of a kind that is not read"))
        columns = zip([c.split() for c in INDEX.split(", ")], zip(*out) if out else [()] * (INDEX.count(",") + 1))
        return pd.DataFrame({n: pd.array(v, dtype="Int64" if t == "bigint" else object) for (n, t), v in columns})
    return assemble


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    wanted = F.lower(F.substring_index("path", ".", -1)).isin(*EXTENSIONS)
    return files.filter(wanted).select("path", F.col("length").alias("size"))


def _tasks(spark: SparkSession) -> int:
    """Tasks for rows that are few but much work: a stated number, since the
    planner would merge partitions of so few bytes into one."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _indexed(spark: SparkSession, path: str, chunk_packets: int, chunk_bytes: int) -> DataFrame:
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0).cast("long")), F.lit(chunk_bytes).cast("long"))
    ranges = _files(spark, path).select("path", "size", F.explode(starts).alias("at"))
    ranges = ranges.withColumn("upto", F.least("size", F.col("at") + chunk_bytes))
    surveyed = ranges.repartition(_tasks(spark), "path", "at").mapInPandas(_survey(chunk_packets), SURVEY)
    return surveyed.repartition(_tasks(spark), "path").groupBy("path").applyInPandas(_assemble(chunk_packets), INDEX)


def _unknown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for path in batch["path"]:
            opened = _open(path)
            if opened is None:
                out.append((path, 0, "unknown format"))
            else:
                opened[0].close()
        yield pd.DataFrame(out, columns=["path", "at", "reason"])


def capture_rejects(spark: SparkSession, path: str, chunk_packets: int = 50_000, chunk_bytes: int = 64 << 20) -> DataFrame:
    """(path, at, reason): capture files below a folder that are not read, or
    not to their end. One pass over the record headers, in ranges of
    ``chunk_bytes``."""
    files = _files(spark, path).select("path").repartition(_tasks(spark), "path")
    unknown = files.mapInPandas(_unknown, "path string, at bigint, reason string")
    return unknown.unionByName(
        _indexed(spark, path, chunk_packets, chunk_bytes).filter("reason IS NOT NULL").select("path", "at", "reason"))


def _be(buf: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Big-endian unsigned numbers of n bytes at the given places."""
    out = np.zeros(len(at), dtype=np.int64)
    for i in range(n):
        out = (out << 8) | buf[at + i]
    return out


@lru_cache(1 << 16)
def _address(raw: bytes) -> str:
    return str(ipaddress.ip_address(raw))


def _ip_text(buf: np.ndarray, at: np.ndarray, mask: np.ndarray, size: int, out: np.ndarray) -> None:
    """Write address texts where the mask is set; each distinct one is formatted once."""
    if not mask.any():
        return
    raw = np.ascontiguousarray(buf[at[mask][:, None] + np.arange(size)])
    values, back = np.unique(raw.view(np.dtype((np.void, size))).reshape(-1), return_inverse=True)
    texts = np.array([_address(v.tobytes()) for v in values], dtype=object)
    out[mask] = texts[back.reshape(-1)]


def dissect(buf: np.ndarray, at: np.ndarray, length: np.ndarray, link: np.ndarray) -> dict[str, np.ndarray]:
    """Header fields of packets that lie in one buffer, all at once.

    IPv4 and IPv6 behind Ethernet (with VLAN tags), Linux cooked, null or raw
    links; TCP, UDP and ICMP in the first fragment; IPv6 extension headers and
    tunnelled IP are followed to the ports inside.
    """
    n = len(at)
    end = at + length
    buf = np.concatenate([buf, np.zeros(HEADER_BYTES, dtype=np.uint8)])
    top = len(buf) - 64

    def within(pos: np.ndarray, size: int) -> np.ndarray:
        return pos + size <= end

    def safe(pos: np.ndarray) -> np.ndarray:
        return np.minimum(pos, top)

    pos, kind = at.copy(), np.zeros(n, dtype=np.int64)
    ether = (link == LINK_ETHERNET) & within(at, 14)
    kind[ether], pos[ether] = _be(buf, safe(at + 12), 2)[ether], (at + 14)[ether]
    cooked = (link == LINK_SLL) & within(at, 16)
    kind[cooked], pos[cooked] = _be(buf, safe(at + 14), 2)[cooked], (at + 16)[cooked]
    for _ in range(2):
        tagged = np.isin(kind, ETHER_VLAN) & within(pos, 4)
        kind[tagged], pos[tagged] = _be(buf, safe(pos + 2), 2)[tagged], (pos + 4)[tagged]
    bare = np.isin(link, RAW_LINKS) | (link == LINK_NULL)
    pos[link == LINK_NULL] += 4
    version = buf[safe(pos)] >> 4
    kind[bare & (version == 4)], kind[bare & (version == 6)] = ETHER_IPV4, ETHER_IPV6

    v4 = (kind == ETHER_IPV4) & within(pos, 20)
    v6 = (kind == ETHER_IPV6) & within(pos, 40)
    src, dst = np.full(n, None, dtype=object), np.full(n, None, dtype=object)
    _ip_text(buf, safe(pos + 12), v4, 4, src)
    _ip_text(buf, safe(pos + 16), v4, 4, dst)
    _ip_text(buf, safe(pos + 8), v6, 16, src)
    _ip_text(buf, safe(pos + 24), v6, 16, dst)
    number, ttl = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    number[v4], ttl[v4] = buf[safe(pos + 9)][v4], buf[safe(pos + 8)][v4]
    number[v6], ttl[v6] = buf[safe(pos + 6)][v6], buf[safe(pos + 7)][v6]
    name = np.full(n, "UNKNOWN", dtype=object)
    name[kind == ETHER_ARP], name[v4], name[v6] = "ARP", "IP", "IPv6"

    # follow to the transport header, through extensions and tunnels
    is4, is6, proto = v4.copy(), v6.copy(), np.full(n, -1, dtype=np.int64)
    for _ in range(3):
        ihl = (buf[safe(pos)] & 15).astype(np.int64) * 4
        later = (_be(buf, safe(pos + 6), 2) & 0x1FFF) != 0
        proto[is4], proto[is6] = buf[safe(pos + 9)][is4], buf[safe(pos + 6)][is6]
        proto[is4 & later] = -1
        pos = np.where(is4, pos + ihl, np.where(is6, pos + 40, pos))
        hops = is6.copy()
        for _ in range(6):
            ext = hops & np.isin(proto, IPV6_EXTENSIONS) & within(pos, 8)
            frag = hops & (proto == 44) & within(pos, 8)
            if not (ext | frag).any():
                break
            following = buf[safe(pos)].astype(np.int64)
            cut = frag & ((_be(buf, safe(pos + 2), 2) >> 3) != 0)
            size = np.where(ext, (buf[safe(pos + 1)].astype(np.int64) + 1) * 8, 8)
            proto = np.where(ext | frag, following, proto)
            proto[cut] = -1
            pos = np.where(ext | frag, pos + size, pos)
        inner4 = (is4 | is6) & (proto == PROTO_IPIP) & within(pos, 20)
        inner6 = (is4 | is6) & (proto == PROTO_IPV6) & within(pos, 40)
        if not (inner4 | inner6).any():
            break
        is4, is6 = inner4, inner6

    tcp = (proto == PROTO_TCP) & within(pos, 14)
    udp = (proto == PROTO_UDP) & within(pos, 4)
    icmp = (proto == PROTO_ICMP) & v4
    name[tcp], name[udp], name[icmp] = "TCP", "UDP", "ICMP"
    ported = tcp | udp
    sport = pd.array(np.where(ported, _be(buf, safe(pos), 2), 0), dtype="Int32")
    dport = pd.array(np.where(ported, _be(buf, safe(pos + 2), 2), 0), dtype="Int32")
    sport[~ported], dport[~ported] = pd.NA, pd.NA
    flags = np.where(tcp, buf[safe(pos + 13)], 0).astype(np.int64)
    return {"source_ip": src, "destination_ip": dst, "source_port": sport, "destination_port": dport,
            "protocol": name, "protocol_number": number, "ttl": ttl, "tcp_flags": flags}


def _places(f: _File, start: int, stop: int, about: dict) -> tuple[np.ndarray, ...]:
    """(buffer, place, length, time, link) of the packets of a chunk."""
    raw = f.read(start, stop - start)
    buf = np.frombuffer(raw, dtype=np.uint8)
    if about["format"] != "pcap":
        recs = list(_records(f, start, stop, about))
        return (buf, *(np.array(v, dtype=np.int64) for v in (
            [r.data - start for r in recs], [r.length for r in recs], [r.ts_us for r in recs], [r.link for r in recs])))
    heads, at, length = [], 0, struct.Struct(about["order"] + "I").unpack_from
    while at < len(raw):
        heads.append(at)
        at += 16 + length(raw, at + 8)[0]
    head, little = np.array(heads, dtype=np.int64), about["order"] == "<"
    time = _number(buf, head, little) * 1_000_000 + _number(buf, head + 4, little) // about["ticks"]
    return buf, head + 16, _number(buf, head + 8, little), time, np.full(len(head), about["link"], dtype=np.int64)


def _packets(held: list[tuple]) -> pd.DataFrame:
    """The packets of some chunks, dissected as one."""
    paths, firsts, bufs, places, lengths, times, links = zip(*held)
    counts = [len(at) for at in places]
    shifts = np.cumsum([0, *[len(buf) for buf in bufs[:-1]]])
    at, length = np.concatenate([at + shift for at, shift in zip(places, shifts)]), np.concatenate(lengths)
    seq = np.concatenate([first + np.arange(n) for first, n in zip(firsts, counts)])
    fields = dissect(np.concatenate(bufs), at, length, np.concatenate(links))
    return pd.DataFrame({"path": np.repeat(np.array(paths, dtype=object), counts), "seq": seq, **fields,
                         "ts_us": np.concatenate(times), "length": length})


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        held, packets, size = [], 0, 0
        for row in batch.itertuples(index=False):
            f = _File(row.path)
            chunk = _places(f, row.start, row.stop, json.loads(row.about))
            f.close()
            held.append((row.path, row.first_seq, *chunk))
            packets, size = packets + len(chunk[1]), size + len(chunk[0])
            if packets >= PACKETS_AT_ONCE or size >= BYTES_AT_ONCE:
                yield _packets(held)
                held, packets, size = [], 0, 0
        if held:
            yield _packets(held)


_PARSED = ("path string, seq bigint, source_ip string, destination_ip string, source_port int, destination_port int, "
           "protocol string, protocol_number int, ttl int, tcp_flags int, ts_us bigint, length int")


def read_captures(spark: SparkSession, path: str, packet_limit: int | None = None, sensor_id: str = "capture",
                  chunk_packets: int = 50_000, chunk_bytes: int = 64 << 20) -> DataFrame:
    """Packets of all capture files below a folder, one session per file.

    ``packet_limit`` takes the first packets of each file; without it whole
    files are read. Files of other formats are passed over: see
    ``capture_rejects`` for those and for records that are cut off.
    """
    if packet_limit is not None and packet_limit < 1:
        raise ValueError(f"packet_limit is at least 1, not {packet_limit}")
    columns = [c.split()[0] for c in CHUNKS.split(", ")]
    if packet_limit is None:
        chunks = _indexed(spark, path, chunk_packets, chunk_bytes).filter("packets > 0").select(*columns)
    else:
        files = _files(spark, path).select("path").repartition(_tasks(spark), "path")
        chunks = files.mapInPandas(_first_packets(packet_limit, chunk_packets, chunk_bytes), CHUNKS)
    chunks = chunks.repartition(_tasks(spark), "path", "start")
    rows = chunks.mapInPandas(_parse, _PARSED)
    rows = rows.withColumns({
        "sensor_id": F.lit(sensor_id), "session_id": F.col("path"), **net.tcp_flag_columns(F.col("tcp_flags"))})
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PACKETS.fields])


def capture_filter(packets: DataFrame, protocols: tuple[str, ...] = (), ports: tuple[int, ...] = (),
                   hosts: tuple[str, ...] = ()) -> DataFrame:
    """Keep packets of the given protocols, with either port and either host
    among those given. Filter before any running feature: packets left out
    never count in a session or flow."""
    def either(a: str, b: str, values) -> Column:
        return F.coalesce(F.col(a).isin(*values), F.lit(False)) | F.coalesce(F.col(b).isin(*values), F.lit(False))
    if protocols:
        packets = packets.filter(F.lower("protocol").isin(*[p.lower() for p in protocols]))
    if ports:
        packets = packets.filter(either("source_port", "destination_port", ports))
    if hosts:
        packets = packets.filter(either("source_ip", "destination_ip", hosts))
    return packets
