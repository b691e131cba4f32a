"""Databases of networks in the MaxMind DB format: a search tree over address bits and a data section.

The file is read once, where the query is planned, into the range table that
:func:`txstrata.operators.enrich.enrich` joins; it is a lookup resource of some
megabytes, not data that grows with the corpus.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from ipaddress import IPv4Address, IPv6Address

from pyspark.sql import DataFrame, SparkSession

# The mark before the metadata, and the bytes between tree and data.
MARK, GAP = b"\xab\xcd\xefMaxMind.com", 16


class ResourceError(ValueError):
    """A database that is missing, damaged or of another kind."""


@dataclass(frozen=True)
class Resource:
    """What a build states about a database that it used."""

    role: str
    database_type: str
    build_epoch: int
    ip_version: int
    size: int
    sha256: str


class Reader:
    """A database, wholly in memory."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        at = data.rfind(MARK)
        if at < 0:
            raise ResourceError("the file is no MaxMind database")
        try:
            self.metadata = self._value(at + len(MARK), at + len(MARK))[0]
            self.nodes, self.bits, self.version = (self.metadata[k] for k in ("node_count", "record_size", "ip_version"))
        except (IndexError, KeyError, struct.error, UnicodeDecodeError) as e:
            raise ResourceError("the database's metadata is damaged") from e
        if self.bits not in (24, 28, 32) or self.version not in (4, 6):
            raise ResourceError("the database has records or addresses of an unknown size")
        self.base = self.nodes * self.bits // 4 + GAP
        if self.base > at + GAP:
            raise ResourceError("the database is cut short")
        self._seen: dict[int, object] = {}

    def _size(self, control: int, at: int) -> tuple[int, int]:
        n = control & 31
        if n < 29:
            return n, at
        more = n - 28
        return (29, 285, 65821)[more - 1] + int.from_bytes(self.data[at : at + more], "big"), at + more

    def _value(self, at: int, base: int) -> tuple[object, int]:
        """The value at a place and where it ends; pointers count from ``base``."""
        control = self.data[at]
        at += 1
        kind = control >> 5
        if kind == 1:
            wide = control >> 3 & 3
            raw = int.from_bytes(self.data[at : at + wide + 1], "big")
            place = raw if wide == 3 else ((control & 7) << 8 * (wide + 1)) + raw + (0, 2048, 526336)[wide]
            return self._value(base + place, base)[0], at + wide + 1
        if kind == 0:
            kind = self.data[at] + 7
            at += 1
        n, at = self._size(control, at)
        if kind == 7:
            out: dict = {}
            for _ in range(n):
                key, at = self._value(at, base)
                out[key], at = self._value(at, base)
            return out, at
        if kind == 11:
            items = []
            for _ in range(n):
                item, at = self._value(at, base)
                items.append(item)
            return items, at
        if kind == 14:
            return bool(n), at
        raw = self.data[at : at + n]
        if len(raw) != n:
            raise ResourceError("the database is cut short")
        end = at + n
        if kind == 2:
            return raw.decode("utf-8"), end
        if kind in (3, 15):
            return struct.unpack(">d" if kind == 3 else ">f", raw)[0], end
        if kind == 4:
            return raw, end
        if kind == 8:
            return int.from_bytes(raw.rjust(4, b"\0"), "big", signed=True), end
        if kind in (5, 6, 9, 10):
            return int.from_bytes(raw, "big"), end
        raise ResourceError(f"the database holds a value of the unknown kind {kind}")

    def _record(self, node: int, side: int) -> int:
        width = self.bits // 4
        at = node * width
        raw = self.data[at : at + width]
        if self.bits == 28:
            middle = raw[3] >> 4 if side == 0 else raw[3] & 15
            return middle << 24 | int.from_bytes(raw[0:3] if side == 0 else raw[4:7], "big")
        half = width // 2
        return int.from_bytes(raw[:half] if side == 0 else raw[half:], "big")

    def networks(self) -> Iterator[tuple[str, object]]:
        """(network, value) of every network with data, in address order; IPv4 networks of a tree of IPv6 as such."""
        total = 32 if self.version == 4 else 128
        stack = [(0, 0, 0)]
        while stack:
            record, prefix, depth = stack.pop()
            if record < self.nodes:
                if depth == total:
                    raise ResourceError("the database's tree is deeper than an address")
                for side in (1, 0):
                    stack.append((self._record(record, side), prefix | side << (total - 1 - depth), depth + 1))
            elif record > self.nodes:
                place = record - self.nodes - GAP
                if place not in self._seen:
                    self._seen[place] = self._value(self.base + place, self.base)[0]
                if total == 128 and depth >= 96 and prefix >> 32 == 0:
                    yield f"{IPv4Address(prefix)}/{depth - 96}", self._seen[place]
                else:
                    yield f"{IPv4Address(prefix) if total == 32 else IPv6Address(prefix)}/{depth}", self._seen[place]


def open_database(spark: SparkSession, path: str, role: str) -> tuple[Resource, Reader]:
    """A database of the role ``country`` or ``asn``, and what is to be stated about it."""
    found = spark.read.format("binaryFile").load(path).select("content").limit(1).collect()
    if not found or not found[0]["content"]:
        raise ResourceError(f"the {role} database does not exist or is empty: {path}")
    data = bytes(found[0]["content"])
    reader = Reader(data)
    kind = str(reader.metadata.get("database_type", ""))
    if role not in ("country", "asn") or role not in kind.lower():
        raise ResourceError(f"the {role} database is of the type {kind!r}")
    return Resource(role, kind, int(reader.metadata.get("build_epoch", 0)), reader.version, len(data), sha256(data).hexdigest()), reader


def _country(value: object) -> str | None:
    return ((value.get("country") or {}).get("iso_code") or value.get("country_code")) if isinstance(value, dict) else None


def country_ranges(spark: SparkSession, reader: Reader) -> DataFrame:
    """The range table of countries."""
    from ..operators.enrich import range_table

    return range_table(spark, [(n, _country(v), None, None) for n, v in reader.networks()])


def asn_ranges(spark: SparkSession, reader: Reader) -> DataFrame:
    """The range table of system numbers and their holders."""
    from ..operators.enrich import range_table

    get = lambda v, k: v.get(k) if isinstance(v, dict) else None
    return range_table(spark, [(n, None, get(v, "autonomous_system_number"), get(v, "autonomous_system_organization")) for n, v in reader.networks()])


def enrich_from(spark: SparkSession, ips: DataFrame, country: Reader, asn: Reader) -> DataFrame:
    """Each IP with the country of one database and the number and holder of the other, and the network of each."""
    from pyspark.sql import functions as F

    from ..operators.enrich import enrich

    c = enrich(ips, country_ranges(spark, country)).select("ip", "country_code", F.col("network").alias("country_network"), "country_found")
    a = enrich(ips, asn_ranges(spark, asn)).select("ip", "asn", "holder", F.col("network").alias("asn_network"), "asn_found")
    return c.join(a, "ip")
