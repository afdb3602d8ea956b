"""Addresses, networks, ports and domain patterns.

Most addresses are IPv4 and become integers in generated code.  IPv6 needs a parser: an Arrow
UDF turns each address into 16 bytes (IPv4 is mapped), whose order is that of the addresses, so
containment is a comparison for both.
"""

from __future__ import annotations

import ipaddress
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.text import is_blank, number, strip

_V4 = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"
_NOT_GLOBAL = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4")
_GLOBAL_AGAIN = ("192.0.0.9/32", "192.0.0.10/32")
_NOT_GLOBAL6 = ("::/127", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20", "fc00::/7", "fe80::/10", "ff00::/8")


def ipv4(c: Column) -> Column:
    """The address as an integer, or null."""
    text = strip(c)
    part = F.split(F.when(text.rlike(_V4), text), r"\.")
    return sum((part[k].cast("bigint") * (1 << (24 - 8 * k)) for k in range(1, 4)), part[0].cast("bigint") * (1 << 24))


@F.pandas_udf(T.BinaryType())
def ip_bytes(text: pd.Series) -> pd.Series:
    """16 bytes of an IPv6 address, or of a mapped IPv4 one; null for other text."""

    def one(t: str | None) -> bytes | None:
        try:
            a = ipaddress.ip_address(t.strip()) if t else None
        except ValueError:
            return None
        return None if a is None else a.packed if a.version == 6 else b"\0" * 10 + b"\xff\xff" + a.packed

    known: dict[str | None, bytes | None] = {}
    return pd.Series([known[t] if t in known else known.setdefault(t, one(t)) for t in text])


def in_networks(c: Column, networks: list[str], number: Column | None = None) -> Column:
    """Whether the address lies in one of the networks; false for null or other text.  IPv6 is parsed only if a network asks for it.

    ``number``, if given, is a column with ``ipv4`` of the address, so that it isn't parsed again for each test.
    """
    nets = [ipaddress.ip_network(n, strict=False) for n in networks]
    four = [n for n in nets if n.version == 4]
    out = F.lit(False)
    if four and number is not None:
        out = reduce(Column.__or__, [number.between(int(n[0]), int(n[-1])) for n in four])
    elif four:  # the number is bound once, not written out for every network
        out = F.exists(F.array(ipv4(c)), lambda x: reduce(Column.__or__, [x.between(int(n[0]), int(n[-1])) for n in four]))
    if any(n.version == 6 for n in nets):
        packed = ip_bytes(c)
        for n in nets:
            if n.version == 6:
                out = F.coalesce(out, F.lit(False)) | packed.between(F.lit(bytearray(n[0].packed)), F.lit(bytearray(n[-1].packed)))
    return F.coalesce(out, F.lit(False))


def join_networks(df: DataFrame, address: str, networks: DataFrame, cidr: str = "cidr") -> DataFrame:
    """Rows with the IPv4 networks of a table that their address lies in, one row for each.

    A network is the leading bits of its addresses, so for each prefix length that the table has (33 at most) a row looks
    up one number: an equi-join, whatever the number of networks.
    """
    size = F.split(F.col(cidr), "/")[1].try_cast("int")
    base = ipv4(F.split(F.col(cidr), "/")[0])
    wide = networks.select("*", F.coalesce(size, F.lit(32)).alias("__len"), base.alias("__start")).where("__start is not null and __len between 0 and 32")

    def cut(n: Column, k: Column) -> Column:
        return F.floor(n / F.pow(F.lit(2.0), F.lit(32) - k)).cast("bigint")

    wide = wide.withColumn("__start", cut(F.col("__start"), F.col("__len")))
    lengths = sorted(r[0] for r in wide.select("__len").distinct().collect())  # 33 at most
    number = F.explode(F.array(ipv4(F.col(f"`{address}`"))))
    own = df.select("*", number.alias("__ip"))
    probes = F.array(*(F.struct(F.lit(k).alias("__len"), cut(F.col("__ip"), F.lit(k)).alias("__start")) for k in lengths)) if lengths else F.array().cast("array<struct<__len:int,__start:bigint>>")
    return own.select("*", F.inline(probes)).join(wide, ["__len", "__start"]).drop("__len", "__start", "__ip")


def same_address(c: Column, addresses: list[str], number: Column | None = None) -> Column:
    return in_networks(c, list(addresses), number)


def is_external(c: Column, v6: bool = False) -> Column:
    """A public address: not private, loopback, link-local, multicast or unspecified."""
    n = ipv4(c)
    out = n.isNotNull() & (~in_networks(c, list(_NOT_GLOBAL)) | in_networks(c, list(_GLOBAL_AGAIN)))
    if v6:
        out = out | (n.isNull() & ip_bytes(c).isNotNull() & ~in_networks(c, list(_NOT_GLOBAL6)))
    return F.coalesce(out, F.lit(False))


def is_external_number(n: Column) -> Column:
    """The same of an IPv4 address as an integer; false for null."""

    def within(networks: tuple[str, ...]) -> Column:
        return reduce(Column.__or__, [n.between(int(x[0]), int(x[-1])) for x in map(ipaddress.ip_network, networks)])

    return F.coalesce(~within(_NOT_GLOBAL) | within(_GLOBAL_AGAIN), F.lit(False))


def is_address(c: Column, v6: bool = True, number: Column | None = None) -> Column:
    four = (ipv4(c) if number is None else number).isNotNull()
    return four | ip_bytes(c).isNotNull() if v6 else four


@F.pandas_udf(T.StringType())
def network_zone(text: pd.Series) -> pd.Series:
    """The /24 or /64 network of an address, an address with a port, an interface or a URL's host; null for other text."""
    from urllib.parse import urlsplit

    def address(t: str):
        for form in (t, t.split("/")[0] if "/" in t and "://" not in t else "", t[1 : t.find("]")] if t.startswith("[") and "]" in t else "", t.rsplit(":", 1)[0] if t.count(":") == 1 and t.rsplit(":", 1)[1].isdigit() else ""):
            try:
                return ipaddress.ip_address(form)
            except ValueError:
                continue
        if "://" in t:
            try:
                return ipaddress.ip_address(urlsplit(t).hostname or "")
            except ValueError:
                pass
        return None

    def one(t: str | None) -> str | None:
        a = address(t.strip()) if t else None
        return None if a is None else ipaddress.ip_network(f"{a}/{24 if a.version == 4 else 64}", strict=False).with_prefixlen

    known: dict[str | None, str | None] = {}
    return pd.Series([known[t] if t in known else known.setdefault(t, one(t)) for t in text], dtype=object)


def port(c: Column) -> Column:
    """A port number from "443" or "443.0"; null out of 0 to 65535."""
    n = number(c)
    return F.when((n == F.floor(n)) & n.between(0, 65535), n.cast("int"))


def in_ports(c: Column, ports: list[str | int]) -> Column:
    """Whether the port is one of the numbers or in one of the ranges "a-b"; false for null."""
    p, out = port(c), F.lit(False)
    for x in ports:
        low, _, high = str(x).partition("-")
        out = out | p.between(int(low), int(high or low))
    return F.coalesce(out, F.lit(False))


def matches_domain(c: Column, patterns: list[str]) -> Column:
    """The name itself, or for ``*.suffix`` a name below the suffix; case and a dot at the end don't count."""
    name = F.rtrim(F.lower(strip(c)), F.lit("."))
    out = F.lit(False)
    for p in patterns:
        p = p.strip().rstrip(".").lower()
        out = out | (name.endswith(p[1:]) & (name != p[1:]) if p.startswith("*.") else name == p)
    return ~is_blank(c) & F.coalesce(out, F.lit(False))
