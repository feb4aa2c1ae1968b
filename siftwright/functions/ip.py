"""IPv4 addresses as numbers, and the ranges that aren't public."""

from __future__ import annotations

import ipaddress
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# IPv4 ranges that aren't globally reachable (IANA's special-purpose registry), and the exceptions in them.
NOT_GLOBAL = "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 240.0.0.0/4".split()
GLOBAL_AFTER_ALL = "192.0.0.9/32 192.0.0.10/32".split()


def ipv4_number(ip: Column) -> Column:
    """The number of a dotted address; null where it is none."""
    ok = ip.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$")
    parts = F.split(ip, r"\.")
    value = reduce(lambda a, i: a * 256 + F.get(parts, F.lit(i)).try_cast("long"), range(1, 4), F.get(parts, F.lit(0)).try_cast("long"))
    return F.when(ok, value)


def _within(n: Column, ranges: list[str]) -> Column:
    nets = [ipaddress.ip_network(r) for r in ranges]
    return reduce(lambda a, b: a | b, [n.between(int(x.network_address), int(x.broadcast_address)) for x in nets])


def ipv4_is_private(ip: Column) -> Column:
    """Whether a dotted address isn't globally reachable; null where it is no address."""
    n = ipv4_number(ip)
    return F.when(n.isNotNull(), _within(n, NOT_GLOBAL) & ~_within(n, GLOBAL_AFTER_ALL))


@F.pandas_udf(T.BooleanType())
def ip_is_private(ip: pd.Series) -> pd.Series:
    """The same for addresses of both versions."""

    def one(x: str | None):
        try:
            return not ipaddress.ip_address(x).is_global
        except ValueError:
            return None

    return ip.map(one).astype("boolean")


def ip_type(value: Column) -> Column:
    return F.when(ipv4_number(value).isNotNull(), "ipv4").when(value.rlike(r"(?i)^[0-9a-f:.]*:[0-9a-f:.]*:[0-9a-f:.]*$"), "ipv6")
