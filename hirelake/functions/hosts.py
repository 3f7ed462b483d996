"""Hosts in urls: which of them are addresses of the public network."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IPv4 ranges that aren't global, as first address and bits of the prefix.
NOT_GLOBAL = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24),
    ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)
#: Names that stay in the local network.
LOCAL_NAMES = r"^(localhost|.*[.](localhost|local|internal))[.]?$"


def ranges() -> list[tuple[int, int]]:
    """NOT_GLOBAL as first and last numbers."""
    out = []
    for first, bits in NOT_GLOBAL:
        a, b, c, d = map(int, first.split("."))
        low = ((a * 256 + b) * 256 + c) * 256 + d
        out.append((low, low + (1 << (32 - bits)) - 1))
    return out


def _digits(text: Column, base: int) -> Column:
    return F.conv(text, base, 10).cast("long")


def ipv4_number(host: Column) -> Column:
    """The number of an IPv4 address in any of its forms, else null: up to four parts, decimal, octal (0...) or hexadecimal
    (0x...), of which the last fills the bytes that are left."""
    parts = F.split(F.regexp_replace(host, "[.]$", ""), "[.]")

    def value(p: Column) -> Column:
        n = F.when(p.rlike("^0x[0-9a-f]{0,12}$"), F.when(p == "0x", 0).otherwise(_digits(F.substring(p, 3, 12), 16)))
        return n.when(p.rlike("^0[0-7]{1,14}$"), _digits(p, 8)).when(p.rlike("^(0|[1-9][0-9]{0,11})$"), p.cast("long"))

    def number(v: Column) -> Column:
        n = F.size(v)
        fits = (n <= 4) & ~F.exists(v, lambda x: x.isNull()) & (F.element_at(v, -1) < F.pow(F.lit(256), 5 - n)) & ~F.exists(F.slice(v, 1, n - 1), lambda x: x > 255)
        high = F.aggregate(F.slice(v, 1, n - 1), F.lit(0).cast("long"), lambda a, x: a * 256 + x)
        return F.when(fits, high * F.pow(F.lit(256), 5 - n).cast("long") + F.element_at(v, -1))

    return F.get(F.transform(F.array(F.transform(parts, value)), number), F.lit(0))


def public_host(host: Column) -> Column:
    """Whether a lower-cased host is a name with a dot that isn't local, or a global IPv4 address; IPv6 literals are not."""
    n = ipv4_number(host)
    inside = F.lit(False)
    for low, high in ranges():
        inside = inside | n.between(low, high)
    return F.coalesce(F.when(n.isNotNull(), ~inside).otherwise(host.contains(".") & ~host.startswith("[") & ~host.rlike(LOCAL_NAMES)), F.lit(False))
