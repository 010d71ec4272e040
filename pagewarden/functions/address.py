"""Which hosts may be fetched, in expressions: names and address literals against a table of disjoint intervals.

An address is 32 hexadecimal digits, IPv4 as its IPv6-mapped form, so both kinds are one order of text and
one table. The table is searched by halves, a comparison a level. IPv4 literals are read as URLs have them: one to
four numbers, decimal, octal or hexadecimal, the last of which fills what is left."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

# Networks that are never fetched, and names.
V4 = "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.2.0/24 192.168.0.0/16 198.51.100.0/24 203.0.113.0/24 224.0.0.0/3".split()
V6 = "::/128 ::1/128 fc00::/7 fe80::/10 fec0::/10 ff00::/8 2001:db8::/32".split()
NAMES, ENDINGS = ("localhost", "metadata.google.internal"), (".localhost", ".local", ".internal")
_MAPPED = 0xFFFF << 32


def intervals() -> list[tuple[str, str]]:
    """First and last address of each restricted stretch, in order; stretches that touch are one."""
    nets = [(int(n[0]) + _MAPPED, int(n[-1]) + _MAPPED) for n in map(ipaddress.ip_network, V4)] + [(int(n[0]), int(n[-1])) for n in map(ipaddress.ip_network, V6)]
    out: list[list[int]] = []
    for low, high in sorted(nets):
        if out and low <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(f"{a:032x}", f"{b:032x}") for a, b in out]


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often use needs it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def restricted(address: Column, table: list[tuple[str, str]] | None = None) -> Column:
    """Whether an address of 32 digits lies in a restricted stretch."""
    table = intervals() if table is None else table

    def search(x: Column, part: list[tuple[str, str]]) -> Column:
        if len(part) == 1:
            return x.between(*part[0])
        half = len(part) // 2
        return F.when(x < F.lit(part[half][0]), search(x, part[:half])).otherwise(search(x, part[half:]))

    return _let(address, lambda x: search(x, table))


def _number(part: Column) -> Column:
    """An unsigned number of a URL's IPv4 literal; null if it is none or over 32 bits."""
    hexadecimal, octal = part.rlike("^0[xX][0-9a-fA-F]*$"), part.rlike("^0[0-7]+$")
    digits = F.when(hexadecimal, F.ltrim(F.substring(part, 3, 1000), F.lit("0"))).when(part.rlike("^[0-9]+$"), F.ltrim(part, F.lit("0")))
    base = F.when(hexadecimal, 16).when(octal, 8).when(~part.rlike("^0[0-9]+$"), 10)
    value = F.when(base == 16, F.conv(digits, 16, 10)).when(base == 8, F.conv(digits, 8, 10)).when(base == 10, digits)
    return F.when(F.length(digits) == 0, F.lit(0)).when(F.length(digits) <= 12, value.try_cast("bigint"))


def _v4(host: Column) -> Column:
    """The address of a literal of numbers; null if it isn't one."""

    def of(values: Column) -> Column:
        n, last = F.size(values), F.element_at(values, -1)
        before = F.slice(values, 1, n - 1)
        room = F.element_at(F.array(*[F.lit(256 ** (5 - i)) for i in range(1, 5)]), F.least(n, F.lit(4)))
        good = (n <= 4) & F.forall(values, lambda v: v.isNotNull()) & F.forall(before, lambda v: v < 256) & (last < room)
        whole = F.aggregate(before, F.lit(0).cast("bigint"), lambda sum_, v: sum_ * 256 + v) * room + last
        return F.when(good, F.concat(F.lit(f"{_MAPPED:032x}"[:24]), F.lpad(F.lower(F.hex(whole)), 8, "0")))

    return _let(F.transform(F.split(F.regexp_replace(host, "[.]$", ""), "[.]"), _number), of)


def _v6(host: Column) -> Column:
    """The address of a literal of groups, in brackets or bare; null if it isn't one."""

    def written(bare: Column) -> Column:
        """bare with an IPv4 tail as two groups."""
        tail = F.regexp_extract(bare, r":([0-9]{1,3}(?:[.][0-9]{1,3}){3})$", 1)
        return _let(F.substring(_v4(tail), 25, 8), lambda four: F.when(bare.contains("."), F.concat(F.regexp_replace(bare, "[0-9.]+$", ""), F.substring(four, 1, 4), F.lit(":"), F.substring(four, 5, 4))).otherwise(bare))

    def of(groups: Column) -> Column:
        cut = lambda x: F.filter(F.split(F.coalesce(x, F.lit("")), ":"), lambda g: g != "")
        halves = F.split(groups, "::")
        parts = F.struct(F.size(halves).alias("n"), cut(F.get(halves, F.lit(0))).alias("left"), cut(F.get(halves, F.lit(1))).alias("right"))
        return _let(parts, lambda p: joined(groups, p))

    def joined(groups: Column, p: Column) -> Column:
        zeros = F.lit(8) - F.size(p["left"]) - F.size(p["right"])
        fits = groups.rlike("^[0-9a-f:]+$") & groups.contains(":") & ~groups.rlike(":::|[0-9a-f]{5}|^:[^:]|[^:]:$") & F.when(p["n"] == 2, zeros >= 1).otherwise((p["n"] == 1) & (zeros == 0))
        every = F.concat(p["left"], F.array_repeat(F.lit("0"), F.greatest(zeros, F.lit(0))), p["right"])
        return F.when(F.coalesce(fits, F.lit(False)), F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))

    return _let(_let(F.lower(F.regexp_replace(host, r"^\[|\]$", "")), written), of)


def hex_address(host: Column) -> Column:
    """The 32 digits of the address that a host is; null for names and what can't be read."""
    return _let(host, lambda h: F.when(h.contains(":"), _v6(h)).otherwise(_v4(h)))


def public_host(host: Column) -> Column:
    """Whether a host may be fetched: no restricted address, no local name, no literal that can't be read."""

    def name(bare: Column) -> Column:
        local = bare.isin(*NAMES) | F.greatest(*[bare.endswith(e) for e in ENDINGS])
        # what ends in a number is an address or nothing
        literal = bare.rlike(r"(^|[.])([0-9]+|0x[0-9a-f]*)$") | bare.contains(":")
        return F.when(bare.isNull() | (bare == "") | local, False).otherwise(F.when(literal, _let(hex_address(bare), lambda a: F.coalesce(~restricted(a), F.lit(False)))).otherwise(True))

    return _let(F.lower(F.regexp_replace(host, "[.]$", "")), name)
