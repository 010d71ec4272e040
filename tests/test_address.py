"""The address guard in expressions against the library's reading, on both sides of each bound."""

import ipaddress
import random

from pyspark.sql import functions as F

from pagewarden.functions import address


def read(spark, hosts):
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    return {r["host"]: (r["a"], r["p"]) for r in df.select("host", address.hex_address(F.col("host")).alias("a"), address.public_host(F.col("host")).alias("p")).collect()}


def test_both_sides_of_each_bound(spark):
    nets = [ipaddress.ip_network(n) for n in (*address.V4, *address.V6)]
    cases = {}
    for n in nets:
        for x in (int(n[0]) - 1, int(n[0]), int(n[-1]), int(n[-1]) + 1):
            if 0 <= x < 1 << n.max_prefixlen:
                ip = type(n[0])(x)
                cases[str(ip) if ip.version == 4 else f"[{ip}]"] = any(ip in m for m in nets if m.version == ip.version)
                if ip.version == 4:
                    cases[f"[::ffff:{ip}]"] = cases[str(ip)]
    got = read(spark, list(cases))
    assert {h: not p for h, (_, p) in got.items()} == cases and len(cases) > 60


def test_addresses_equal_the_library(spark):
    r = random.Random(1)
    six = [ipaddress.IPv6Address(r.getrandbits(128) & r.choice([(1 << 128) - 1, 0xFFFF << 64 | 0xFF, 0xFFFF0000FFFF << 32])) for _ in range(150)]
    hosts = {f"[{x}]": f"{int(x):032x}" for x in six} | {x.exploded: f"{int(x):032x}" for x in six}
    for _ in range(150):
        x = r.getrandbits(32)
        a, b, c, d = x.to_bytes(4, "big")
        hosts |= {h: f"{x + (0xFFFF << 32):032x}" for h in (f"{a}.{b}.{c}.{d}", f"{x}", hex(x), f"0{x:o}", f"{a}.{x & 0xFFFFFF}", f"{a}.{b}.{x & 0xFFFF}", f"0X{a:x}.{b}.0{c:o}.{d}.")}
        hosts[f"[64:ff9b::{a}.{b}.{c}.{d}]"] = f"{int(ipaddress.IPv6Address(f'64:ff9b::{a}.{b}.{c}.{d}')):032x}"
    got = read(spark, list(hosts))
    assert {h: a for h, (a, _) in got.items()} == hosts


def test_names_and_what_is_no_address(spark):
    fine = ["example.com", "EXAMPLE.com.", "8.8.8.8", "1.example", "0x7f.example", "локал.рф"]
    bad = ["localhost", "LOCALHOST.", "a.localhost", "x.local", "metadata.google.internal", "y.internal", "127.1", "2130706433", "0x7f000001", "017700000001", "256.1.1.1", "1.2.3.4.5", "08.1.1.1", "4294967296", "[::1]", "[::]", "[1::2::3]", "[12345::]", "[1:2:3]", "[::ffff:10.0.0.1]", "[fe80::1%25eth0]", ""]
    got = read(spark, fine + bad)
    assert [h for h in fine if not got[h][1]] == [] and [h for h in bad if got[h][1]] == []
    df = spark.createDataFrame([(None,)], "host string")
    assert df.select(F.coalesce(address.public_host(F.col("host")), F.lit(False))).first()[0] is False


def test_the_table_is_in_order():
    table = address.intervals()
    assert table == sorted(table) and all(a <= b for a, b in table) and all(x[1] < y[0] for x, y in zip(table, table[1:]))
