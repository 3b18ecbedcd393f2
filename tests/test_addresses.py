"""Addresses and networks against the standard library."""

import ipaddress
import random

import pytest
from millrace.functions import addresses
from millrace.operators import filters
from pyspark.sql import functions as F

R = random.Random(4)
EDGES = [
    "127.0.0.1", "127.1", "0x7f.1", "2130706433", "0177.0.0.1", "0", "1.2.3", "1.65536", "256.1.1.1", "1.2.3.256", "1.2.3.4.5", "08.1.1.1", "a.b.c.d", "", "1..2", "4294967295", "4294967296", "0xffffffff", "192.0.2.1", "198.18.0.1", "203.0.113.9",
    "100.64.0.1", "192.0.0.9", "[::1]", "[0:0:0:0:0:0:0:1]", "[64:ff9b::1]", "[::]", "[1:2:3:4:5:6:7::]", "[::2:3:4:5:6:7:8]", "[1::2::3]", "[:::]", "[1:2:3:4:5:6:7:8:9]", "[1:2:3:4:5:6:7]", "[12345::]", "[::ffff:127.0.0.1]", "[::ffff:8.8.8.8]",
    "[fe80::1%eth0]", "[2001:4860::8888]", "[2001:db8::1]", "[2001:1::1]", "[::1.2.3.4]", "[::1.2.3]", "[::01.2.3.4]", "[1:2:3:4:5:6:1.2.3.4]", "[fc00::]", "[FF02::1]", "example.org", "2a00::1",
]


def model(host):
    host = host.strip("[]")
    try:
        return ipaddress.ip_address(host)
    except ValueError:
        pass
    parts = host.split(".")
    try:
        values = [int(p, 16 if p.lower().startswith("0x") else 8 if p.startswith("0") else 10) for p in parts]
    except ValueError:
        return None
    n = len(parts)
    if n > 4 or any(not p or p[0] in "+-" or "_" in p for p in parts) or any(v > 255 for v in values[:-1]) or values[-1] >= 256 ** (5 - n):
        return None
    return ipaddress.ip_address(sum(v << (8 * (3 - i)) for i, v in enumerate(values[:-1])) + values[-1])


def digits(ip):
    return None if ip is None else f"{int(ip) | (0xFFFF << 32 if ip.version == 4 else 0):032x}"


def hosts():
    out = list(EDGES)
    for _ in range(400):
        n = R.choice([R.getrandbits(32), R.choice([10, 127, 169, 172, 192, 198, 203, 224]) << 24 | R.getrandbits(24)])
        ip = ipaddress.IPv4Address(n)
        out += [str(ip), hex(n), str(n), f"[::ffff:{ip}]"]
        six = ipaddress.IPv6Address(R.choice([R.getrandbits(128), R.getrandbits(64), R.choice([0x2001, 0xFE80, 0xFC00, 0x2002, 0x3FFF, 0x0064]) << 112 | R.getrandbits(R.choice([16, 100]))]))
        out += [f"[{six}]", f"[{six.exploded.upper()}]"]
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(list(enumerate(hosts())), "id long, host string").repartition(4)


def test_numbers(table):
    got = {r.host: r.n for r in table.select("host", addresses.number("host").alias("n")).collect()}
    assert {h: n for h, n in got.items() if n != digits(model(h))} == {}


def test_internal(table):
    def internal(host):
        ip = model(host)
        ip = ip.ipv4_mapped or ip if ip is not None and ip.version == 6 else ip
        return host == "" or ip is not None and (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified)

    got = table.where("host not like '%]_%'").select("host", filters.internal_url(F.concat(F.lit("https://"), "host", F.lit("/a"))).alias("x")).collect()
    names = {"2a00::1"}  # without brackets the rest is a port
    newer = ipaddress.ip_network("3fff::/20")  # not in all versions of the library
    other = lambda h: h in names or (ip := model(h)) is not None and ip.version == 6 and ip in newer
    assert [(r.host, r.x) for r in got if not other(r.host) and r.x != internal(r.host)] == []
    assert sum(r.x for r in got) > 300


def test_longest_networks(spark, table):
    nets = []
    for _ in range(300):
        if R.random() < 0.5:
            nets.append(ipaddress.ip_network((R.choice([10, 127, 192, 198, R.randrange(256)]) << 24 | R.getrandbits(24), R.randrange(0, 33)), strict=False))
        else:
            nets.append(ipaddress.ip_network((R.choice([0x2001, 0xFE80, 0xFC00]) << 112 | R.getrandbits(100), R.randrange(0, 40)), strict=False))
    nets.append(ipaddress.ip_network("::ffff:0:0/100"))
    rows = [(str(n),) for n in nets] + [("nonsense",), (None,), ("10.0.0.0",), ("10.0.0.0/99",)]
    got = {r.id: r.network for r in addresses.matched(table, "host", spark.createDataFrame(rows, "network string"), "id").collect()}
    ranges = sorted((-length, str(n), a, b) for n in set(nets) for a, b, length in [addresses.bounds(str(n))])
    want = {}
    for k, h in enumerate(hosts_of(table)):
        x = digits(model(h))
        best = next((n for _, n, a, b in ranges if x and a <= x <= b), None)
        if best:
            want[k] = best
    assert got == want and len(want) > 500


def hosts_of(table):
    return [r.host for r in table.orderBy("id").collect()]
