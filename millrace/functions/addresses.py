"""Internet addresses as 128-bit numbers, and look-ups in tables of networks.

A number is 32 hexadecimal digits, so that numbers compare like their texts. An IPv4 address has the number of its mapped IPv6 address (``::ffff:0:0/96``). All
text forms that address look-ups of operating systems take are read: dotted ones of one to four parts, each decimal, octal (0...) or hexadecimal (0x...), and IPv6 groups with one ``::``,
an IPv4 tail and a zone. Everything else is a name and has no number.

Of networks that hold an address the longest prefix wins. ``verdict`` looks a fixed list up in an expression; ``matched`` takes a table of any size: an address has one
prefix for each length that occurs (129 at most), and these meet the networks in an equi-join, so the work goes with addresses and networks, not with their product.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text as X

PART = "^(0[xX][0-9a-fA-F]{1,8}|0[0-7]{0,11}|[1-9][0-9]{0,9})$"
MAPPED = "00000000000000000000ffff"


def _part(p: Column) -> Column:
    hexed = F.conv(F.substr(p, F.lit(3)), 16, 10)
    return F.when(F.regexp_like(p, F.lit("^0[xX]")), hexed).when(F.startswith(p, F.lit("0")), F.conv(p, 8, 10)).otherwise(p).cast("long")


def _let(x: Column, f) -> Column:
    """``f`` of ``x``, which is computed once however often ``f`` uses it."""
    return F.transform(F.array(x), f)[0]


def _v4(host: Column) -> Column:
    """The 32-bit number of a dotted address, or null."""

    def of_values(values: Column) -> Column:
        head, last, rest = F.slice(values, F.lit(1), F.size(values) - 1), F.element_at(values, -1), F.pow(F.lit(256.0), (F.lit(5) - F.size(values)).cast("double")).cast("long")
        fits = F.forall(head, lambda v: v < 256) & (last < rest)
        return F.when(fits, F.aggregate(head, F.lit(0).cast("long"), lambda s, v: s * 256 + v) * rest + last)

    def of_parts(parts: Column) -> Column:
        fits = (F.size(parts) <= 4) & F.forall(parts, lambda p: F.regexp_like(p, F.lit(PART)))
        return F.when(fits, _let(F.transform(parts, _part), of_values))

    return _let(F.split(host, r"\."), of_parts)


def _groups(half: Column) -> Column:
    return F.filter(F.split(half, ":"), lambda g: g != "")


def _v6(host: Column) -> Column:
    """The 32 digits of an IPv6 address without brackets, or null."""

    def with_tail(text: Column) -> Column:
        tail = F.regexp_extract(text, r":((?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3})$", 1)
        digits = _let(tail, lambda t: F.when(t != "", F.lpad(F.lower(F.hex(_v4(t))), 8, "0")))
        head = F.regexp_replace(text, r"[0-9.]+$", "")
        return F.when(F.contains(text, F.lit(".")), _let(digits, lambda d: F.concat(head, F.left(d, F.lit(4)), F.lit(":"), F.right(d, F.lit(4))))).otherwise(text)

    def of_halves(halves: Column) -> Column:
        both = F.struct(_groups(halves[0]).alias("a"), _groups(F.coalesce(F.try_element_at(halves, F.lit(2)), F.lit(""))).alias("b"))
        return F.when(F.size(halves) <= 2, _let(both, lambda x: of_groups(x["a"], x["b"], F.size(halves) == 2)))

    def of_groups(a: Column, b: Column, gap: Column) -> Column:
        n = 8 - F.size(a) - F.size(b)
        fits = F.when(gap, n >= 1).otherwise(n == 0)
        return F.when(fits, _let(F.concat(a, F.array_repeat(F.lit("0"), F.greatest(n, F.lit(0))), b), joined))

    def joined(groups: Column) -> Column:
        fits = F.forall(groups, lambda g: F.regexp_like(g, F.lit("^[0-9a-f]{1,4}$")))
        return F.when(fits, F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ""))

    return _let(with_tail(F.regexp_replace(F.lower(host), "%.*$", "")), lambda x: F.when(~F.regexp_like(x, F.lit("(^|[^:]):$|^:[^:]|:::")), _let(F.split(x, "::"), of_halves)))


def number(host: Column | str) -> Column:
    """The 32 digits of a literal address (IPv6 with or without brackets), or null for names and null."""
    inner = F.regexp_replace(X.col(host), r"^\[|\]$", "")
    v4 = lambda x: F.concat(F.lit(MAPPED), F.lpad(F.lower(F.hex(_v4(x))), 8, "0"))
    return _let(inner, lambda x: F.when(F.contains(x, F.lit(":")), _v6(x)).otherwise(v4(x)))


def bounds(network: str) -> tuple[str, str, int]:
    """The first and last number of a network in CIDR notation, and its length of 128."""
    net = ipaddress.ip_network(network)
    shift = (0xFFFF << 32) if net.version == 4 else 0
    return f"{int(net[0]) | shift:032x}", f"{int(net[-1]) | shift:032x}", net.prefixlen + (96 if net.version == 4 else 0)


def verdict(address: Column, networks: dict[str, bool]) -> Column:
    """The value of the longest of the networks that hold the address (32 digits), or null."""
    rows = sorted(((*bounds(n), v) for n, v in networks.items()), key=lambda r: -r[2])
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(v).alias("v")) for a, b, _, v in rows])
    return _let(address, lambda own: F.try_element_at(F.filter(table, lambda r: own.between(r["a"], r["b"])), F.lit(1))["v"])


def prefix(address: Column, length: Column) -> Column:
    """The first ``length`` bits as digits, the last one masked."""
    whole, rest = F.floor(length / 4).cast("int"), length % 4
    digit = F.conv(F.substr(address, whole + 1, F.lit(1)), 16, 10).cast("int")
    step = F.pow(F.lit(2.0), (F.lit(4) - rest).cast("double")).cast("int")
    masked = F.lower(F.hex((digit - digit % step).cast("long")))
    return F.concat(F.left(address, whole), F.when(rest > 0, masked).otherwise(""))


def matched(df: DataFrame, address: str, networks: DataFrame, key: str, network: str = "network") -> DataFrame:
    """key, network of each row of ``df`` that a network of the table (network: CIDR text) holds: the longest, then the first by text. Texts that are no networks hold nothing."""
    cidr = F.split(network, "/")
    base, six = number(cidr[0]), F.contains(network, F.lit(":"))
    length = F.try_element_at(cidr, F.lit(2)).try_cast("int") + F.when(six, 0).otherwise(96)
    table = networks.select(F.col(network).alias("network"), base.alias("base"), length.alias("length")).where("base is not null and length between 0 and 128").distinct()
    table = table.select("network", "length", prefix(F.col("base"), F.col("length")).alias("prefix"))
    lengths = [r["length"] for r in table.select("length").distinct().collect()]  # 129 at most
    own = df.select(F.col(key).alias("key"), number(address).alias("address")).where("address is not null")
    own = own.select("key", "address", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("length"))
    met = own.withColumn("prefix", prefix(F.col("address"), F.col("length"))).join(table, ["length", "prefix"])
    best = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("length"), "network"))
    return met.withColumn("n", best).where("n = 1").select(F.col("key").alias(key), "network")
