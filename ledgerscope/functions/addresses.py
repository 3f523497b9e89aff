"""IPv4 and IPv6 addresses as fixed-width hexadecimal keys, whose prefixes are plain text.

A key is the address in lower-case hexadecimal, 8 digits for IPv4 and 32 for IPv6, so keys of one length sort as numbers
do and a prefix of n bits is the key with the other bits cleared.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerscope.functions.exprs import as_col, ipv4_number, is_reserved_ip

# IPv6 blocks that are never mapped to a place, and the parts of them that may be.
RESERVED_V6 = [
    ("::", 8), ("100::", 8), ("200::", 7), ("400::", 6), ("800::", 5), ("1000::", 4), ("4000::", 3), ("6000::", 3), ("8000::", 3),
    ("a000::", 3), ("c000::", 3), ("e000::", 4), ("f000::", 5), ("f800::", 6), ("fe00::", 9), ("2001::", 23), ("2001:db8::", 32),
    ("2002::", 16), ("fc00::", 7), ("fe80::", 10), ("ff00::", 8),
]
PUBLIC_V6 = [("2001:1::1", 128), ("2001:1::2", 128), ("2001:3::", 32), ("2001:4:112::", 48), ("2001:20::", 28), ("2001:30::", 28)]


def v4_key(number: Column) -> Column:
    """The key of an IPv4 address given as a number."""
    return F.lower(F.lpad(F.hex(number.cast("bigint")), 8, "0"))


def _let(value: Column, fn) -> Column:
    """``fn`` of a value that is worked out once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _groups(c: Column) -> Column:
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ":"))


def _joined(halves: Column) -> Column:
    """Eight groups of four digits from the parts before and after ``::``; NULL when there can't be eight."""
    def filled(both: Column) -> Column:
        left, right = both["left"], both["right"]
        missing = F.lit(8) - F.size(left) - F.size(right)
        legal = (F.size(halves) <= 2) & F.when(F.size(halves) == 2, missing >= 1).otherwise(missing == 0)
        parts = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
        return F.when(legal & F.forall(parts, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(parts, lambda g: F.lpad(g, 4, "0")), ""))

    return _let(F.struct(_groups(F.coalesce(F.get(halves, F.lit(0)), F.lit(""))).alias("left"),
                         _groups(F.coalesce(F.get(halves, F.lit(1)), F.lit(""))).alias("right")), filled)


def _v6_key(text: Column) -> Column:
    """The key of an IPv6 text, which may have a zone and end in dotted form; NULL when malformed."""
    def plain(bare: Column) -> Column:
        def dotted(tail: Column) -> Column:
            return _let(v4_key(ipv4_number(tail)), lambda k: F.concat(
                F.substring(bare, F.lit(1), F.length(bare) - F.length(tail)), F.substring(k, 1, 4), F.lit(":"), F.substring(k, 5, 4)))

        tail = F.substring_index(bare, ":", -1)
        return F.when(tail.contains("."), _let(tail, dotted)).otherwise(bare)

    whole = _let(F.substring_index(F.lower(text), "%", 1), plain)
    return F.when(~text.rlike("%.*%|%$|\\s"), _let(F.split(whole, "::"), _joined))


def ip_key(c: Column | str) -> Column:
    """The key of an address text of either family; NULL when malformed."""
    text = F.trim(as_col(c))
    return F.when(text.contains(":"), _v6_key(text)).otherwise(v4_key(ipv4_number(text)))


def prefix_of(key: Column, bits: Column) -> Column:
    """The first ``bits`` of a key, as its leading digits with the rest of the last one cleared."""
    whole, rest = F.floor(bits / 4).cast("int"), (bits % 4).cast("int")
    digit = F.conv(F.substring(key, whole + 1, F.lit(1)), 16, 10).cast("int")
    kept = F.lower(F.hex(digit.bitwiseAND(F.element_at(F.array(F.lit(0), F.lit(8), F.lit(12), F.lit(14)), rest + 1))))
    return F.concat(F.substring(key, F.lit(1), whole), F.when(rest > 0, kept).otherwise(F.lit("")))


def _bounds(network: str, bits: int) -> tuple[str, str]:
    """First and last key of an IPv6 block written with all or with ``::``."""
    left, _, right = network.partition("::")
    groups = [g for g in left.split(":") if g]
    end = [g for g in right.split(":") if g]
    number = int("".join(g.zfill(4) for g in groups + ["0"] * (8 - len(groups) - len(end)) + end), 16)
    return f"{number:032x}", f"{number | ((1 << (128 - bits)) - 1):032x}"


def is_reserved(key: Column, number: Column) -> Column:
    """True for private, loopback, link-local, multicast and other reserved addresses of either family."""
    def within(blocks: list[tuple[str, int]]) -> Column:
        hit = F.lit(False)
        for network, bits in blocks:
            hit = hit | key.between(*_bounds(network, bits))
        return hit

    return F.when(F.length(key) == 32, within(RESERVED_V6) & ~within(PUBLIC_V6)).otherwise(F.coalesce(is_reserved_ip(number), F.lit(False)))
