"""Scalar column expressions. All stay inside whole-stage codegen; no Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAT_PER_BTC = 100_000_000

# Risk level cut points.
CRITICAL_AT, HIGH_AT, MEDIUM_AT = 0.67, 0.50, 0.32

# Label spellings, and the plausible range of epoch seconds (milliseconds above 1e11).
ILLICIT_WORDS = ["1", "illicit", "ILLICIT", "true", "True"]
LICIT_WORDS = ["0", "licit", "LICIT", "legitimate", "false", "False"]
EPOCH_SECONDS_MIN, EPOCH_SECONDS_MAX, EPOCH_MILLIS_ABOVE = 1_230_940_800, 3_000_000_000, 100_000_000_000

# Identifier patterns.
HEX64 = "^[0-9a-fA-F]{64}$"
IPV4 = r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def try_cast(c: Column | str, kind: str) -> Column:
    return as_col(c).try_cast(kind)


def btc_text(sat: Column | str) -> Column:
    """Satoshi to an exact 8-decimal BTC string."""
    return (as_col(sat).cast("decimal(28,0)") / F.lit(SAT_PER_BTC)).cast("decimal(28,8)").cast("string")


def btc(sat: Column | str) -> Column:
    return as_col(sat).cast("double") / F.lit(float(SAT_PER_BTC))


def risk_level(score: Column | str) -> Column:
    s = as_col(score)
    return (F.when(s >= CRITICAL_AT, "critical").when(s >= HIGH_AT, "high")
            .when(s >= MEDIUM_AT, "medium").when(s.isNotNull(), "low"))


def level_rank(level: Column | str) -> Column:
    c = as_col(level)
    return F.when(c == "critical", 4).when(c == "high", 3).when(c == "medium", 2).when(c.isNotNull(), 1)


def level_from_rank(rank: Column | str) -> Column:
    c = as_col(rank)
    return F.when(c == 4, "critical").when(c == 3, "high").when(c == 2, "medium").when(c == 1, "low")


def whole_number(c: Column | str) -> Column:
    """Text or number to bigint, rounding fractions; NULL when it is no number."""
    return F.round(try_cast(as_col(c).cast("string"), "decimal(38,18)"), 0).try_cast("bigint")


def parse_timestamp(c: Column | str) -> Column:
    """Epoch milliseconds, epoch seconds or ISO text to a timestamp; anything else NULL."""
    text = F.trim(as_col(c).cast("string"))
    n = whole_number(text)
    micros = F.round(text.try_cast("decimal(38,18)") * 1000, 0).try_cast("bigint")
    return (F.when(n > EPOCH_MILLIS_ABOVE, F.timestamp_micros(micros))
            .when(n.between(EPOCH_SECONDS_MIN, EPOCH_SECONDS_MAX), F.timestamp_seconds(n))
            .when(n.isNull(), text.try_cast("timestamp")))


def parse_amount(c: Column | str, name: str) -> Column:
    """Amount to satoshi. The column name decides the unit, else a decimal point or exponent means BTC."""
    text = F.trim(as_col(c).cast("string"))
    as_btc = F.round(text.try_cast("decimal(38,18)") * SAT_PER_BTC, 0).try_cast("bigint")
    lowered = name.lower()
    if "sat" in lowered:
        return whole_number(text)
    if "btc" in lowered:
        return as_btc
    return F.when(text.contains(".") | F.lower(text).contains("e-"), as_btc).otherwise(whole_number(text))


def parse_list(c: Column | str, element: str) -> Column:
    """A list held as JSON-like text (either quote style) to an array column."""
    return F.from_json(as_col(c).cast("string"), f"array<{element}>")


def list_total(c: Column) -> Column:
    return F.aggregate(F.filter(c, lambda x: x.isNotNull()), F.lit(0).cast("bigint"), lambda a, x: a + x)


def normal_label(c: Column | str) -> Column:
    text = as_col(c).cast("string")
    return F.when(text.isin(ILLICIT_WORDS), "illicit").when(text.isin(LICIT_WORDS), "licit").otherwise("unknown")


def asn_number(c: Column | str) -> Column:
    """``AS123`` or ``123`` to 123; non-positive or malformed to NULL."""
    n = F.regexp_replace(F.trim(as_col(c).cast("string")), "(?i)^AS", "").try_cast("bigint")
    return F.when(n > 0, n)


def asn_first_digits(c: Column | str) -> Column:
    """First run of digits in the text, 0 when there is none."""
    digits = F.regexp_extract(as_col(c).cast("string"), "([0-9]+)", 1)
    return F.coalesce(F.when(digits != "", digits).try_cast("bigint"), F.lit(0).cast("bigint"))


def short_label(c: Column | str) -> Column:
    """Long identifiers abbreviated as first eight and last four characters."""
    text = as_col(c)
    return F.when(F.length(text) > 12, F.concat(F.left(text, F.lit(8)), F.lit("..."), F.right(text, F.lit(4)))).otherwise(text)


def active_days(first: Column | str, last: Column | str) -> Column:
    secs = F.unix_timestamp(as_col(last)) - F.unix_timestamp(as_col(first))
    return F.greatest(F.lit(1).cast("bigint"), F.floor(secs / 86400).cast("bigint") + 1)


def usable_address(c: Column | str) -> Column:
    """True for addresses that take part in the graph."""
    text = F.trim(as_col(c))
    return text.isNotNull() & (text != "") & ~text.isin("None", "nan")


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def ipv4_number(c: Column | str) -> Column:
    """Dotted quad to bigint; NULL when malformed."""
    text = F.trim(as_col(c))
    octet = [F.split_part(text, F.lit("."), F.lit(i)).try_cast("bigint") for i in range(1, 5)]
    legal = text.rlike(IPV4)
    for o in octet:
        legal = legal & o.between(0, 255)
    return F.when(legal, octet[0] * 16777216 + octet[1] * 65536 + octet[2] * 256 + octet[3])


# Reserved IPv4 blocks (network, prefix length) that are never mapped to a place.
RESERVED_BLOCKS = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16),
    ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15),
    ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
]


def is_reserved_ip(number: Column | str) -> Column:
    """True for private, loopback, link-local, multicast and other reserved addresses."""
    n = as_col(number)
    hit = F.lit(False)
    for network, bits in RESERVED_BLOCKS:
        a, b, c, d = (int(x) for x in network.split("."))
        start = ((a * 256 + b) * 256 + c) * 256 + d
        hit = hit | n.between(start, start + 2 ** (32 - bits) - 1)
    return hit
