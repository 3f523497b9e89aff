"""Endpoint rollup and enrichment by address range."""

from __future__ import annotations

import random

from ledgerscope import schemas
from ledgerscope.functions import exprs as X
from ledgerscope.operators import network as n


def test_rollup_and_precedence(spark):
    rows = [("e1", "t1", 1000, "8.8.8.8", 1, "1.1.1.1", 8333, "NL", 99999), ("e2", "t2", 2000, "8.8.8.8", 1, "10.0.0.5", 8333, None, None),
            ("e3", "t3", 3000, "9.9.9.9", 1, "8.8.8.8", 8333, "US", -5)]
    from pyspark.sql import functions as F
    ev = spark.createDataFrame(rows, "event_id string, transaction_id string, s bigint, src_ip string, src_port int, dst_ip string, dst_port int, country string, asn bigint"
                               ).withColumn("timestamp", F.timestamp_seconds("s"))
    points = n.endpoints(ev)
    ranges = spark.createDataFrame([(X_ip("8.0.0.0"), X_ip("8.255.255.255"), "Wide", "wd", None, None, 1.0, 2.0, 15, "Wide Net", None),
                                    (X_ip("8.8.0.0"), X_ip("8.8.255.255"), "Narrow", "na", "R", "C", 3.0, 4.0, 16, "Narrow Net", "n.net")], schemas.IP_RANGES)
    got = {r["ip"]: r for r in n.map_points(points, n.enrich_ips(points, ranges)).collect()}
    g = got["8.8.8.8"]
    assert (g["event_count"], g["source_event_count"], g["destination_event_count"], g["transaction_count"]) == (3, 2, 1, 3)
    assert (g["country"], g["country_code"], g["asn"], g["as_name"], g["city"], g["is_mapped"]) == ("NL", "NL", "AS99999", "Narrow Net", "C", True)
    assert (got["10.0.0.5"]["country_code"], got["10.0.0.5"]["is_mapped"]) == ("ZZ", False)
    assert got["9.9.9.9"]["asn"] is None and not got["9.9.9.9"]["is_mapped"]


def X_ip(text):
    a, b, c, d = map(int, text.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def test_range_join_equals_scan(spark):
    rng = random.Random(11)
    spans = []
    for i in range(60):
        start = rng.randrange(2 ** 24, 200 * 2 ** 24)
        spans.append((start, start + rng.choice([10, 300, 70_000, 5_000_000]), f"c{i}"))
    ips = [f"{rng.randrange(1, 200)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}" for _ in range(150)]
    ips += [f"{s // 2**24}.{s // 65536 % 256}.{s // 256 % 256}.{s % 256}" for s, _, _ in spans] + ["bad", "1.2.3", "300.1.1.1"]
    r = spark.createDataFrame([(a, z, c, c, None, None, 1.0, 1.0, 1, None, None) for a, z, c in spans], schemas.IP_RANGES)
    got = {x["ip"]: x for x in n.enrich_ips(spark.createDataFrame([(i,) for i in ips], "ip string"), r).collect()}
    import ipaddress
    for ip in ips:
        if ip in ("bad", "1.2.3", "300.1.1.1"):
            assert not got[ip]["is_mapped"] and not got[ip]["is_private"]
            continue
        v = X_ip(ip)
        hits = sorted((z - a, a, c) for a, z, c in spans if a <= v <= z)
        if not got[ip]["is_private"]:
            assert got[ip]["country"] == (hits[0][2] if hits else None), ip
        else:
            assert ipaddress.ip_address(ip).is_private or ip.startswith(("100.", "192.0.0.")) or ipaddress.ip_address(ip).is_reserved


def test_scalar_expressions(spark):
    df = spark.createDataFrame([(1000, "AS15", "12.7"), (123456789, "x", "1e-8")], "s bigint, a string, t string")
    rows = df.select(X.btc_text("s").alias("b"), X.asn_number("a").alias("n"), X.asn_first_digits("a").alias("f"), X.whole_number("t").alias("w"),
                     X.parse_amount("t", "amount").alias("m"), X.short_label("a").alias("l")).collect()
    assert [tuple(r) for r in rows] == [("0.00001000", 15, 15, 13, 1_270_000_000, "AS15"), ("1.23456789", None, 0, 0, 1, "x")]
    levels = [r[0] for r in spark.createDataFrame([(x,) for x in (0.3199, 0.32, 0.4999, 0.50, 0.6699, 0.67, None)], "s double").select(X.risk_level("s")).collect()]
    assert levels == ["low", "medium", "medium", "high", "high", "critical", None]


def v6_texts():
    rng = random.Random(17)
    texts = ["::", "::1", "1::", "fe80::1%eth0", "::ffff:1.2.3.4", "64:ff9b::8.8.8.8", "2001:db8::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "2a00:1450:4001:82f::200e", "2001:4:112::7",
             "2001:1::1", "2001:1::3", "2002::5", "FE80::ABCD", "ff02::1", "1:2", ":::", "1::2::3", "1:2:3:4:5:6:7:8:9", "12345::", "g::", ":1::", "1:", "::1.2.3", "::300.1.1.1", "", "1:2:3:4:5:6:7:8::", "3fff:ffff::1", "4000::"]
    for _ in range(300):
        groups = [f"{rng.choice([0, 0, rng.randrange(65536)]):x}" for _ in range(8)]
        groups[0] = rng.choice(["2001", "2a02", "fc01", "2606", groups[0]])
        import ipaddress
        texts.append(rng.choice([":".join(groups), str(ipaddress.ip_address(":".join(groups)))]))
    return sorted(set(texts))


def test_ipv6_keys_and_reserved_blocks(spark):
    import ipaddress

    from pyspark.sql import functions as F

    from ledgerscope.functions import addresses as a
    df = spark.createDataFrame([(t,) for t in v6_texts()], "t string").select("t", a.ip_key("t").alias("k"), X.ipv4_number("t").alias("n"))
    for r in df.select("t", "k", a.is_reserved(F.col("k"), F.col("n")).alias("p")).collect():
        try:
            ip = ipaddress.IPv6Address(r["t"])
        except ValueError:
            assert r["k"] is None, r["t"]
            continue
        assert r["k"] == f"{int(ip):032x}", r["t"]
        reserved = ip.is_private or ip.is_loopback or ip.is_reserved or ip.is_multicast or ip.is_unspecified or ip.is_link_local
        assert r["p"] == reserved, r["t"]


def test_longest_prefix_equals_scan(spark):
    """Nested and wide networks of both families, the widest included; none is spread out."""
    import ipaddress
    rng = random.Random(23)
    nets = ["0.0.0.0/0", "8.0.0.0/8", "8.8.0.0/16", "8.8.8.0/24", "8.8.8.8/32", "::/0", "2a00::/12", "2a00:1450::/32", "2a00:1450:4001::/48", "2a00:1450:4001:82f::200e/128", "2600::/7"]
    nets += [f"{ipaddress.ip_network((rng.getrandbits(32), n), strict=False)}" for n in range(1, 31, 2)] + [f"{ipaddress.ip_network((0x2a << 120 | rng.getrandbits(120), n), strict=False)}" for n in (9, 21, 30, 45, 61, 77, 127)]
    ips = ["8.8.8.8", "8.8.8.9", "8.8.9.1", "8.1.1.1", "9.9.9.9", "2a00:1450:4001:82f::200e", "2a00:1450:4001:1::", "2a00:1450:1::", "2a00:1::", "2a10::", "2601::", "3000::1", "bad"]
    ips += [str(ipaddress.ip_network(x).network_address + 1) if ipaddress.ip_network(x).num_addresses > 2 else str(ipaddress.ip_network(x).network_address) for x in nets]
    fields = "network string, country string, country_code string, region string, city string, latitude double, longitude double, asn bigint, as_name string, as_domain string"
    networks = spark.createDataFrame([(x, x, None, None, None, 1.0, 1.0, 1, None, None) for x in [*nets, "1.2.3.4/40", "zz/8"]], fields)
    got = {r["ip"]: r for r in n.enrich_ips(spark.createDataFrame([(i,) for i in ips], "ip string"), networks=networks).collect()}
    assert len(got) == len(set(ips)) and n.network_prefixes(networks).count() == len(nets)
    for ip in set(ips) - {"bad"}:
        if got[ip]["is_private"]:
            continue
        inside = [x for x in nets if ipaddress.ip_address(ip) in ipaddress.ip_network(x)]
        assert got[ip]["country"] == max(inside, key=lambda x: ipaddress.ip_network(x).prefixlen), ip
    assert not got["bad"]["is_mapped"]


def test_ranges_become_few_prefixes(spark):
    import ipaddress
    spans = [(0, 2 ** 32 - 1), (0, 2 ** 24 - 1), (1, 2 ** 32 - 2), (77, 77), (16_777_210, 33_554_500)]
    r = spark.createDataFrame([(a, z, f"{a}-{z}", None, None, None, 1.0, 1.0, 1, None, None) for a, z in spans], schemas.IP_RANGES)
    got = {}
    for row in n.range_prefixes(r).collect():
        got.setdefault(row["country"], []).append((int(row["prefix"].ljust(8, "0") or "0", 16), row["bits"]))
    for a, z in spans:
        want = [(int(x.network_address), x.prefixlen) for x in ipaddress.summarize_address_range(ipaddress.ip_address(a), ipaddress.ip_address(z))]
        assert sorted(got[f"{a}-{z}"]) == sorted(want)
