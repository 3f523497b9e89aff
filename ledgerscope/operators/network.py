"""Network intelligence: endpoint rollups, flows, enrichment by address range, distributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions import addresses
from ledgerscope.functions import exprs as X

TX = "transaction_id"
STANDARD_PORT = 8333


def endpoints(events: DataFrame) -> DataFrame:
    """One row per IP seen on either end. Country and ASN come from the source side only.

    Rows are first reduced to one per (ip, event), then per (ip, transaction), so distinct counts are
    plain counts and a hub IP combines before its final group.
    """
    side = lambda ip, src: F.struct(
        F.col(ip).alias("ip"), F.lit(int(src)).alias("s"), F.lit(int(not src)).alias("d"),
        (F.col("country") if src else F.lit(None).cast("string")).alias("country"),
        (F.col("asn") if src else F.lit(None).cast("bigint")).alias("asn"))
    both = events.select("event_id", TX, "timestamp", F.explode(F.array(side("src_ip", True), side("dst_ip", False))).alias("e"))
    rows = both.select("event_id", TX, "timestamp", "e.*").where(F.col("ip").isNotNull() & (F.trim("ip") != ""))
    country = F.when(F.trim("country") != "", F.col("country"))
    asn = F.when(F.col("asn") > 0, F.col("asn"))
    per_event = rows.groupBy("ip", TX, "event_id").agg(
        F.sum("s").alias("s"), F.sum("d").alias("d"), F.min("timestamp").alias("a"), F.max("timestamp").alias("z"),
        F.max(country).alias("c"), F.max(asn).alias("n"))
    per_tx = per_event.groupBy("ip", TX).agg(
        F.count("event_id").alias("ev"), F.sum("s").alias("s"), F.sum("d").alias("d"), F.min("a").alias("a"),
        F.max("z").alias("z"), F.max("c").alias("c"), F.max("n").alias("n"))
    return per_tx.groupBy("ip").agg(
        F.sum("ev").alias("event_count"), F.count(TX).alias("transaction_count"),
        F.sum("s").alias("source_event_count"), F.sum("d").alias("destination_event_count"),
        F.min("a").alias("first_seen"), F.max("z").alias("last_seen"), F.max("c").alias("dataset_country"),
        F.max("n").alias("dataset_asn"))


def flows(events: DataFrame, top: int | None = None) -> DataFrame:
    """Directed flows between different IPs; with ``top`` only the busiest, for display."""
    per_tx = events.where((F.trim("src_ip") != "") & (F.trim("dst_ip") != "") & (F.col("src_ip") != F.col("dst_ip"))
                          ).groupBy("src_ip", "dst_ip", TX).agg(F.count(F.lit(1)).alias("n"))
    out = per_tx.groupBy("src_ip", "dst_ip").agg(F.sum("n").alias("event_count"), F.count(TX).alias("transaction_count"))
    return out if top is None else out.orderBy(F.desc("event_count"), "src_ip", "dst_ip").limit(top)


FIELDS = ["country", "country_code", "region", "city", "latitude", "longitude", "asn", "as_name", "as_domain"]


def range_prefixes(ranges: DataFrame) -> DataFrame:
    """IPv4 ranges ``start_ip`` to ``end_ip`` as the prefixes that make them up, at most two per length.

    ``prefix``, its length ``bits``, the address ``width`` (32) and the ``span`` of the whole range, which decides between
    overlapping ranges. A /0 or /8 stays one row.
    """
    end = F.col("end_ip") + 1
    cut = ranges.where(F.col("start_ip") < end).select("*", F.explode(F.sequence(F.lit(0), F.lit(32))).alias("_k"))
    size = F.pow(F.lit(2.0), F.col("_k")).cast("bigint")
    low, high = F.floor((F.col("start_ip") + size - 1) / size), F.floor(end / size)
    blocks = F.when(low < high, F.array_compact(F.array(F.when(low % 2 == 1, low), F.when(high % 2 == 1, high - 1))))
    pieces = cut.select(*FIELDS, "start_ip", (F.col("end_ip") - F.col("start_ip")).cast("double").alias("span"), size.alias("_size"),
                        (F.lit(32) - F.col("_k")).alias("bits"), F.explode(blocks).alias("_block"))
    key = addresses.v4_key(F.col("_block") * F.col("_size"))
    return pieces.select(*FIELDS, "span", addresses.v4_key(F.col("start_ip")).alias("first"), F.lit(32).alias("width"), "bits",
                         addresses.prefix_of(key, F.col("bits")).alias("prefix"))


def network_prefixes(networks: DataFrame) -> DataFrame:
    """Networks of either family, ``network`` as ``address/bits``, in the form of ``range_prefixes``; malformed ones are left out."""
    bits = F.substring_index("network", "/", -1).try_cast("int")
    keyed = networks.select(*FIELDS, addresses.ip_key(F.substring_index("network", "/", 1)).alias("_key"), bits.alias("bits"))
    width = (F.length("_key") * 4).cast("int")
    sound = keyed.withColumn("width", width).where(F.col("_key").isNotNull() & F.col("bits").between(0, F.col("width")))
    return sound.select(*FIELDS, F.pow(F.lit(2.0), F.col("width") - F.col("bits")).alias("span"), F.col("_key").alias("first"), "width", "bits",
                        addresses.prefix_of(F.col("_key"), F.col("bits")).alias("prefix"))


def enrich_ips(ips: DataFrame, ranges: DataFrame | None = None, networks: DataFrame | None = None) -> DataFrame:
    """Place and network owner of each distinct ``ip``, IPv4 or IPv6; reserved ones get ZZ, unknown ones nothing.

    Ranges and networks become prefixes. Each address looks up its own prefix of every length that there is (at most 33 and 129), so the
    join is one on equal keys and no range is spread out. Where several hold an address the narrowest wins, then the one that starts first.
    """
    parts = [p for p in (range_prefixes(ranges) if ranges is not None else None, network_prefixes(networks) if networks is not None else None) if p is not None]
    if not parts:
        raise ValueError("ranges or networks are needed")
    prefixes = reduce(DataFrame.unionAll, [p.select(*FIELDS, "span", "first", "width", "bits", "prefix") for p in parts])
    # the key comes out of the aggregate, so no later expression parses the text again
    keyed = ips.groupBy("ip").agg(F.max(addresses.ip_key("ip")).alias("key"), F.max(X.ipv4_number("ip")).alias("n"))
    keyed = keyed.select("ip", "key", addresses.is_reserved(F.col("key"), F.col("n")).alias("is_private"), (F.length("key") * 4).alias("width"))
    lengths = prefixes.groupBy("width").agg(F.collect_set("bits").alias("lengths"))  # two rows
    tries = keyed.where(F.col("key").isNotNull() & ~F.col("is_private")).join(F.broadcast(lengths), "width").select(
        "ip", "key", "width", F.explode("lengths").alias("bits"))
    tries = tries.select("ip", "width", "bits", addresses.prefix_of(F.col("key"), F.col("bits")).alias("prefix"))
    hit = tries.join(prefixes, ["width", "bits", "prefix"]).groupBy("ip").agg(
        F.min_by(F.struct(*FIELDS), F.struct("span", "first", F.to_json(F.struct(*FIELDS)))).alias("r"))
    private = F.coalesce("is_private", F.lit(False))
    out = keyed.join(hit, "ip", "left")
    special = {"country": F.lit("Private / Reserved"), "country_code": F.lit("ZZ")}
    return out.select("ip", *[
        (F.when(private, special[f]).otherwise(F.col(f"r.{f}")) if f in special else F.col(f"r.{f}")).alias(f)
        for f in FIELDS], private.alias("is_private"), F.col("r.latitude").isNotNull().alias("is_mapped"))


def map_points(points: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Endpoints with final country and ASN: the dataset's own value first, the enrichment second."""
    e = enrichment.select("ip", F.col("country").alias("e_country"), F.col("country_code").alias("e_code"), "region", "city",
                          "latitude", "longitude", F.col("asn").alias("e_asn"), F.col("as_name").alias("e_name"),
                          "as_domain", "is_mapped")
    own_code = F.when(F.length(F.trim("dataset_country")) == 2, F.upper(F.trim("dataset_country")))
    asn = F.coalesce(F.when(F.col("dataset_asn") > 0, F.col("dataset_asn")), F.when(F.col("e_asn") > 0, F.col("e_asn")))
    text = F.when(asn.isNotNull(), F.concat(F.lit("AS"), asn.cast("string")))
    return points.join(e, "ip", "left").select(
        "ip", F.coalesce("dataset_country", "e_country").alias("country"),
        F.coalesce(own_code, F.upper(F.trim("e_code"))).alias("country_code"), "region", "city", "latitude", "longitude",
        text.alias("asn"), F.when(asn.isNotNull(), F.coalesce("e_name", text)).alias("as_name"), "as_domain",
        "event_count", "transaction_count", "source_event_count", "destination_event_count", "first_seen", "last_seen",
        F.coalesce("is_mapped", F.lit(False)).alias("is_mapped"))


def map_metrics(points: DataFrame, events: DataFrame) -> DataFrame:
    """One row: IPs, mapped, unmapped, countries, ASNs, events."""
    p = points.agg(
        F.count(F.lit(1)).alias("total_ips"), F.count(F.when(F.col("is_mapped"), 1)).alias("mapped_ips"),
        F.count(F.when(~F.col("is_mapped"), 1)).alias("unmapped_ips"),
        F.count_distinct(F.coalesce("country_code", "country")).alias("unique_countries"),
        F.count_distinct("asn").alias("unique_asns"))
    n = events.agg(F.count(F.lit(1)).alias("total_events"))
    return p.withColumn("_j", F.lit(1)).join(n.withColumn("_j", F.lit(1)), "_j").drop("_j")


def with_transaction_risk(events: DataFrame, transactions: DataFrame, results: DataFrame) -> DataFrame:
    """Events with the value and risk of their transaction."""
    return events.join(transactions.select(TX, "total_output_value_satoshi"), TX, "left").join(
        results.select(F.col("entity_id").alias(TX), "risk_score", "risk_level"), TX, "left")


def is_risky() -> object:
    return F.coalesce((F.col("risk_score") >= 0.65) | F.col("risk_level").isin("high", "critical"), F.lit(False))


def by_country(rows: DataFrame) -> DataFrame:
    """Events, share, value and risky events per country."""
    from pyspark.sql import Window
    per = rows.groupBy(F.coalesce("country", F.lit("UNKNOWN")).alias("country")).agg(
        F.count(F.lit(1)).alias("event_count"), F.sum("total_output_value_satoshi").alias("value_satoshi"),
        F.count(F.when(is_risky(), 1)).alias("risk_count"))
    return per.withColumn("share_pct", F.col("event_count") * 100.0 / F.sum("event_count").over(Window.partitionBy()))


def by_asn(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("asn") > 0).groupBy("asn").agg(
        F.count(F.lit(1)).alias("event_count"), F.count(F.when(is_risky(), 1)).alias("risk_count"))


def top_source_ips(rows: DataFrame, top: int = 10) -> DataFrame:
    return rows.groupBy("src_ip").agg(F.count(F.lit(1)).alias("event_count"), F.max("risk_score").alias("max_risk")
                                      ).orderBy(F.desc("event_count"), "src_ip").limit(top)


def by_port(rows: DataFrame) -> DataFrame:
    """Events per port and end."""
    ends = rows.select(F.explode(F.array(
        F.struct(F.lit("src").alias("end"), F.col("src_port").alias("port")),
        F.struct(F.lit("dst").alias("end"), F.col("dst_port").alias("port")))).alias("e"))
    return ends.groupBy("e.end", "e.port").agg(F.count(F.lit(1)).alias("event_count"))


def port_standard(rows: DataFrame) -> DataFrame:
    """Events on the standard destination port and on any other."""
    standard = F.coalesce(F.col("dst_port") == STANDARD_PORT, F.lit(False))
    return rows.agg(F.count(F.when(standard, 1)).alias("standard_port"), F.count(F.when(~standard, 1)).alias("other_port"))


def suspicious_events(rows: DataFrame) -> DataFrame:
    return rows.where(is_risky())


def top_values(events: DataFrame, column: str, top: int = 10) -> DataFrame:
    """The most frequent values of a column."""
    return events.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), column).limit(top)


def ports_by_label(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Per destination port: licit and illicit events, and the standard-port share of each label."""
    rows = events.join(labels.select(TX, "ground_truth_label"), TX)
    one = F.col("ground_truth_label")
    return rows.groupBy("dst_port").agg(
        F.count(F.when(one == 0, 1)).alias("licit"), F.count(F.when(one == 1, 1)).alias("illicit"),
        F.count(F.lit(1)).alias("total"))


def standard_port_share(events: DataFrame, labels: DataFrame) -> DataFrame:
    rows = events.join(labels.select(TX, "ground_truth_label"), TX)
    return rows.groupBy("ground_truth_label").agg(
        F.count(F.lit(1)).alias("events"),
        (F.count(F.when(F.col("dst_port") == STANDARD_PORT, 1)) * 100.0 / F.count(F.lit(1))).alias("standard_pct"))


def filter_points(points: DataFrame, country: str | None = None, asn: str | None = None, mapped: bool | None = None,
                  text: str | None = None) -> DataFrame:
    """Endpoint filter by country, ASN, mapped state and free text."""
    out = points
    if country:
        out = out.where(F.coalesce("country_code", "country") == country)
    if asn:
        out = out.where(F.col("asn") == asn)
    if mapped is not None:
        out = out.where(F.col("is_mapped") == mapped)
    if text:
        needle = text.lower()
        hit = F.lit(False)
        for c in ("ip", "asn", "as_name", "country"):
            hit = hit | F.coalesce(F.lower(c).contains(needle), F.lit(False))
        out = out.where(hit)
    return out


def filter_values(points: DataFrame) -> DataFrame:
    """The distinct countries and ASNs a filter can offer."""
    offers = points.select(F.explode(F.array(
        F.struct(F.lit("country").alias("field"), F.coalesce("country_code", "country").alias("value")),
        F.struct(F.lit("asn").alias("field"), F.col("asn").alias("value")))).alias("o"))
    return offers.select("o.field", "o.value").where(F.col("value").isNotNull()).distinct()


def country_rollup(points: DataFrame) -> DataFrame:
    """IPs and events per country of the mapped endpoints; the rest in one bucket."""
    name = F.when(F.col("is_mapped"), F.coalesce("country_code", "country"))
    return points.groupBy(F.coalesce(name, F.lit("Unmapped / Private")).alias("country")).agg(
        F.count(F.lit(1)).alias("ip_count"), F.sum("event_count").alias("event_count"))


def peers(flow_rows: DataFrame, points: DataFrame, ip: str | None = None, top: int | None = None) -> DataFrame:
    """Flows of one IP in both directions with both ends mapped, else the ``top`` busiest mapped flows."""
    mapped = points.where("is_mapped").select("ip")
    both = flow_rows.join(mapped.withColumnRenamed("ip", "src_ip"), "src_ip", "left_semi").join(
        mapped.withColumnRenamed("ip", "dst_ip"), "dst_ip", "left_semi")
    if ip is None:
        return both.orderBy(F.desc("event_count"), "src_ip", "dst_ip").limit(top)
    return both.where((F.col("src_ip") == ip) | (F.col("dst_ip") == ip)).withColumn(
        "direction", F.when(F.col("src_ip") == ip, "outgoing").otherwise("incoming"))
