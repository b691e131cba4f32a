"""Feature tables over transactions, addresses, IPs and their correlation, for all history or up to a cutoff."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import connected_components
from .lookups import endpoints

Tables = dict[str, DataFrame]

#: Trailing windows of the burst features: column suffix and seconds.
BURSTS = (("1m", 60), ("5m", 300), ("1h", 3600))


def scope(t: Tables, cutoff: datetime | None = None) -> Tables:
    """What was known at a cutoff (inclusive): observations by then, and the transactions that they show."""
    seen = t["network_observations"]
    out = dict(t)
    if cutoff is not None:
        seen = seen.filter(F.col("observed_at") <= F.lit(cutoff).cast("timestamp_ntz"))
        known = seen.select("txid").distinct()
        out |= {n: t[n].join(known, "txid", "left_semi") for n in ("transactions", "transaction_inputs", "transaction_outputs")}
    out["network_observations"] = seen
    out["address_transactions"] = out["transaction_inputs"].select("address", "txid").union(out["transaction_outputs"].select("address", "txid")).distinct()
    out["address_observations"] = out["address_transactions"].join(seen, "txid")
    src, dst = F.col("role") == "src", F.col("role") == "dst"
    # An observation with the same IP at both ends is one row with both roles.
    out["ip_observations"] = endpoints(seen).groupBy("ip", "observation_id").agg(
        F.bool_or(src).alias("is_source"), F.bool_or(dst).alias("is_destination"), F.max(F.when(src, F.col("port"))).alias("src_port"), F.max(F.when(dst, F.col("port"))).alias("dst_port"),
        F.max("txid").alias("txid"), F.max("observed_at").alias("observed_at"), F.max("reported_asn").alias("reported_asn"), F.max("reported_geo_country").alias("reported_geo_country"),
    )
    return out


def micros(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(c.cast("timestamp"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null if b is null or 0."""
    return F.when(F.coalesce(b, F.lit(0)) != 0, a.cast("double") / b.cast("double"))


def or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)


def side_values(rows: DataFrame, key: str, side: str, counts: dict[str, Column], spread: bool = True) -> DataFrame:
    """Counts and value statistics of one side of the transactions for each key."""
    amount = F.col("amount_sats")
    stats = [F.sum(amount).alias(f"total_{side}_sats"), F.avg(amount).alias(f"mean_{side}_sats"), F.max(amount).alias(f"max_{side}_sats")]
    if spread:
        stats += [F.min(amount).alias(f"min_{side}_sats"), F.stddev_samp(amount).alias(f"{side}_value_std")]
    return rows.groupBy(key).agg(*[c.alias(n) for n, c in counts.items()], *stats)


def timing(rows: DataFrame, key: str) -> DataFrame:
    """First and last observation, span, gaps between successive ones, and active hours of each key.

    Spans count boundaries of whole seconds; the least and greatest gap are
    rounded half to even.
    """
    order = W.partitionBy(key).orderBy("observed_at", "observation_id")
    gap = (micros("observed_at") - micros(F.lag("observed_at").over(order))) / 1e6
    hour = F.floor(micros("observed_at") / 3_600_000_000)
    whole = lambda c: F.rint(c).cast("long")
    second = lambda c: F.floor(micros(c) / 1_000_000).cast("long")
    spaced = rows.select(key, "observed_at", gap.alias("gap"), hour.alias("hour"))
    return spaced.groupBy(key).agg(
        F.min("observed_at").alias("first_observed_at"), F.max("observed_at").alias("last_observed_at"), (second(F.max("observed_at")) - second(F.min("observed_at"))).alias("observation_span_seconds"),
        F.avg("gap").alias("mean_inter_observation_seconds"), F.median("gap").alias("median_inter_observation_seconds"), whole(F.min("gap")).alias("min_inter_observation_seconds"),
        whole(F.max("gap")).alias("max_inter_observation_seconds"), F.count_distinct("hour").alias("active_hour_count"),
    )


def entropy(rows: DataFrame, key: str, bucket: Column, name: str) -> DataFrame:
    """Shannon entropy (natural logarithm) of the key's observations over buckets.

    From counts n of total N it is ln N - sum(n ln n) / N, which needs one
    aggregation above the counts and no window.
    """
    counts = rows.groupBy(key, bucket.alias("bucket")).agg(F.count("*").cast("double").alias("n"))
    return counts.groupBy(key).agg(F.greatest(F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n"), F.lit(0.0)).alias(name))


def entropies(rows: DataFrame, key: str) -> DataFrame:
    hour = entropy(rows, key, F.hour(F.col("observed_at").cast("timestamp")), "hour_of_day_entropy")
    return hour.join(entropy(rows, key, F.floor(micros("observed_at") / 86_400_000_000), "day_activity_entropy"), key)


def bursts(rows: DataFrame, key: str) -> DataFrame:
    """The most observations in any trailing window that ends with one, those of the same instant included."""
    at = rows.select(key, micros("observed_at").alias("at"))
    span = lambda s: W.partitionBy(key).orderBy("at").rangeBetween(-s * 1_000_000, 0)
    counted = at.select(key, *[F.count("*").over(span(s)).alias(n) for n, s in BURSTS])
    return counted.groupBy(key).agg(*[F.max(n).alias(f"max_observations_{n}") for n, _ in BURSTS])


def distinct_counts(rows: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """Distinct non-null values of several expressions for each key; 0 where a key has none.

    The values are stacked as (key, name, value) and made distinct first, so
    that each row is sent once instead of being expanded for every aggregate.
    A key without values has one row, which is counted for no name.
    """
    pairs = F.filter(F.array(*[F.struct(F.lit(n).alias("n"), c.cast("string").alias("v")) for n, c in columns.items()]), lambda p: p["v"].isNotNull())
    distinct = rows.select(key, F.explode_outer(pairs).alias("p")).select(key, "p.n", "p.v").distinct()
    return distinct.groupBy(key).agg(*[F.count_if(F.col("n") == n).alias(n) for n in columns])


def transaction_features(s: Tables) -> DataFrame:
    """One row per scoped transaction (35 columns)."""
    seen = s["network_observations"]
    inputs = side_values(s["transaction_inputs"], "txid", "input", {"input_count": F.count("*")})
    outputs = side_values(s["transaction_outputs"], "txid", "output", {"output_count": F.count("*")})
    volume = seen.groupBy("txid").agg(F.count("*").alias("network_observation_count"))
    unique = distinct_counts(seen, "txid", {"unique_source_ip_count": F.col("src_ip"), "unique_destination_ip_count": F.col("dst_ip"), "unique_reported_asn_count": F.col("reported_asn"), "unique_reported_country_count": F.col("reported_geo_country")})
    ips = endpoints(seen).groupBy("txid").agg(F.count_distinct("ip").alias("unique_ip_count"))
    joined = s["transactions"]
    for part in (inputs, outputs, volume, unique, ips, timing(seen, "txid"), entropies(seen, "txid"), bursts(seen, "txid")):
        joined = joined.join(part, "txid", "left")
    return joined.select(
        "txid", or_zero("input_count"), or_zero("output_count"), or_zero("total_input_sats"), or_zero("total_output_sats"), "fee_sats", "mean_input_sats", "mean_output_sats", "max_input_sats", "max_output_sats",
        "min_input_sats", "min_output_sats", "input_value_std", "output_value_std", ratio(F.col("fee_sats"), F.col("total_input_sats")).alias("fee_to_input_ratio"),
        *map(or_zero, ("network_observation_count", "unique_source_ip_count", "unique_destination_ip_count", "unique_ip_count", "unique_reported_asn_count", "unique_reported_country_count")),
        *_TIMES, or_zero("active_hour_count"), ratio(F.col("network_observation_count"), F.col("active_hour_count")).alias("observations_per_active_hour"),
        "hour_of_day_entropy", "day_activity_entropy", *[or_zero(f"max_observations_{n}") for n, _ in BURSTS],
    )


_TIMES = ("first_observed_at", "last_observed_at", "observation_span_seconds", "mean_inter_observation_seconds", "median_inter_observation_seconds", "min_inter_observation_seconds", "max_inter_observation_seconds")


def co_transaction_counts(pairs: DataFrame) -> DataFrame:
    """For each address the other addresses that share a transaction with it.

    An address of one transaction has the size of that less itself, whatever
    the size; only addresses of several meet the other members of each.
    """
    sizes = pairs.groupBy("txid").agg(F.count("*").alias("size"))
    own = pairs.groupBy("address").agg(F.count("*").alias("uses"), F.min("txid").alias("txid"))
    once = own.filter("uses = 1").join(sizes, "txid").filter("size > 1").select("address", (F.col("size") - 1).alias("co_transaction_address_count"))
    other = pairs.select("txid", F.col("address").alias("other"))
    several = pairs.join(own.filter("uses > 1").select("address"), "address")
    met = several.join(other, "txid").filter("address <> other").select("address", "other").distinct()
    return once.unionByName(met.groupBy("address").agg(F.count("*").alias("co_transaction_address_count")))


def component_sizes(pairs: DataFrame) -> DataFrame:
    """For each address the vertices, addresses and transactions, of its component in the bipartite graph."""
    edges = pairs.select(F.concat(F.lit("a:"), "address").alias("src"), F.concat(F.lit("t:"), "txid").alias("dst"))
    labels = connected_components(edges)
    sizes = labels.groupBy("component").agg(F.count("*").alias("bipartite_component_size"))
    return labels.filter("vertex LIKE 'a:%'").join(sizes, "component").select(F.expr("substring(vertex, 3)").alias("address"), "bipartite_component_size")


def address_features(s: Tables, components: DataFrame | None = None) -> DataFrame:
    """One row per address (26 columns); ``components`` may give component sizes made before."""
    pairs, seen = s["address_transactions"], s["address_observations"]
    counts = lambda side: {f"{side}_occurrence_count": F.count("*"), f"unique_{side}_tx_count": F.count_distinct("txid")}
    joined = pairs.groupBy("address").agg(F.count("*").alias("unique_tx_count"))
    joined = joined.join(component_sizes(pairs) if components is None else components, "address")
    for part in (
        side_values(s["transaction_inputs"], "address", "input", counts("input"), spread=False), side_values(s["transaction_outputs"], "address", "output", counts("output"), spread=False),
        co_transaction_counts(pairs), seen.groupBy("address").agg(F.count("*").alias("network_observation_count")), timing(seen, "address"),
    ):
        joined = joined.join(part, "address", "left")
    zero = lambda n: F.coalesce(F.col(n), F.lit(0))
    return joined.select(
        "address", *map(or_zero, ("input_occurrence_count", "output_occurrence_count", "unique_input_tx_count", "unique_output_tx_count")), "unique_tx_count", or_zero("total_input_sats"), or_zero("total_output_sats"),
        "mean_input_sats", "mean_output_sats", "max_input_sats", "max_output_sats", ratio(zero("unique_input_tx_count"), F.col("unique_output_tx_count")).alias("input_output_tx_ratio"),
        ratio(zero("total_input_sats"), F.col("total_output_sats")).alias("input_output_value_ratio"), or_zero("co_transaction_address_count"), or_zero("network_observation_count"), *_TIMES, or_zero("active_hour_count"),
        ratio(F.col("network_observation_count"), F.col("active_hour_count")).alias("observations_per_active_hour"), "bipartite_component_size",
    )


def ip_role_counts(rows: DataFrame) -> DataFrame:
    src, dst = F.col("is_source"), F.col("is_destination")
    volume = rows.groupBy("ip").agg(F.count_if(src).alias("source_observation_count"), F.count_if(dst).alias("destination_observation_count"), F.count("*").alias("total_observation_count"))
    unique = distinct_counts(rows, "ip", {"unique_tx_count": F.col("txid"), "unique_src_port_count": F.when(src, F.col("src_port")), "unique_dst_port_count": F.when(dst, F.col("dst_port")), "unique_reported_asn_count": F.col("reported_asn"), "unique_reported_country_count": F.col("reported_geo_country")})
    ports = rows.select("ip", F.explode(F.array(F.when(src, F.col("src_port")), F.when(dst, F.col("dst_port")))).alias("port")).groupBy("ip").agg(F.count_distinct("port").alias("unique_port_count"))
    return volume.join(unique, "ip").join(ports, "ip")


def ip_features(s: Tables) -> DataFrame:
    """One row per IP (24 columns)."""
    rows = s["ip_observations"]
    joined = ip_role_counts(rows).join(timing(rows, "ip"), "ip").join(entropies(rows, "ip"), "ip").join(bursts(rows, "ip"), "ip")
    return joined.select(
        "ip", "source_observation_count", "destination_observation_count", "total_observation_count", "unique_tx_count", "unique_src_port_count", "unique_dst_port_count", "unique_port_count",
        "unique_reported_asn_count", "unique_reported_country_count", *_TIMES, "active_hour_count", ratio(F.col("total_observation_count"), F.col("active_hour_count")).alias("observations_per_active_hour"),
        "hour_of_day_entropy", "day_activity_entropy", *[f"max_observations_{n}" for n, _ in BURSTS],
    )


def ip_reuse(s: Tables, reused_from: int = 2) -> DataFrame:
    """How many IPs an address is seen with, and in how many transactions each."""
    if isinstance(reused_from, bool) or reused_from < 2:
        raise ValueError("an IP is reused from 2 transactions on")
    per_ip = s["address_observations"].select("address", "txid", F.explode(F.array("src_ip", "dst_ip")).alias("ip")).distinct().groupBy("address", "ip").agg(F.count("*").alias("n"))
    return per_ip.groupBy("address").agg(
        F.count("*").alias("distinct_associated_ip_count"), F.count_if(F.col("n") >= reused_from).alias("reused_ip_count"), F.max("n").alias("max_transactions_per_associated_ip"), F.avg("n").alias("mean_transactions_per_associated_ip")
    )


def correlation_features(s: Tables, reused_from: int = 2) -> DataFrame:
    """One row per address: the endpoints seen with it (11 columns)."""
    seen = s["address_observations"]
    volume = seen.groupBy("address").agg(F.count_distinct("observation_id").alias("network_observation_count"))
    unique = distinct_counts(seen, "address", {"distinct_source_ip_count": F.col("src_ip"), "distinct_destination_ip_count": F.col("dst_ip"), "unique_reported_asn_count": F.col("reported_asn"), "unique_reported_country_count": F.col("reported_geo_country")})
    joined = s["address_transactions"].select("address").distinct().join(volume, "address", "left").join(unique, "address", "left").join(ip_reuse(s, reused_from), "address", "left")
    names = ("network_observation_count", "distinct_associated_ip_count", "distinct_source_ip_count", "distinct_destination_ip_count", "unique_reported_asn_count", "unique_reported_country_count", "reused_ip_count")
    return joined.select("address", *map(or_zero, names), "max_transactions_per_associated_ip", "mean_transactions_per_associated_ip", ratio(F.col("reused_ip_count"), F.col("distinct_associated_ip_count")).alias("ip_reuse_ratio"))


# Version 2: what enrichment adds


def enriched(seen: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Observations with country and system number of both ends; both must have been enriched."""
    for role in ("src", "dst"):
        seen = seen.join(enrichment.select(F.col("ip").alias(f"{role}_ip"), F.col("country_code").alias(f"{role}_country"), F.col("asn").alias(f"{role}_asn")), f"{role}_ip")
    return seen


def enriched_diversity(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    ends = rows.select(key, F.explode(F.array(F.struct(F.col("src_country").alias("c"), F.col("src_asn").alias("n")), F.struct(F.col("dst_country").alias("c"), F.col("dst_asn").alias("n")))).alias("e"))
    return distinct_counts(ends, key, {f"{prefix}_enriched_country_count": F.col("e.c"), f"{prefix}_enriched_asn_count": F.col("e.n")})


def match_rates(rows: DataFrame, key: str = "txid") -> DataFrame:
    """How often both ends agree, among observations where both are known."""
    rate = lambda what: F.avg((F.col(f"src_{what}") == F.col(f"dst_{what}")).cast("int"))  # noqa: E731  null unless both are known
    return rows.groupBy(key).agg(rate("country").alias("source_destination_country_match_rate"), rate("asn").alias("source_destination_asn_match_rate"))


def cross_endpoint_counts(rows: DataFrame, key: str = "address") -> DataFrame:
    """Distinct observations whose ends are known to differ."""
    differ = lambda what: F.when(F.col(f"src_{what}") != F.col(f"dst_{what}"), F.col("observation_id"))
    return distinct_counts(rows, key, {"associated_cross_country_observation_count": differ("country"), "associated_cross_asn_observation_count": differ("asn")})


def transaction_features_v2(s: Tables, enrichment: DataFrame) -> DataFrame:
    rows = enriched(s["network_observations"], enrichment)
    joined = transaction_features(s).join(enriched_diversity(rows, "txid", "unique"), "txid", "left").join(match_rates(rows), "txid", "left")
    names = ("unique_enriched_country_count", "unique_enriched_asn_count")
    return joined.select(*[or_zero(c) if c in names else F.col(c) for c in joined.columns])


def correlation_features_v2(s: Tables, enrichment: DataFrame, reused_from: int = 2) -> DataFrame:
    rows = s["address_transactions"].join(enriched(s["network_observations"], enrichment), "txid")
    base = correlation_features(s, reused_from)
    joined = base.join(enriched_diversity(rows, "address", "associated"), "address", "left").join(cross_endpoint_counts(rows), "address", "left")
    return joined.select(*[F.col(c) if c in base.columns else or_zero(c) for c in joined.columns])
