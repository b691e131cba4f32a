"""Lookups and features over the driver's tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from ..operators import enrich, features, lookups
from .registry import register
from .testdata import NETWORKS, canonical, with_tables

CUTOFF = datetime(2024, 1, 12, 6, 30)


def on(f):
    """A query that applies ``f`` to the canonical tables."""
    return lambda spark, sf_dir: f(canonical(spark, sf_dir))


def on_scope(f, cutoff: datetime | None = None):
    return lambda spark, sf_dir: f(features.scope(canonical(spark, sf_dir), cutoff))


def enrichment(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
    return enrich.enrich(enrich.distinct_ips(t["network_observations"]), enrich.range_table(spark, NETWORKS))


def on_enriched(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = canonical(spark, sf_dir)
        return f(features.scope(t), enrichment(spark, t))

    return run


# SQL of the relations above the canonical ones

_SIDE = "SELECT txid, count(*) AS n, sum(amount_sats) AS total FROM {0} GROUP BY txid"
SUMMARY = (
    "tx_summary",
    f"""SELECT t.txid, fee_sats, script_type, coalesce(i.n, 0) AS input_count, coalesce(o.n, 0) AS output_count, cast(coalesce(i.total, 0) AS BIGINT) AS total_input_sats,
        cast(coalesce(o.total, 0) AS BIGINT) AS total_output_sats, coalesce(s.n, 0) AS observation_count, s.first_observed_at, s.last_observed_at FROM transactions t
        LEFT JOIN ({_SIDE.format("transaction_inputs")}) i ON i.txid = t.txid LEFT JOIN ({_SIDE.format("transaction_outputs")}) o ON o.txid = t.txid
        LEFT JOIN (SELECT txid, count(*) AS n, min(observed_at) AS first_observed_at, max(observed_at) AS last_observed_at FROM network_observations GROUP BY txid) s ON s.txid = t.txid""",
)
_ENDS = ("ends", "SELECT src_ip AS ip, 'src' AS role, src_port AS port, * FROM network_observations UNION ALL SELECT dst_ip, 'dst', dst_port, * FROM network_observations")
_PAIRS = ("address_tx", "SELECT address, txid FROM transaction_inputs UNION SELECT address, txid FROM transaction_outputs")
_SEEN = ("address_seen", "SELECT p.address, n.* FROM address_tx p JOIN network_observations n ON n.txid = p.txid")
_IPS = (
    "ip_seen",
    """SELECT ip, observation_id, bool_or(role = 'src') AS is_source, bool_or(role = 'dst') AS is_destination, max(port) FILTER (role = 'src') AS sp, max(port) FILTER (role = 'dst') AS dp,
        any_value(txid) AS txid, any_value(observed_at) AS observed_at, any_value(reported_asn) AS reported_asn, any_value(reported_geo_country) AS reported_geo_country FROM ends GROUP BY ip, observation_id""",
)
EXTRA = (_ENDS, _PAIRS, _SEEN, _IPS, SUMMARY)


def sql(text: str, *more: tuple[str, str], recursive: bool = False) -> str:
    return with_tables(text, *EXTRA, *more, recursive=recursive)


def timing_sql(source: str, key: str) -> str:
    gap = "(epoch_us(observed_at) - epoch_us(lag(observed_at) OVER (PARTITION BY {0} ORDER BY observed_at, observation_id))) / 1000000.0".format(key)
    return f"""SELECT {key}, min(observed_at) AS first_observed_at, max(observed_at) AS last_observed_at, date_diff('second', min(observed_at), max(observed_at)) AS observation_span_seconds,
        round(avg(gap) + 3e-11, 9) AS mean_inter_observation_seconds, round(median(gap), 9) AS median_inter_observation_seconds, cast(round_even(min(gap), 0) AS BIGINT) AS min_inter_observation_seconds,
        cast(round_even(max(gap), 0) AS BIGINT) AS max_inter_observation_seconds, count(DISTINCT date_trunc('hour', observed_at)) AS active_hour_count
        FROM (SELECT {key}, observed_at, {gap} AS gap FROM {source}) GROUP BY {key}"""


def entropy_sql(source: str, key: str) -> str:
    one = lambda name, bucket: f"SELECT {key}, round(-sum(p * ln(p)), 9) + 0.0 AS {name} FROM (SELECT {key}, n / sum(n) OVER (PARTITION BY {key}) AS p FROM (SELECT {key}, {bucket} AS b, count(*) AS n FROM {source} GROUP BY ALL)) GROUP BY {key}"
    return f"SELECT h.{key}, hour_of_day_entropy, day_activity_entropy FROM ({one('hour_of_day_entropy', 'hour(observed_at)')}) h JOIN ({one('day_activity_entropy', 'cast(observed_at AS DATE)')}) d ON h.{key} = d.{key}"


def bursts_sql(source: str, key: str) -> str:
    counted = ", ".join(f"count(*) OVER (PARTITION BY {key} ORDER BY observed_at RANGE BETWEEN INTERVAL {s} SECOND PRECEDING AND CURRENT ROW) AS c{n}" for n, s in features.BURSTS)
    return f"SELECT {key}, " + ", ".join(f"max(c{n}) AS max_observations_{n}" for n, _ in features.BURSTS) + f" FROM (SELECT {key}, {counted} FROM {source}) GROUP BY {key}"


def values_sql(side: str, key: str, more: str, spread: bool = True) -> str:
    spreads = f", min(amount_sats) AS min_{side}_sats, round(stddev_samp(amount_sats), 2) AS {side}_value_std" if spread else ""
    return f"SELECT {key}, {more}, cast(sum(amount_sats) AS BIGINT) AS total_{side}_sats, round(avg(amount_sats), 4) AS mean_{side}_sats, max(amount_sats) AS max_{side}_sats{spreads} FROM transaction_{side}s GROUP BY {key}"


_RATE = "CASE WHEN active_hour_count > 0 THEN round(network_observation_count::DOUBLE / active_hour_count, 9) END AS observations_per_active_hour"
_ZERO = "coalesce({0}, 0) AS {0}".format
_TIMES = ", ".join(features._TIMES)


def transaction_features_sql(seen: str = "network_observations") -> str:
    return f"""SELECT t.txid, {_ZERO("input_count")}, {_ZERO("output_count")}, {_ZERO("total_input_sats")}, {_ZERO("total_output_sats")}, fee_sats, mean_input_sats, mean_output_sats, max_input_sats, max_output_sats,
        min_input_sats, min_output_sats, input_value_std, output_value_std, CASE WHEN total_input_sats > 0 THEN round(fee_sats::DOUBLE / total_input_sats, 9) END AS fee_to_input_ratio,
        {", ".join(map(_ZERO, ("network_observation_count", "unique_source_ip_count", "unique_destination_ip_count", "unique_ip_count", "unique_reported_asn_count", "unique_reported_country_count")))},
        {_TIMES}, {_ZERO("active_hour_count")}, {_RATE}, hour_of_day_entropy, day_activity_entropy, {", ".join(_ZERO(f"max_observations_{n}") for n, _ in features.BURSTS)}
        FROM transactions t LEFT JOIN ({values_sql("input", "txid", "count(*) AS input_count")}) a ON a.txid = t.txid LEFT JOIN ({values_sql("output", "txid", "count(*) AS output_count")}) b ON b.txid = t.txid
        LEFT JOIN (SELECT txid, count(*) AS network_observation_count, count(DISTINCT src_ip) AS unique_source_ip_count, count(DISTINCT dst_ip) AS unique_destination_ip_count, count(DISTINCT reported_asn) AS unique_reported_asn_count,
                   count(DISTINCT reported_geo_country) AS unique_reported_country_count FROM {seen} GROUP BY txid) c ON c.txid = t.txid
        LEFT JOIN (SELECT txid, count(DISTINCT ip) AS unique_ip_count FROM (SELECT txid, unnest([src_ip, dst_ip]) AS ip FROM {seen}) GROUP BY txid) d ON d.txid = t.txid
        LEFT JOIN ({timing_sql(seen, "txid")}) e ON e.txid = t.txid LEFT JOIN ({entropy_sql(seen, "txid")}) f ON f.txid = t.txid LEFT JOIN ({bursts_sql(seen, "txid")}) g ON g.txid = t.txid"""


#: Component sizes of the bipartite graph, by least labels handed along the edges.
COMPONENTS = (
    ("arcs", "SELECT 'a:' || address AS a, 't:' || txid AS b FROM address_tx UNION ALL SELECT 't:' || txid, 'a:' || address FROM address_tx"),
    ("reach(v, c) USING KEY (v)", "SELECT DISTINCT a, a FROM arcs UNION (SELECT arcs.a, min(reach.c) FROM arcs JOIN reach ON arcs.b = reach.v JOIN recurring.reach AS now ON now.v = arcs.a WHERE reach.c < now.c GROUP BY arcs.a)"),
    ("sized", "SELECT v, c, count(*) OVER (PARTITION BY c) AS n FROM reach"),
)

ADDRESS_SQL = f"""SELECT p.address, {", ".join(map(_ZERO, ("input_occurrence_count", "output_occurrence_count", "unique_input_tx_count", "unique_output_tx_count")))}, unique_tx_count, {_ZERO("total_input_sats")}, {_ZERO("total_output_sats")},
    mean_input_sats, mean_output_sats, max_input_sats, max_output_sats, CASE WHEN unique_output_tx_count > 0 THEN round(coalesce(unique_input_tx_count, 0)::DOUBLE / unique_output_tx_count, 9) END AS input_output_tx_ratio,
    CASE WHEN total_output_sats > 0 THEN round(coalesce(total_input_sats, 0)::DOUBLE / total_output_sats, 12) END AS input_output_value_ratio, {_ZERO("co_transaction_address_count")}, {_ZERO("network_observation_count")},
    {_TIMES}, {_ZERO("active_hour_count")}, {_RATE}, z.n AS bipartite_component_size
    FROM (SELECT address, count(*) AS unique_tx_count FROM address_tx GROUP BY address) p JOIN sized z ON z.v = 'a:' || p.address
    LEFT JOIN ({values_sql("input", "address", "count(*) AS input_occurrence_count, count(DISTINCT txid) AS unique_input_tx_count", False)}) a ON a.address = p.address
    LEFT JOIN ({values_sql("output", "address", "count(*) AS output_occurrence_count, count(DISTINCT txid) AS unique_output_tx_count", False)}) b ON b.address = p.address
    LEFT JOIN (SELECT l.address, count(DISTINCT r.address) AS co_transaction_address_count FROM address_tx l JOIN address_tx r ON l.txid = r.txid AND l.address <> r.address GROUP BY l.address) c ON c.address = p.address
    LEFT JOIN (SELECT address, count(*) AS network_observation_count FROM address_seen GROUP BY address) d ON d.address = p.address LEFT JOIN ({timing_sql("address_seen", "address")}) e ON e.address = p.address"""

IP_ROLES_SQL = """SELECT ip, count(*) FILTER (is_source) AS source_observation_count, count(*) FILTER (is_destination) AS destination_observation_count, count(*) AS total_observation_count, count(DISTINCT txid) AS unique_tx_count,
    count(DISTINCT sp) AS unique_src_port_count, count(DISTINCT dp) AS unique_dst_port_count, count(DISTINCT reported_asn) AS unique_reported_asn_count, count(DISTINCT reported_geo_country) AS unique_reported_country_count,
    (len(list_distinct(list(sp) FILTER (sp IS NOT NULL) || list(dp) FILTER (dp IS NOT NULL))))::BIGINT AS p0 FROM ip_seen GROUP BY ip"""
IP_PORTS_SQL = "SELECT ip, count(DISTINCT port) AS unique_port_count FROM (SELECT ip, unnest([sp, dp]) AS port FROM ip_seen) GROUP BY ip"
_IP_COLUMNS = "source_observation_count, destination_observation_count, total_observation_count, unique_tx_count, unique_src_port_count, unique_dst_port_count, unique_port_count, unique_reported_asn_count, unique_reported_country_count"
IP_ROLES = f"SELECT r.ip, {_IP_COLUMNS} FROM ({IP_ROLES_SQL}) r JOIN ({IP_PORTS_SQL}) q ON q.ip = r.ip"
IP_SQL = f"""SELECT r.ip, {_IP_COLUMNS}, {_TIMES}, active_hour_count, round(total_observation_count::DOUBLE / active_hour_count, 9) AS observations_per_active_hour, hour_of_day_entropy, day_activity_entropy,
    {", ".join(f"max_observations_{n}" for n, _ in features.BURSTS)} FROM ({IP_ROLES}) r JOIN ({timing_sql("ip_seen", "ip")}) e ON e.ip = r.ip JOIN ({entropy_sql("ip_seen", "ip")}) f ON f.ip = r.ip JOIN ({bursts_sql("ip_seen", "ip")}) g ON g.ip = r.ip"""

REUSE_SQL = """SELECT address, count(*) AS distinct_associated_ip_count, count(*) FILTER (n >= 2) AS reused_ip_count, max(n) AS max_transactions_per_associated_ip, round(avg(n), 9) AS mean_transactions_per_associated_ip
    FROM (SELECT address, ip, count(DISTINCT txid) AS n FROM (SELECT address, txid, unnest([src_ip, dst_ip]) AS ip FROM address_seen) GROUP BY address, ip) GROUP BY address"""
ROLES_SQL = """SELECT address, count(DISTINCT observation_id) AS network_observation_count, count(DISTINCT src_ip) AS distinct_source_ip_count, count(DISTINCT dst_ip) AS distinct_destination_ip_count,
    count(DISTINCT reported_asn) AS unique_reported_asn_count, count(DISTINCT reported_geo_country) AS unique_reported_country_count FROM address_seen GROUP BY address"""
CORRELATION_SQL = f"""SELECT p.address, {", ".join(map(_ZERO, ("network_observation_count", "distinct_associated_ip_count", "distinct_source_ip_count", "distinct_destination_ip_count", "unique_reported_asn_count", "unique_reported_country_count", "reused_ip_count")))},
    max_transactions_per_associated_ip, mean_transactions_per_associated_ip, CASE WHEN distinct_associated_ip_count > 0 THEN round(reused_ip_count::DOUBLE / distinct_associated_ip_count, 9) END AS ip_reuse_ratio
    FROM (SELECT DISTINCT address FROM address_tx) p LEFT JOIN ({ROLES_SQL}) a ON a.address = p.address LEFT JOIN ({REUSE_SQL}) b ON b.address = p.address"""

# Enrichment: IPv4 networks as ranges of integers


def _number(ip: str) -> int:
    a, b, c, d = map(int, ip.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def _range(network: str) -> tuple[int, int, int]:
    base, bits = network.split("/")
    low = _number(base)
    return low, low + (1 << (32 - int(bits))) - 1, int(bits)


ENRICHED = (
    ("nets", "SELECT * FROM (VALUES " + ", ".join("({}, {}, {}, '{}', {}, '{}', '{}')".format(*_range(n), c, a, h, n) for n, c, a, h in NETWORKS) + ") v(lo, hi, bits, country_code, asn, holder, network)"),
    ("all_ips", "SELECT src_ip AS ip FROM network_observations UNION SELECT dst_ip FROM network_observations"),
    ("ip_numbers", "SELECT ip, ((split_part(ip, '.', 1)::BIGINT * 256 + split_part(ip, '.', 2)::BIGINT) * 256 + split_part(ip, '.', 3)::BIGINT) * 256 + split_part(ip, '.', 4)::BIGINT AS num FROM all_ips"),
    ("enrichment", "SELECT i.ip, arg_max(country_code, bits) AS country_code, cast(arg_max(asn, bits) AS BIGINT) AS asn, arg_max(holder, bits) AS holder, arg_max(network, bits) AS network FROM ip_numbers i LEFT JOIN nets ON i.num BETWEEN lo AND hi GROUP BY i.ip"),
    ("rich", "SELECT n.*, s.country_code AS sc, s.asn AS sa, d.country_code AS dc, d.asn AS da FROM network_observations n JOIN enrichment s ON s.ip = n.src_ip JOIN enrichment d ON d.ip = n.dst_ip"),
)
V2_SQL = """SELECT txid, count(DISTINCT c) AS unique_enriched_country_count, count(DISTINCT a) AS unique_enriched_asn_count FROM (SELECT txid, unnest([sc, dc]) AS c, unnest([sa, da]) AS a FROM rich) GROUP BY txid"""
RATES_SQL = """SELECT txid, round(avg(CASE WHEN sc = dc THEN 1 WHEN sc <> dc THEN 0 END), 9) AS source_destination_country_match_rate, round(avg(CASE WHEN sa = da THEN 1 WHEN sa <> da THEN 0 END), 9) AS source_destination_asn_match_rate FROM rich GROUP BY txid"""
CROSS_SQL = """SELECT address, count(DISTINCT observation_id) FILTER (sc <> dc) AS associated_cross_country_observation_count, count(DISTINCT observation_id) FILTER (sa <> da) AS associated_cross_asn_observation_count FROM address_tx p JOIN rich r ON r.txid = p.txid GROUP BY address"""


def cut(text: str) -> str:
    """The same SQL over what was known at CUTOFF."""
    known = f"SELECT * FROM network_observations WHERE observed_at <= TIMESTAMP '{CUTOFF}'"

    def then(body: str) -> str:
        body = body.replace("network_observations", "seen_then")
        for name in ("transactions", "transaction_inputs", "transaction_outputs"):
            body = body.replace(f"FROM {name}", f"FROM (SELECT * FROM {name} WHERE txid IN (SELECT txid FROM seen_then))")
        return body

    return with_tables(then(text), ("seen_then", known), *[(n, then(b)) for n, b in EXTRA])


# Registration


def register_all() -> None:
    register("transaction_summary", on(lookups.transaction_summary), sql("SELECT * FROM tx_summary"))
    register("tx_lookup", on(lambda t: lookups.transaction_rows(t, "T7")), sql("""
        SELECT 'transaction' AS part, 0::BIGINT AS position, script_type AS key, fee_sats AS amount FROM transactions WHERE txid = 'T7'
        UNION ALL SELECT 'inputs', input_index, address, amount_sats FROM transaction_inputs WHERE txid = 'T7' UNION ALL SELECT 'outputs', output_index, address, amount_sats FROM transaction_outputs WHERE txid = 'T7'
        UNION ALL SELECT 'observations', epoch_us(observed_at), observation_id, NULL FROM network_observations WHERE txid = 'T7'
        UNION ALL SELECT 'provenance', r.record_index, s.source_record_id, NULL FROM transaction_sources s JOIN source_records r ON r.source_record_id = s.source_record_id WHERE s.txid = 'T7'"""))  # fmt: skip
    register("address_activity", on(lambda t: lookups.address_activity(t, "A22452")), sql("""
        SELECT 'A22452' AS address, (SELECT count(*) FROM address_tx WHERE address = 'A22452') AS transaction_count, (SELECT count(*) FROM transaction_inputs WHERE address = 'A22452') AS input_count,
               (SELECT cast(coalesce(sum(amount_sats), 0) AS BIGINT) FROM transaction_inputs WHERE address = 'A22452') AS total_input_sats, (SELECT count(*) FROM transaction_outputs WHERE address = 'A22452') AS output_count,
               (SELECT cast(coalesce(sum(amount_sats), 0) AS BIGINT) FROM transaction_outputs WHERE address = 'A22452') AS total_output_sats, min(observed_at) AS first_observed_at, max(observed_at) AS last_observed_at
        FROM network_observations WHERE txid IN (SELECT txid FROM address_tx WHERE address = 'A22452')"""))  # fmt: skip
    register("high_value", on(lookups.high_value_transactions), sql("SELECT txid, total_output_sats, fee_sats, input_count, output_count FROM tx_summary ORDER BY total_output_sats DESC, txid LIMIT 20"))
    register("high_fee", on(lookups.high_fee_transactions), sql("SELECT txid, fee_sats, total_input_sats, CASE WHEN total_input_sats > 0 THEN round(fee_sats::DOUBLE / total_input_sats, 9) END AS fee_to_input_ratio FROM tx_summary ORDER BY fee_sats DESC, txid LIMIT 20"))
    register("transaction_summaries", on(lookups.transaction_summaries), sql("SELECT * FROM tx_summary ORDER BY txid LIMIT 100"))
    register("summary_scan", on(lookups.summary_scan), sql("SELECT count(*) AS n, cast(sum(total_output_sats) AS BIGINT) AS output_sats, cast(sum(observation_count) AS BIGINT) AS observations FROM tx_summary"))
    register("ip_activity", on(lambda t: lookups.ip_activity(t, "10.0.0.7")), sql("""
        SELECT '10.0.0.7' AS ip, count(DISTINCT observation_id) AS observation_count, count(DISTINCT txid) AS transaction_count, count(*) FILTER (role = 'src') AS source_count, count(*) FILTER (role = 'dst') AS destination_count,
               list_sort(list(DISTINCT port)) AS ports, coalesce(list_sort(list(DISTINCT reported_asn) FILTER (reported_asn IS NOT NULL)), []) AS asns, list_sort(list(DISTINCT reported_geo_country)) AS countries,
               min(observed_at) AS first_observed_at, max(observed_at) AS last_observed_at FROM ends WHERE ip = '10.0.0.7'"""))  # fmt: skip
    register("asn_activity", on(lambda t: lookups.asn_activity(t, 64515)), sql("""
        SELECT 64515::BIGINT AS asn, count(*) AS observation_count, count(DISTINCT txid) AS transaction_count, min(observed_at) AS first_observed_at, max(observed_at) AS last_observed_at,
               (SELECT count(DISTINCT ip) FROM ends WHERE reported_asn = 64515) AS ip_count FROM network_observations WHERE reported_asn = 64515"""))  # fmt: skip
    bucket = "SELECT date_trunc('{0}', observed_at) AS bucket_start, count(*) AS observation_count, count(DISTINCT txid) AS transaction_count, count(DISTINCT src_ip) AS source_ip_count FROM network_observations {1} GROUP BY 1".format
    for unit in lookups.BUCKETS:
        register(f"temporal_{unit}", on(lambda t, u=unit: lookups.temporal_activity(t, u)), sql(bucket(unit, "").replace("date_trunc('day', observed_at)", "cast(date_trunc('day', observed_at) AS TIMESTAMP)")))
    span = (datetime(2024, 1, 3), datetime(2024, 1, 5, 12))
    register("temporal_range", on(lambda t: lookups.temporal_activity(t, "hour", *span)), sql(bucket("hour", f"WHERE observed_at >= TIMESTAMP '{span[0]}' AND observed_at < TIMESTAMP '{span[1]}'")))

    seen = lambda f: on_scope(lambda s: f(s["network_observations"], "txid"))
    register("tx_value_stats", on_scope(lambda s: features.side_values(s["transaction_inputs"], "txid", "input", {"input_count": features.F.count("*")})), sql(values_sql("input", "txid", "count(*) AS input_count")))
    register("tx_gaps", seen(features.timing), sql(timing_sql("network_observations", "txid")))
    register("tx_entropy", seen(features.entropies), sql(entropy_sql("network_observations", "txid")))
    register("tx_bursts", seen(features.bursts), sql(bursts_sql("network_observations", "txid")))
    register("tx_features", on_scope(features.transaction_features), sql(transaction_features_sql()))
    register("co_transaction_count", on_scope(lambda s: features.co_transaction_counts(s["address_transactions"])), sql("SELECT l.address, count(DISTINCT r.address) AS co_transaction_address_count FROM address_tx l JOIN address_tx r ON l.txid = r.txid AND l.address <> r.address GROUP BY l.address"))
    register("address_time", on_scope(lambda s: features.timing(s["address_observations"], "address")), sql(timing_sql("address_seen", "address")))
    register("address_features", on_scope(features.address_features), sql(ADDRESS_SQL, *COMPONENTS, recursive=True))
    register("ip_roles", on_scope(lambda s: features.ip_role_counts(s["ip_observations"])), sql(IP_ROLES))
    register("ip_entropy", on_scope(lambda s: features.entropies(s["ip_observations"], "ip")), sql(entropy_sql("ip_seen", "ip")))
    register("ip_bursts", on_scope(lambda s: features.bursts(s["ip_observations"], "ip")), sql(bursts_sql("ip_seen", "ip")))
    register("ip_features", on_scope(features.ip_features), sql(IP_SQL))
    register("correlation_ip_reuse", on_scope(features.ip_reuse), sql(REUSE_SQL))
    register("correlation_features", on_scope(features.correlation_features), sql(CORRELATION_SQL))
    register("cutoff_tx_features", on_scope(features.transaction_features, CUTOFF), cut(transaction_features_sql()))
    register("cutoff_correlation_features", on_scope(features.correlation_features, CUTOFF), cut(CORRELATION_SQL))

    register("prefix_lookup", lambda spark, d: enrichment(spark, canonical(spark, d)).select("ip", "country_code", "asn", "holder", "network"), sql("SELECT * FROM enrichment", *ENRICHED))
    register("enriched_diversity", on_enriched(lambda s, e: features.enriched_diversity(features.enriched(s["network_observations"], e), "txid", "unique")), sql(V2_SQL, *ENRICHED))
    register("match_rates", on_enriched(lambda s, e: features.match_rates(features.enriched(s["network_observations"], e))), sql(RATES_SQL, *ENRICHED))
    register("cross_endpoint_counts", on_enriched(lambda s, e: features.cross_endpoint_counts(s["address_transactions"].join(features.enriched(s["network_observations"], e), "txid"))), sql(CROSS_SQL, *ENRICHED))
    register("tx_features_v2", on_enriched(features.transaction_features_v2), sql(f"""SELECT b.*, coalesce(unique_enriched_country_count, 0) AS unique_enriched_country_count, coalesce(unique_enriched_asn_count, 0) AS unique_enriched_asn_count,
        source_destination_country_match_rate, source_destination_asn_match_rate FROM ({transaction_features_sql()}) b LEFT JOIN ({V2_SQL}) d ON d.txid = b.txid LEFT JOIN ({RATES_SQL}) r ON r.txid = b.txid""", *ENRICHED))  # fmt: skip
    register("correlation_features_v2", on_enriched(features.correlation_features_v2), sql(f"""SELECT b.*, coalesce(associated_enriched_country_count, 0) AS associated_enriched_country_count, coalesce(associated_enriched_asn_count, 0) AS associated_enriched_asn_count,
        coalesce(associated_cross_country_observation_count, 0) AS associated_cross_country_observation_count, coalesce(associated_cross_asn_observation_count, 0) AS associated_cross_asn_observation_count FROM ({CORRELATION_SQL}) b
        LEFT JOIN (SELECT address, count(DISTINCT c) AS associated_enriched_country_count, count(DISTINCT a) AS associated_enriched_asn_count FROM (SELECT address, unnest([sc, dc]) AS c, unnest([sa, da]) AS a FROM address_tx p JOIN rich r ON r.txid = p.txid) GROUP BY address) d ON d.address = b.address
        LEFT JOIN ({CROSS_SQL}) c ON c.address = b.address""", *ENRICHED))  # fmt: skip
