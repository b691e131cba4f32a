"""Integrity, graph, entity and evaluation queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entities, features, graph, integrity, metrics
from .analytics import CUTOFF, ENRICHED, IP_SQL, enrichment, on, sql
from .registry import register
from .testdata import canonical

ADDRESS = "A22452"


# A damaged copy of the canonical tables, so that every check has something to find


def damaged(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Adds orphans, repeated keys and negative values by rule."""
    inputs, seen = t["transaction_inputs"], t["network_observations"]
    shifted = inputs.filter("input_index = 1").select(F.concat(F.lit("X"), "txid").alias("txid"), (-F.col("input_index")).alias("input_index"), "address", (-F.col("amount_sats")).alias("amount_sats"))
    return t | {
        "transaction_inputs": inputs.union(shifted).union(inputs.filter("amount_sats % 7 = 0")),
        "transactions": t["transactions"].filter("txid NOT LIKE '%77'").withColumn("fee_sats", F.when(F.col("txid").like("%5"), -F.col("fee_sats")).otherwise(F.col("fee_sats"))),
        "network_observations": seen.union(seen.filter("src_port = 1025")),
        "source_records": t["source_records"].filter("record_index % 10 <> 3"),
    }


DAMAGED = (
    ("d_inputs", "SELECT * FROM transaction_inputs UNION ALL SELECT 'X' || txid, -input_index, address, -amount_sats FROM transaction_inputs WHERE input_index = 1 UNION ALL SELECT * FROM transaction_inputs WHERE amount_sats % 7 = 0"),
    ("d_tx", "SELECT txid, CASE WHEN txid LIKE '%5' THEN -fee_sats ELSE fee_sats END AS fee_sats FROM transactions WHERE txid NOT LIKE '%77'"),
    ("d_seen", "SELECT * FROM network_observations UNION ALL SELECT * FROM network_observations WHERE src_port = 1025"),
    ("d_records", "SELECT * FROM source_records WHERE record_index % 10 <> 3"),
)
_SQL_NAME = {"transaction_inputs": "d_inputs", "transactions": "d_tx", "network_observations": "d_seen", "source_records": "d_records"}


def _orphans_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{code}' AS code, count(*) AS breaches FROM {_SQL_NAME.get(c, c)} WHERE {k} NOT IN (SELECT {pk} FROM {_SQL_NAME.get(p, p)})" for code, (c, k, p, pk) in integrity.ORPHANS.items())


def _excess_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{code}' AS code, count(*) - count(DISTINCT ({', '.join(keys)})) AS breaches FROM {_SQL_NAME.get(n, n)}" for code, (n, keys) in integrity.KEYS.items())


def _negative_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{code}' AS code, count(*) FILTER ({c} < 0) AS breaches FROM {_SQL_NAME.get(n, n)}" for code, (n, c) in integrity.NOT_NEGATIVE.items())


# The property graph of the damaged tables against that of the canonical ones

_OBSERVED = "observation_id, observed_at, src_port, dst_port, reported_geo_country, reported_asn, source_record_id"


def _graph_relations(prefix: str, tx: str, inputs: str, seen: str) -> tuple[tuple[str, str], ...]:
    """Nodes and edges as named relations."""
    return (
        (f"{prefix}_transaction", tx), (f"{prefix}_address", f"SELECT address FROM {inputs} UNION SELECT address FROM transaction_outputs"), (f"{prefix}_ip", f"SELECT src_ip AS ip FROM {seen} UNION SELECT dst_ip FROM {seen}"),
        (f"{prefix}_observation", f"SELECT {_OBSERVED} FROM {seen}"), (f"{prefix}_spent_in", f"SELECT address, txid, input_index, amount_sats FROM {inputs}"),
        (f"{prefix}_created_output", "SELECT txid, address, output_index, amount_sats FROM transaction_outputs"), (f"{prefix}_observed_transaction", f"SELECT observation_id, txid FROM {seen}"),
        (f"{prefix}_source_ip", f"SELECT observation_id, src_ip AS ip FROM {seen}"), (f"{prefix}_destination_ip", f"SELECT observation_id, dst_ip AS ip FROM {seen}"),
    )


GRAPHS = (
    *_graph_relations("kept", "SELECT txid, fee_sats, script_type FROM transactions", "transaction_inputs", "network_observations"),
    *_graph_relations("torn", "SELECT txid, CASE WHEN txid LIKE '%5' THEN -fee_sats ELSE fee_sats END AS fee_sats, script_type FROM transactions WHERE txid NOT LIKE '%77'", "d_inputs", "d_seen"),
)


def _graph_checks_sql() -> str:
    key, ends = graph._KEYS, graph._ENDS
    parts = [f"SELECT 'DUPLICATE_{k.upper()}_ID' AS code, count(*) - count(DISTINCT {c}) AS breaches FROM torn_{k}" for k, c in key.items()]
    parts += [f"SELECT 'ORPHAN_{name}_{side}', count(*) FROM torn_{name.lower()} e ANTI JOIN torn_{kind} n ON n.{key[kind]} = e.{key[kind]}" for name, kinds in ends.items() for side, kind in zip(("START", "END"), kinds, strict=True)]
    counted = " ".join(f"LEFT JOIN (SELECT observation_id, count(*) AS n FROM torn_{name} GROUP BY 1) {name} ON {name}.observation_id = o.observation_id" for name in ("observed_transaction", "source_ip", "destination_ip"))
    parts.append(f"SELECT 'INVALID_OBSERVATION_RELATIONSHIP_CARDINALITY', count(*) FROM torn_observation o {counted} WHERE coalesce(observed_transaction.n, 0) <> 1 OR coalesce(source_ip.n, 0) <> 1 OR coalesce(destination_ip.n, 0) <> 1")
    differ = lambda n: f"(SELECT count(*) FROM ((FROM kept_{n} EXCEPT ALL FROM torn_{n}) UNION ALL (FROM torn_{n} EXCEPT ALL FROM kept_{n})))"
    parts += [f"SELECT '{k.upper()}_VALUE_MISMATCH', {differ(k)}" for k in key] + [f"SELECT '{k}_SET_MISMATCH', {differ(k.lower())}" for k in ends]
    return " UNION ALL ".join(parts)


# Entities

STARS = (
    ("spent", "SELECT DISTINCT txid, address FROM transaction_inputs"),
    ("stars", "SELECT txid, min(address) OVER (PARTITION BY txid) AS anchor, address AS other FROM spent QUALIFY anchor <> other"),
    ("out_stats", "SELECT txid, count(DISTINCT address) AS outs, avg(amount_sats) AS mean, count(*) AS n FROM transaction_outputs GROUP BY txid"),
    ("equals", "SELECT txid, count(*) FILTER (c > 1) AS groups, max(c) AS most FROM (SELECT txid, amount_sats, count(*) AS c FROM transaction_outputs GROUP BY ALL) GROUP BY txid"),
    ("near", "SELECT o.txid, count(*) FILTER (amount_sats BETWEEN mean * 0.5 AND mean * 1.5) / max(n)::DOUBLE AS balanced FROM transaction_outputs o JOIN out_stats s ON s.txid = o.txid WHERE mean <> 0 GROUP BY o.txid"),
    ("detector", """SELECT t.txid, coalesce(i.k, 0) AS distinct_input_count, coalesce(outs, 0) AS distinct_output_count, coalesce(groups, 0) AS equal_output_group_count, coalesce(most, 0) AS max_equal_output_multiplicity,
        coalesce(round(most / n::DOUBLE, 9), 0) AS equal_output_fraction, coalesce(round(balanced, 9), 0) AS balanced_output_fraction, coalesce(i.k >= 3 AND outs >= 3 AND most >= 2 AND 2 * most >= n, false) AS suspected FROM transactions t
        LEFT JOIN (SELECT txid, count(*) AS k FROM spent GROUP BY txid) i ON i.txid = t.txid LEFT JOIN out_stats s ON s.txid = t.txid LEFT JOIN equals e ON e.txid = t.txid LEFT JOIN near b ON b.txid = t.txid"""),
    ("evidence", "SELECT anchor, other, s.txid, suspected AS suppressed FROM stars s JOIN detector d ON d.txid = s.txid"),
    ("accepted", "SELECT DISTINCT anchor, other, txid FROM evidence WHERE NOT suppressed"),
    ("arcs2", "SELECT anchor AS a, other AS b FROM accepted UNION SELECT other, anchor FROM accepted"),
    ("ereach(v, c) USING KEY (v)", "SELECT DISTINCT a, a FROM arcs2 UNION (SELECT arcs2.a, min(ereach.c) FROM arcs2 JOIN ereach ON arcs2.b = ereach.v JOIN recurring.ereach AS now ON now.v = arcs2.a WHERE ereach.c < now.c GROUP BY arcs2.a)"),
    ("members", "SELECT p.address, coalesce(c, p.address) AS candidate FROM (SELECT DISTINCT address FROM address_tx) p LEFT JOIN ereach ON v = p.address"),
    ("ip_spent", "SELECT DISTINCT s.address, n.src_ip FROM spent s JOIN network_observations n ON n.txid = s.txid"),
    ("ip_stars", "SELECT src_ip, min(address) OVER (PARTITION BY src_ip) AS anchor, address AS other FROM ip_spent QUALIFY anchor <> other"),
    ("pairs", "SELECT anchor, other, count(*) AS sources FROM accepted GROUP BY ALL"),
    ("homes", "SELECT p.*, m.candidate FROM pairs p JOIN members m ON m.address = p.anchor"),
)

MEMBERSHIP_SQL = """SELECT m.candidate, m.address, round(CASE WHEN t.total IS NULL THEN 1 ELSE coalesce(o.own, 0) / t.total::DOUBLE END, 9) AS membership_support, m.address = m.candidate OR d.other IS NOT NULL AS direct_to_anchor,
    NOT (m.address = m.candidate OR d.other IS NOT NULL) AS transitive_only, coalesce(o.own, 0) AS accepted_evidence_count FROM members m
    LEFT JOIN (SELECT candidate, count(DISTINCT txid) AS total FROM accepted a JOIN members x ON x.address = a.anchor GROUP BY candidate) t ON t.candidate = m.candidate
    LEFT JOIN (SELECT v, count(DISTINCT txid) AS own FROM (SELECT unnest([anchor, other]) AS v, txid FROM accepted) GROUP BY v) o ON o.v = m.address
    LEFT JOIN (SELECT DISTINCT anchor, other FROM accepted) d ON d.anchor = m.candidate AND d.other = m.address"""


def candidates(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    evidence = entities.cospend_evidence(t, entities.collaborative_detector(t)).cache()
    members = entities.memberships(entities.all_addresses(t), evidence)
    return members, evidence, entities.shared_ip_evidence(t)


# Evaluation


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored rows: truth, a prediction from the value, and a probability."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    value = F.col("value")
    predicted = F.when(value < 5, "view").when(value < 12, "click").when(value < 25, "error").otherwise("purchase")
    return e.select("event_id", "ts", "user_id", "value", F.col("event_type").alias("truth"), predicted.alias("predicted"), F.least(value / 100, F.lit(1.0)).alias("p"), (F.col("user_id") % 3).alias("intensity"))


PREDICTIONS = ("scored", """SELECT event_id, ts, user_id, value, event_type AS truth, CASE WHEN value < 5 THEN 'view' WHEN value < 12 THEN 'click' WHEN value < 25 THEN 'error' ELSE 'purchase' END AS predicted,
    least(value / 100, 1.0) AS p, user_id % 3 AS intensity FROM events""")  # fmt: skip


def positive():
    return F.col("truth") == "error"


CLASSES_SQL = """SELECT label, CASE WHEN named > 0 THEN tp / named::DOUBLE ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0 END AS recall, 2 * tp / (named + support)::DOUBLE AS f1, support
    FROM (SELECT label, count(*) FILTER (side = 't') AS support, count(*) FILTER (side = 'p') AS named, count(*) FILTER (side = 't' AND truth = predicted) AS tp
          FROM (SELECT truth AS label, 't' AS side, truth, predicted FROM scored UNION ALL SELECT predicted, 'p', truth, predicted FROM scored) GROUP BY label)"""

CANDIDATE_MODELS = (("lr", 0.61, 0.40, 0.30, 0.52, 0.02, 3.5, 0.1, 1e5, 0.9, 1.0), ("rf", 0.60, 0.45, 0.33, 0.50, 0.03, 9.4, 1.4, 8e6, 0.6, 0.9), ("gb", 0.585, 0.5, 0.35, 0.49, 0.01, 6.1, 1.2, 2e6, 0.4, 0.8), ("if", 0.4, 0.1, 0.1, 0.9, 0.2, 1.0, 1.0, 1e5, 0.2, 0.9))
CANDIDATE_COLUMNS = ("name", "macro_f1", "minimum_recall", "weak_recall", "brier", "f1_std", "train_seconds", "infer_seconds", "bytes", "explainability", "simplicity")


def register_all() -> None:
    register("orphan_checks", on(lambda t: integrity.orphan_checks(damaged(t))), sql(_orphans_sql(), *DAMAGED))
    register("duplicate_checks", on(lambda t: integrity.duplicate_checks(damaged(t))), sql(_excess_sql(), *DAMAGED))
    register("negative_checks", on(lambda t: integrity.negative_checks(damaged(t))), sql(_negative_sql(), *DAMAGED))
    keys = ("txid", "input_index", "address", "amount_sats")
    both = lambda op: f"SELECT {', '.join(keys)}, 'left' AS side FROM (SELECT * FROM transaction_inputs EXCEPT {op} SELECT * FROM d_inputs) UNION ALL SELECT {', '.join(keys)}, 'right' FROM (SELECT * FROM d_inputs EXCEPT {op} SELECT * FROM transaction_inputs)"
    register("set_difference_checks", on(lambda t: integrity.set_difference(t["transaction_inputs"], damaged(t)["transaction_inputs"])), sql(both(""), *DAMAGED))
    register("bag_difference_checks", on(lambda t: integrity.bag_difference(t["transaction_inputs"], damaged(t)["transaction_inputs"])), sql(both("ALL"), *DAMAGED))
    register("feature_checks", on(lambda t: integrity.feature_checks("IP", features.ip_features(features.scope(t)), "ip", t["network_observations"].select(F.col("src_ip").alias("ip")), CUTOFF)), sql(f"""
        SELECT 'DUPLICATE_IP_FEATURE' AS code, count(ip) - count(DISTINCT ip) AS breaches FROM feats UNION ALL SELECT 'UNKNOWN_IP_FEATURE', count(*) FROM feats WHERE ip NOT IN (SELECT src_ip FROM network_observations)
        UNION ALL SELECT 'NEGATIVE_IP_VALUE', 0 UNION ALL SELECT 'NONFINITE_IP_VALUE', 0 UNION ALL SELECT 'IP_RATIO_OUT_OF_RANGE', 0
        UNION ALL SELECT 'IP_AFTER_CUTOFF', count(*) FROM feats WHERE last_observed_at > TIMESTAMP '{CUTOFF}' OR first_observed_at > TIMESTAMP '{CUTOFF}'""", ("feats", IP_SQL)))  # fmt: skip
    register("enrichment_checks", lambda spark, d: integrity.enrichment_checks(enrichment(spark, t := canonical(spark, d)), t["network_observations"].select(F.col("src_ip").alias("ip"))), sql("""
        SELECT 'DUPLICATE_ENRICHMENT_IP' AS code, count(*) - count(DISTINCT ip) AS breaches FROM enrichment
        UNION ALL SELECT 'CANONICAL_IP_SET_MISMATCH', count(*) FROM (SELECT ip FROM enrichment EXCEPT SELECT src_ip FROM network_observations)
        UNION ALL SELECT 'INVALID_COUNTRY_VALUE', count(*) FROM enrichment WHERE NOT regexp_full_match(country_code, '[A-Z]{2}') UNION ALL SELECT 'INVALID_ASN_VALUE', count(*) FROM enrichment WHERE asn < 0 OR asn > 4294967295
        UNION ALL SELECT 'COUNTRY_FOUND_INCONSISTENT', 0 UNION ALL SELECT 'ASN_FOUND_INCONSISTENT', 0""", *ENRICHED))  # fmt: skip

    register("graph_nodes", on(graph.node_list), sql("""SELECT 'transaction' AS kind, txid AS id FROM transactions UNION ALL SELECT DISTINCT 'address', address FROM address_tx
        UNION ALL SELECT DISTINCT 'ip', ip FROM ends UNION ALL SELECT 'observation', observation_id FROM network_observations"""))  # fmt: skip
    edge_sql = """SELECT 'SPENT_IN' AS type, 'address' AS src_kind, address AS src, 'transaction' AS dst_kind, txid AS dst FROM transaction_inputs UNION ALL SELECT 'CREATED_OUTPUT', 'transaction', txid, 'address', address FROM transaction_outputs
        UNION ALL SELECT 'OBSERVED_TRANSACTION', 'observation', observation_id, 'transaction', txid FROM network_observations UNION ALL SELECT 'SOURCE_IP', 'observation', observation_id, 'ip', src_ip FROM network_observations
        UNION ALL SELECT 'DESTINATION_IP', 'observation', observation_id, 'ip', dst_ip FROM network_observations"""
    register("graph_edges", on(graph.edge_list), sql(edge_sql))
    register("tx_neighborhood", on(lambda t: graph.transaction_neighborhood(t, "T7")), sql("""SELECT 'input' AS relation, address AS id, input_index AS position, amount_sats FROM transaction_inputs WHERE txid = 'T7'
        UNION ALL SELECT 'output', address, output_index, amount_sats FROM transaction_outputs WHERE txid = 'T7' UNION ALL SELECT 'observation', observation_id, NULL, NULL FROM network_observations WHERE txid = 'T7'
        UNION ALL SELECT 'source', src_ip, NULL, NULL FROM network_observations WHERE txid = 'T7' UNION ALL SELECT 'destination', dst_ip, NULL, NULL FROM network_observations WHERE txid = 'T7'"""))  # fmt: skip
    register("address_uses", on(lambda t: graph.address_uses(t, ADDRESS)), sql(f"SELECT txid, 'input' AS role, input_index AS position, amount_sats FROM transaction_inputs WHERE address = '{ADDRESS}' UNION ALL SELECT txid, 'output', output_index, amount_sats FROM transaction_outputs WHERE address = '{ADDRESS}'"))
    register("ip_observation_roles", on(lambda t: graph.ip_observation_roles(t, "10.0.0.7")), sql("SELECT CASE role WHEN 'src' THEN 'source' ELSE 'destination' END AS role, observation_id, observed_at, src_ip, dst_ip, src_port, dst_port, txid, source_record_id FROM ends WHERE ip = '10.0.0.7'"))
    register("bounded_path", on(lambda t: graph.shortest_path(t, ("address", ADDRESS), ("ip", "192.168.1.41"), 8).select("source", "target", "length")), sql(f"""
        SELECT 'address:{ADDRESS}' AS source, v AS target, d AS length FROM steps WHERE v = 'ip:192.168.1.41'""", ("all_edges", edge_sql),
        ("ways", "SELECT src_kind || ':' || src AS a, dst_kind || ':' || dst AS b FROM all_edges UNION SELECT dst_kind || ':' || dst, src_kind || ':' || src FROM all_edges"),
        ("steps(v, d) USING KEY (v)", f"SELECT 'address:{ADDRESS}', 0::BIGINT UNION (SELECT b, min(d) + 1 FROM ways JOIN steps ON a = v WHERE d < 8 AND b NOT IN (SELECT v FROM recurring.steps) GROUP BY b)"), recursive=True))
    register("wcc_count", on(graph.component_count), sql("SELECT count(*) AS components, max(n) AS largest, cast(sum(n) AS BIGINT) AS vertices FROM (SELECT c, count(*) AS n FROM reach GROUP BY c)", *_components(), recursive=True))
    register("wcc_sizes", on(lambda t: features.component_sizes(features.scope(t)["address_transactions"])), sql("SELECT v[3:] AS address, n AS bipartite_component_size FROM sized WHERE v LIKE 'a:%'", *_components(), recursive=True))
    register("graph_checks", on(lambda t: graph.graph_checks(t, graph.nodes(damaged(t)), graph.edges(damaged(t)))), sql(_graph_checks_sql(), *DAMAGED, *GRAPHS))

    register("collaborative_detector", on(entities.collaborative_detector), sql("SELECT * FROM detector", *STARS))
    register("star_pairs", on(lambda t: entities.star_pairs(t["transaction_inputs"], "txid")), sql("SELECT * FROM stars", *STARS))
    register("cospend_evidence", on(lambda t: entities.cospend_evidence(t, entities.collaborative_detector(t))), sql("SELECT * FROM evidence", *STARS))
    register("shared_ip_evidence", on(entities.shared_ip_evidence), sql("SELECT * FROM ip_stars", *STARS))
    register("candidate_memberships", on(lambda t: entities.candidate_memberships(*candidates(t)[:2])), sql(MEMBERSHIP_SQL, *STARS, recursive=True))
    register("candidate_entities", on(lambda t: entities.candidate_entities(*candidates(t)).select("candidate", "member_count", "strong_evidence_edge_count", "supporting_evidence_count", "merge_transaction_count", "edge_density", "minimum_degree", "transitive_only_member_count")), sql("""
        SELECT s.candidate, s.member_count, coalesce(e.n, 0) AS strong_evidence_edge_count, coalesce(u.n, 0) AS supporting_evidence_count, coalesce(g.n, 0) AS merge_transaction_count,
            round(CASE WHEN member_count > 1 THEN e.n / (member_count * (member_count - 1) / 2.0) ELSE 0 END, 9) AS edge_density, coalesce(minimum_degree, 0) AS minimum_degree, coalesce(k.n, 0) AS transitive_only_member_count
        FROM (SELECT candidate, count(*) AS member_count FROM members GROUP BY candidate) s LEFT JOIN (SELECT candidate, count(*) AS n FROM homes GROUP BY candidate) e ON e.candidate = s.candidate
        LEFT JOIN (SELECT candidate, count(DISTINCT txid) AS n FROM accepted a JOIN members m ON m.address = a.anchor GROUP BY candidate) g ON g.candidate = s.candidate
        LEFT JOIN (SELECT candidate, min(d) AS minimum_degree FROM (SELECT candidate, v, count(*) AS d FROM (SELECT candidate, unnest([anchor, other]) AS v FROM homes) GROUP BY ALL) GROUP BY candidate) i ON i.candidate = s.candidate
        LEFT JOIN (SELECT c AS candidate, count(*) AS n FROM (SELECT a.candidate AS c, i.* FROM ip_stars i JOIN members a ON a.address = i.anchor UNION ALL
                   SELECT b.candidate, i.* FROM ip_stars i JOIN members a ON a.address = i.anchor JOIN members b ON b.address = i.other WHERE a.candidate <> b.candidate) GROUP BY c) u ON u.candidate = s.candidate
        LEFT JOIN (SELECT candidate, count(*) FILTER (transitive_only) AS n FROM memberships GROUP BY candidate) k ON k.candidate = s.candidate""", *STARS, ("memberships", MEMBERSHIP_SQL), recursive=True))  # fmt: skip
    register("fragile_bridges", on(lambda t: graph.bridges(candidates(t)[1].filter("NOT suppressed").select(F.col("anchor").alias("a"), F.col("other").alias("b")))))
    register("cooccurrence_weights", on(entities.cooccurrence_weights), sql("SELECT l.address AS a, r.address AS b, count(*) AS weight FROM spent l JOIN spent r ON l.txid = r.txid AND l.address < r.address GROUP BY ALL", *STARS))

    customers = lambda f: lambda spark, d: f(spark.read.parquet(f"{d}/customer.parquet"), "c_nationkey", "c_mktsegment")
    cells = "SELECT t, p, n, (sum(n) OVER (PARTITION BY t))::BIGINT AS tn, (sum(n) OVER (PARTITION BY p))::BIGINT AS pn FROM (SELECT c_nationkey AS t, c_mktsegment AS p, count(*) AS n FROM customer GROUP BY ALL)"
    register("clustering_metrics", customers(entities.clustering_metrics), f"""WITH cells AS ({cells}), s AS (SELECT sum(n * (n - 1) / 2) AS tp, sum(n) AS total, sum(n * n / pn::DOUBLE) AS bp, sum(n * n / tn::DOUBLE) AS br FROM cells),
        a AS (SELECT sum(tn * (tn - 1) / 2) AS x, avg((k > 1)::INT) AS f FROM (SELECT t, max(tn) AS tn, count(*) AS k FROM cells GROUP BY t)), b AS (SELECT sum(pn * (pn - 1) / 2) AS y, avg((k > 1)::INT) AS o, count(*) AS c FROM (SELECT p, max(pn) AS pn, count(*) AS k FROM cells GROUP BY p))
        SELECT round(tp / y, 9) AS pairwise_precision, round(tp / x, 9) AS pairwise_recall, round(2 * (tp / y) * (tp / x) / (tp / y + tp / x), 9) AS pairwise_f1, round(bp / total, 9) AS b_cubed_precision, round(br / total, 9) AS b_cubed_recall,
        round(2 * (bp / total) * (br / total) / (bp / total + br / total), 9) AS b_cubed_f1, round((tp - x * y / (total * (total - 1) / 2)) / ((x + y) / 2 - x * y / (total * (total - 1) / 2)), 9) AS adjusted_rand_index,
        round(o, 9) AS overmerged_candidate_rate, round(f, 9) AS fragmented_entity_rate, c AS candidate_count FROM s, a, b""")  # fmt: skip
    register("per_entity_overlap", customers(entities.per_entity_overlap), f"""WITH cells AS ({cells}) SELECT t::BIGINT AS truth_entity, max(tn) AS address_count, arg_max(p, n * 1000000 + r) AS best_candidate, max(n) AS best_overlap,
        round(arg_max(n / pn::DOUBLE, n * 1000000 + r), 9) AS precision, round(max(n) / max(tn)::DOUBLE, 9) AS recall, count(*) AS fragment_count FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY p) AS r FROM cells) GROUP BY t""")  # fmt: skip

    scored = lambda f: lambda spark, d: f(predictions(spark, d))
    one = lambda text: f"WITH {PREDICTIONS[0]} AS ({PREDICTIONS[1]}) {text}"
    register("temporal_split", scored(lambda r: metrics.temporal_split(r, "ts", "event_id").select("event_id", "part")), one("""SELECT event_id, CASE WHEN ts <= (SELECT max(ts) FROM k WHERE i <= 0.7 * n) THEN 'train' WHEN ts <= (SELECT max(ts) FROM k WHERE i <= greatest(0.85 * n, 0.7 * n + 1)) THEN 'validation' ELSE 'test' END AS part
        FROM k""").replace(") SELECT event_id, CASE", "), k AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS i, count(*) OVER () AS n FROM scored) SELECT event_id, CASE"))  # fmt: skip
    register("constant_columns", scored(lambda r: metrics.constant_columns(r.withColumn("zero", F.lit(0)), ["user_id", "value", "intensity", "zero"])), one("SELECT 'user_id' AS \"column\", min(user_id) = max(user_id) AS constant FROM scored UNION ALL SELECT 'value', min(value) = max(value) FROM scored UNION ALL SELECT 'intensity', min(intensity) = max(intensity) FROM scored UNION ALL SELECT 'zero', true"))
    register("group_split", scored(lambda r: metrics.split_audit(metrics.group_split(r, "user_id"), "user_id", "ts", "truth")))
    register("stratified_split", scored(lambda r: metrics.stratified_split(r, "truth", "event_id").groupBy("truth", "part").count()))
    register("average_precision", scored(lambda r: metrics.average_precision(r, "value", positive(), "event_id")), one("SELECT round(avg(hits / i::DOUBLE), 9) AS average_precision, count(*) AS positives FROM (SELECT truth, row_number() OVER w AS i, sum((truth = 'error')::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS hits FROM scored WINDOW w AS (ORDER BY value DESC, event_id)) WHERE truth = 'error'"))
    register("roc_auc", scored(lambda r: metrics.roc_auc(r, "value", positive())), one("SELECT round((sum(r) FILTER (y) - max(np) * (max(np) + 1) / 2.0) / (max(np) * (max(n) - max(np))), 9) AS roc_auc FROM (SELECT truth = 'error' AS y, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r, count(*) FILTER (truth = 'error') OVER () AS np, count(*) OVER () AS n FROM scored)"))
    register("top_budget_capture", scored(lambda r: metrics.top_budget(r, "value", positive(), "event_id")), one("SELECT p::BIGINT AS percent, k::BIGINT AS row_count, round(h / a::DOUBLE, 9) AS capture, round(h / k::DOUBLE, 9) AS precision FROM (SELECT p, k, count(*) FILTER (y AND i <= k) AS h, count(*) FILTER (y) AS a FROM (SELECT p, y, i, greatest(1, ceil(n * p / 100.0)) AS k FROM (SELECT truth = 'error' AS y, row_number() OVER (ORDER BY value DESC, event_id) AS i, count(*) OVER () AS n FROM scored), (SELECT unnest([1, 5, 10]) AS p)) GROUP BY p, k)"))
    register("confusion_matrix", scored(lambda r: metrics.confusion_matrix(r, "truth", "predicted")), one("SELECT truth, predicted, count(*) AS n FROM scored GROUP BY ALL"))
    register("class_metrics", scored(lambda r: metrics.class_metrics(r, "truth", "predicted")), one("SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM (" + CLASSES_SQL + ")"))
    register("f1_averages", scored(lambda r: metrics.averages(metrics.class_metrics(r, "truth", "predicted"))), one("SELECT round(avg(f1), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1, round(avg(recall) FILTER (support > 0), 9) AS balanced_accuracy FROM (" + CLASSES_SQL + ")"))
    register("brier_score", scored(lambda r: metrics.probability_scores(r, positive(), F.col("p"))), one("SELECT round(avg((p - y) ** 2), 9) AS brier, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 9) AS log_loss FROM (SELECT p, (truth = 'error')::INT AS y, greatest(least(p, 1 - 1e-15), 1e-15) AS q FROM scored)"))
    register("recall_by_group", scored(lambda r: metrics.recall_by_group(r, "truth", "predicted", "intensity")), one("SELECT truth, intensity::BIGINT AS intensity, round(avg((truth = predicted)::INT), 9) AS recall, count(*) AS support FROM scored GROUP BY ALL"))
    register("score_summary", scored(lambda r: metrics.score_summary(r, "value", "truth")), one("SELECT truth, count(value) AS n, min(value) AS least, round(avg(value), 9) AS mean, round(median(value), 9) AS median, round(quantile_cont(value, 0.95), 9) AS p95, max(value) AS greatest FROM scored GROUP BY truth"))
    values = ", ".join(str(m) for m in CANDIDATE_MODELS)
    register("decision_matrix", lambda spark, d: metrics.decision_matrix(spark.createDataFrame(CANDIDATE_MODELS, list(CANDIDATE_COLUMNS))), f"""WITH c AS (SELECT *, macro_f1 >= max(macro_f1) OVER () - 0.03 AS eligible FROM (VALUES {values}) v({", ".join(CANDIDATE_COLUMNS)})),
        m AS (SELECT max(train_seconds) AS a, max(infer_seconds) AS b, max(bytes) AS z FROM c WHERE eligible)
        SELECT name, macro_f1::DOUBLE AS macro_f1, eligible, CASE WHEN eligible THEN round((0.35 * macro_f1 + 0.15 * minimum_recall + 0.15 * weak_recall + 0.10 * greatest(0, 1 - brier / 2) + 0.10 * greatest(0, 1 - f1_std / 0.1)
            + 0.05 * (3 - train_seconds / a - infer_seconds / b - bytes / z) / 3 + 0.05 * explainability + 0.05 * simplicity)::DOUBLE, 9) END AS selection_score FROM c, m""")  # fmt: skip


def _components() -> tuple[tuple[str, str], ...]:
    from .analytics import COMPONENTS

    return COMPONENTS
