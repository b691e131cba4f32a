"""Features, lookups, checks, graph, entities and learning against hand-made cases."""

import os
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from txstrata.operators import communities, enrich, entities, features, graph, integrity, learning, lookups, metrics
from txstrata.operators.components import connected_components
from txstrata.operators.ranking import with_rank
from txstrata.operators.rounds import Rounds, checkpoint_dir
from txstrata.streaming.activity import streaming_activity

COIN = 100_000_000


def tables(spark, txs, seen):
    """Canonical tables from {txid: (inputs, outputs, fee)} and observations (txid, time, src, dst, sport, dport, country, asn)."""
    side = lambda k: [(t, i, a, int(v * COIN)) for t, x in txs.items() for i, (a, v) in enumerate(x[k])]
    obs = [(f"o{i:02}", t, at, s, d, sp, dp, c, n, f"s{i:02}") for i, (t, at, s, d, sp, dp, c, n) in enumerate(seen)]
    return {
        "transactions": spark.createDataFrame([(t, int(x[2] * COIN), "p2wpkh") for t, x in txs.items()], "txid string, fee_sats long, script_type string"),
        "transaction_inputs": spark.createDataFrame(side(0), "txid string, input_index long, address string, amount_sats long"),
        "transaction_outputs": spark.createDataFrame(side(1), "txid string, output_index long, address string, amount_sats long"),
        "network_observations": spark.createDataFrame(obs, "observation_id string, txid string, observed_at timestamp_ntz, src_ip string, dst_ip string, src_port long, dst_port long, reported_geo_country string, reported_asn long, source_record_id string"),
        "transaction_sources": spark.createDataFrame([(o[1], o[9]) for o in obs], "txid string, source_record_id string"),
        "source_records": spark.createDataFrame([(o[9], "f", "json", "h", i) for i, o in enumerate(obs)], "source_record_id string, source_file string, source_format string, source_file_sha256 string, record_index long"),
        "rejected_records": spark.createDataFrame([], "source_record_id string, source_file string, record_index long, error_code string, error_message string, field_name string"),
    }


def day(h, m=0, s=0):
    return datetime(2026, 1, 1, h, m, s)


@pytest.fixture(scope="module")
def small(spark):
    txs = {
        "1": ([("AddressA", 3), ("InputX", 2), ("InputY", 1)], [("AddressA", 1), ("OutputB", 1), ("OutputC", 1), ("OutputD", 2.9)], 0.1),
        "2": ([("AddressA", 1)], [("OutputE", 0.99)], 0.01),
        "3": ([("DisconnectedF", 2)], [("DisconnectedG", 1.99)], 0.01),
    }
    seen = [
        ("1", day(12), "192.0.2.10", "192.0.2.10", 8333, 18444, "IN", 64500), ("1", day(12), "192.0.2.10", "2001:db8::1", 8333, 8333, "IN", 64500), ("1", day(12, 0, 30), "192.0.2.10", "2001:db8::2", 8333, 8333, "IN", 64500),
        ("1", day(12, 4), "198.51.100.2", "2001:db8::3", 8333, 8333, "US", 64501), ("1", day(13), "198.51.100.3", "2001:db8::4", 8333, 8333, "US", 64501), ("2", day(14), "192.0.2.10", "203.0.113.5", 8333, 8333, "IN", 64500),
        ("3", day(11), "2001:db8:1::1", "203.0.113.9", 8333, 8333, None, None),
    ]
    return {k: v.cache() for k, v in tables(spark, txs, seen).items()}


def row(frame, **where):
    for k, v in where.items():
        frame = frame.filter(F.col(k) == v)
    return frame.collect()[0]


def test_transaction_features(small):
    r = row(features.transaction_features(features.scope(small)), txid="1")
    assert (r["input_count"], r["output_count"], r["network_observation_count"], r["total_input_sats"], r["total_output_sats"]) == (3, 4, 5, 6 * COIN, 590_000_000)
    assert r["fee_to_input_ratio"] == pytest.approx(1 / 60) and r["max_observations_1m"] == 3 and r["min_inter_observation_seconds"] == 0


def test_address_features(small):
    f = features.address_features(features.scope(small))
    a, d = row(f, address="AddressA"), row(f, address="DisconnectedF")
    assert (a["input_occurrence_count"], a["output_occurrence_count"], a["unique_tx_count"], a["network_observation_count"], a["co_transaction_address_count"], a["bipartite_component_size"]) == (2, 1, 2, 6, 6, 9)
    assert d["bipartite_component_size"] == 3
    c = row(features.correlation_features(features.scope(small)), address="AddressA")
    assert (c["reused_ip_count"], c["max_transactions_per_associated_ip"]) == (1, 2)


def test_ip_features(small):
    f = features.ip_features(features.scope(small))
    r = row(f, ip="192.0.2.10")
    assert (r["source_observation_count"], r["destination_observation_count"], r["total_observation_count"], r["unique_tx_count"], r["unique_port_count"], r["min_inter_observation_seconds"]) == (4, 1, 4, 2, 2, 0)
    assert row(f, ip="203.0.113.5")["mean_inter_observation_seconds"] is None


def test_cutoff_is_inclusive(small):
    s = features.scope(small, day(12, 0, 10))
    f = features.transaction_features(s)
    assert {x["txid"] for x in f.collect()} == {"1", "3"} and row(f, txid="1")["network_observation_count"] == 2
    a = row(features.address_features(s), address="AddressA")
    assert (a["unique_tx_count"], a["bipartite_component_size"]) == (1, 7)


def test_enrichment_and_version_two(spark, small):
    nets = [("192.0.2.0/24", "IN", 64500, "a"), ("198.51.100.0/24", "US", 64501, "b"), ("2001:db8::/48", "DE", 64502, "c"), ("192.0.2.8/29", "IN", 64500, "d")]
    e = enrich.enrich(enrich.distinct_ips(small["network_observations"]), enrich.range_table(spark, nets)).cache()
    assert row(e, ip="192.0.2.10")["network"] == "192.0.2.8/29" and not row(e, ip="203.0.113.9")["country_found"] and not row(e, ip="2001:db8:1::1")["asn_found"]
    v2 = features.transaction_features_v2(features.scope(small), e)
    r = row(v2, txid="1")
    assert (r["unique_enriched_country_count"], r["unique_enriched_asn_count"], r["source_destination_country_match_rate"]) == (3, 3, 0.2)
    assert row(v2, txid="2")["source_destination_country_match_rate"] is None
    c = row(features.correlation_features_v2(features.scope(small), e), address="AddressA")
    assert (c["associated_enriched_country_count"], c["associated_cross_country_observation_count"], c["associated_cross_asn_observation_count"]) == (3, 4, 4)
    assert all(x["breaches"] == 0 for x in integrity.enrichment_checks(e, enrich.distinct_ips(small["network_observations"])).collect())


def test_lookups(small):
    a = lookups.address_activity(small, "AddressA' OR 1=1 --").collect()[0]
    assert (a["transaction_count"], a["total_input_sats"]) == (0, 0)
    assert [r["txid"] for r in lookups.high_value_transactions(small, 2).collect()] == ["1", "3"]
    assert lookups.ip_activity(small, "192.0.2.10").collect()[0]["ports"] == [8333, 18444]
    for bad in (0, 1001, True):
        with pytest.raises(ValueError):
            lookups.high_fee_transactions(small, bad)
    assert lookups.checked_txid(" " + "A" * 64) == "a" * 64 and lookups.checked_ip("2001:0db8:0::1") == "2001:db8::1"
    assert lookups.temporal_activity(small, "day", day(15), day(16)).count() == 0
    assert streaming_activity(small["network_observations"]).agg(F.sum("observation_count")).collect()[0][0] == 7


def test_sums_beyond_64_bits(spark):
    rich = tables(spark, {"x": ([(f"a{i}", 21_000_000) for i in range(5000)], [], 0)}, [("x", day(1), "1.1.1.1", "1.1.1.2", 1, 2, None, None)])
    assert int(lookups.transaction_summary(rich).collect()[0]["total_input_sats"]) == 10_500_000_000_000_000_000


def test_checks_find_damage(small):
    assert all(r["breaches"] == 0 for r in integrity.canonical_checks(small).collect())
    bad = small | {"transaction_inputs": small["transaction_inputs"].union(small["transaction_inputs"].selectExpr("'zz'", "input_index", "address", "-amount_sats"))}
    found = {r["code"]: r["breaches"] for r in integrity.canonical_checks(bad).collect() if r["breaches"]}
    assert found == {"ORPHAN_TRANSACTION_INPUT": 5, "NEGATIVE_INPUT_AMOUNT": 5, "DUPLICATE_TRANSACTION_INPUT": 2}
    assert integrity.row_count_mismatches(small, {"transactions": 4}).count() == 1
    clean = graph.graph_checks(small, graph.nodes(small), graph.edges(small)).collect()
    assert len(clean) == 24 and all(r["breaches"] == 0 for r in clean)


def test_paths(small):
    p = graph.shortest_path(small, ("address", "OutputE"), ("ip", "2001:db8::4"), 6).collect()[0]
    assert p["length"] == 5 and p["path"][0] == "address:OutputE" and len(p["path"]) == 6
    assert graph.shortest_path(small, ("address", "OutputE"), ("address", "DisconnectedF"), 8).count() == 0
    with pytest.raises(ValueError):
        graph.shortest_path(small, ("address", "a"), ("address", "b"), 9)


def test_components_and_bridges_against_brute_force(spark):
    rng = np.random.default_rng(5)
    edges = sorted({tuple(sorted(map(int, rng.integers(0, 60, 2)))) for _ in range(62)} - {(i, i) for i in range(60)})

    def groups(es):
        p = {v: v for e in edges for v in e}

        def find(x):
            while p[x] != x:
                x = p[x]
            return x

        for a, b in es:
            x, y = find(a), find(b)
            p[max(x, y)] = min(x, y)
        return {v: find(v) for v in p}

    frame = spark.createDataFrame(edges, "a long, b long")
    assert {r["vertex"]: r["component"] for r in connected_components(frame, "a", "b").collect()} == groups(edges)
    n = len(set(groups(edges).values()))
    want = {e for e in edges if len(set(groups([x for x in edges if x != e]).values())) > n}
    assert {(r["a"], r["b"]) for r in graph.bridges(frame).collect()} == want and want
    assert {r["vertex"]: r["component"] for r in connected_components(frame, "a", "b", one_task=0).collect()} == groups(edges)
    assert {(r["a"], r["b"]) for r in graph.bridges(frame, one_task=0).collect()} == want
    assert connected_components(frame.limit(0), "a", "b").count() == 0 and graph.bridges(frame.limit(0)).count() == 0


def test_rounds_of_a_long_path_keep_estimates_bounded(spark):
    order = np.random.default_rng(3).permutation(5000).tolist()
    path = spark.createDataFrame([(f"v{a:04d}", f"v{b:04d}") for a, b in zip(order, order[1:], strict=False)], "a string, b string")
    folder = checkpoint_dir(spark)
    before = set(os.listdir(folder))
    found = connected_components(path, "a", "b", one_task=0)
    assert found.agg(F.count("*"), F.min("component"), F.max("component")).first() == (5000, "v0000", "v0000")
    new = {f for f in os.listdir(folder) if f.startswith("rounds-")} - before
    assert [len(os.listdir(f"{folder}/{f}")) for f in new] == [1]  # nothing but the result is left
    frame, rounds = spark.range(10).toDF("k"), Rounds(spark)
    for _ in range(30):  # a join of a frame with itself, round after round
        was, frame = frame, rounds.keep(frame.join(frame.select("k"), "k"))
        rounds.drop(was)
    assert frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 40 and frame.count() == 10


def test_entities(spark):
    txs = {
        "1": ([("A", 1), ("B", 1)], [("OA", 2)], 0), "2": ([("B", 1), ("C", 1)], [("OB", 2)], 0),
        "3": ([(x, 0.5) for x in "DEFG"], [(f"Q{i}", 0.4975) for i in range(4)], 0.01), "4": ([("P", 1)], [("OP", 1)], 0),
    }
    ip = {"1": "192.0.2.1", "2": "192.0.2.2", "3": "192.0.2.1", "4": "192.0.2.1"}
    t = tables(spark, txs, [(k, day(1), v, "198.51.100.1", 1, 2, None, None) for k, v in ip.items()])
    detector = entities.collaborative_detector(t)
    assert [r["txid"] for r in detector.filter("suspected").collect()] == ["3"]
    evidence = entities.cospend_evidence(t, detector).cache()
    members = entities.memberships(entities.all_addresses(t), evidence).cache()
    by = {r["address"]: r["candidate"] for r in members.collect()}
    assert by["A"] == by["B"] == by["C"] == "A" and [by[x] for x in "DEFG"] == list("DEFG")
    c = row(entities.candidate_entities(members, evidence, entities.shared_ip_evidence(t)), candidate="A")
    assert (c["member_count"], c["fragile_bridge_count"], c["robustness_score"], c["transitive_only_member_count"]) == (3, 2, 0.0, 1)
    m = {r["address"]: r for r in entities.candidate_memberships(members, evidence).collect()}
    assert m["C"]["transitive_only"] and m["B"]["membership_support"] == 1.0 and m["A"]["membership_support"] == 0.5 and m["D"]["membership_support"] == 1.0
    raw = entities.memberships(entities.all_addresses(t), evidence, suppress=False)
    assert raw.select("candidate").distinct().count() == members.select("candidate").distinct().count() - 3


def test_communities_beat_singletons(spark):
    ring = lambda k: [(k + i, k + j, 2) for i in range(5) for j in range(i + 1, 5)]
    edges = spark.createDataFrame([*ring(0), *ring(10), (4, 10, 1)], "a long, b long, weight long")
    found = communities.communities(edges)
    groups = {}
    for r in found.collect():
        groups.setdefault(r["community"], set()).add(r["vertex"])
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2, 3, 4], [10, 11, 12, 13, 14]]
    assert communities.modularity(edges, found).collect()[0][0] > 0.4
    # A ring of 30 pairs: one level joins neighbours, further levels join what it joined.
    chain = spark.createDataFrame([(i, (i + 1) % 60 if i < 59 else 0, 3 if i % 2 == 0 else 1) for i in range(60)], "x long, y long, weight long").selectExpr("least(x, y) AS a", "greatest(x, y) AS b", "weight")
    one, more = communities.communities(chain, levels=1), communities.communities(chain, levels=4)
    worth = [communities.modularity(chain, f).collect()[0][0] for f in (one, more)]
    assert worth[1] > worth[0] and more.select("community").distinct().count() < one.select("community").distinct().count()
    assert communities.communities(edges.limit(0)).count() == 0


def test_shared_transactions_against_brute_force(spark):
    rng = np.random.default_rng(9)
    pairs = sorted({(f"t{t}", f"a{a}") for t, a in zip(rng.integers(0, 12, 70).tolist(), rng.integers(0, 50, 70).tolist(), strict=True)})
    want = {}
    for t, a in pairs:
        want.setdefault(a, set()).update(b for u, b in pairs if u == t and b != a)
    found = {r["address"]: r["co_transaction_address_count"] for r in features.co_transaction_counts(spark.createDataFrame(pairs, "txid string, address string")).collect()}
    assert found == {a: len(b) for a, b in want.items() if b}


def test_detectors_rank_an_outlier_first(spark):
    rng = np.random.default_rng(1)
    pts = [(i, *map(float, rng.normal(0, 1, 2))) for i in range(120)] + [(999, 14.0, -12.0)]
    rows = spark.createDataFrame(pts, "key long, x double, y double")
    ready = learning.prepared(rows, ["x", "y"]).transform(rows).cache()
    top = lambda f: f.orderBy(F.desc("anomaly_score")).first()["key"]
    assert top(learning.isolation_scores(ready, learning.isolation_forest(ready, trees=50))) == 999
    assert top(learning.local_outlier_factor(ready, "key", 10)) == 999
    line = spark.createDataFrame([(i, float(i), 2.0 * i) for i in range(50)] + [(999, 20.0, 0.0)], "key long, x double, y double")
    fitted = learning.prepared(line, ["x", "y"]).transform(line)
    assert top(learning.pca_errors(fitted.filter("key < 999"), fitted)) == 999
    with pytest.raises(ValueError):
        learning.behaviour_columns(["txid"])


def test_splits_and_ranks(spark):
    rows = spark.createDataFrame([(i, day(0, i // 7), i % 9, "ab"[i % 2]) for i in range(100)], "k long, at timestamp_ntz, g long, label string")
    split = metrics.temporal_split(rows, "at", "k")
    last = {r["part"]: (r[1], r[2]) for r in split.groupBy("part").agg(F.min("at"), F.max("at")).collect()}
    assert last["train"][1] < last["validation"][0] and last["validation"][1] < last["test"][0]
    assert metrics.split_audit(metrics.group_split(rows, "g"), "g", "at", "label").first()["torn_groups"] == 0
    assert [r["k"] for r in with_rank(rows, [F.desc("k")]).orderBy("rank").limit(3).collect()] == [99, 98, 97]
