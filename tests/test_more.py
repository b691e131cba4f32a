"""Generators, truth, stores, databases of networks, density clusters, calibration and the command line."""

import json
import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F
from txstrata import cli
from txstrata.functions.records import validate
from txstrata.operators import density, entities, generate, graph, integrity, learning, metrics
from txstrata.operators.ingest import canonical_tables
from txstrata.plans import ingestion, structure
from txstrata.plans.testdata import canonical
from txstrata.sources import experiments, mmdb, truth
from txstrata.sources.records import read_lines
from txstrata.sources.store import StoreError, materialised, open_store, publish, store_checks, unchanged, write_layout

SMALL = "/root/testdata/sf0.001"


# Generators


def test_synthetic_records_are_valid_and_repeatable(spark):
    c = generate.SyntheticConfig(200, pattern_share=0.2, group=5)
    first = [generate.record(c, i) for i in range(200)]
    assert first == [generate.record(c, i) for i in range(200)] and first != [generate.record(generate.SyntheticConfig(200, seed=1, pattern_share=0.2, group=5), i) for i in range(200)]
    for r in first:
        v = validate(r)
        assert sum(v["input_amounts"]) == sum(v["output_amounts"]) + v["fee"] and min(v["output_amounts"]) > 0
    tables = canonical_tables(read_lines(generate.synthetic_records(spark, c), "made"))
    assert tables["rejected_records"].count() == 0 and tables["transactions"].count() == c.unique and tables["network_observations"].count() == 200
    labels = generate.synthetic_truth(spark, c)
    assert labels.select("txid").exceptAll(tables["transactions"].select("txid")).count() == 0 and labels.select("scenario_class").distinct().count() > 2
    assert labels.groupBy("scenario_group").agg(F.count_distinct("scenario_class").alias("k")).filter("k > 1").count() == 0


def test_a_challenge_gives_nothing_away(spark):
    c = generate.ChallengeConfig(400)
    records, labels = generate.challenge_records(spark, c).cache(), generate.challenge_truth(spark, c).cache()
    assert {r["breaches"] for r in generate.challenge_audit(records, labels).collect()} == {0}
    assert canonical_tables(read_lines(records.withColumnRenamed("position", "record_index"), "challenge"))["rejected_records"].count() == 0
    assert {r[0] for r in labels.select("scenario_class").distinct().collect()} == set(generate.SCENARIOS)
    told = records.withColumn("value", F.expr("replace(value, '{', '{\"scenario_class\":\"x\",')"))
    broken = {r["check"]: r["breaches"] for r in generate.challenge_audit(told, labels.filter("scenario_class <> 'baseline'")).collect()}
    assert broken["TRUTH_IN_RECORDS"] > 0 and broken["RECORD_WITHOUT_TRUTH"] > 0
    one = labels.withColumn("scenario_class", F.lit("baseline"))
    ordered = {r["check"]: r["breaches"] for r in generate.challenge_audit(records, one).collect()}
    assert ordered["LONG_RUN_OF_ONE_CLASS"] == 1 and ordered["SINGLE_CLASS_CATEGORY"] > 0
    for bad in ({"transactions": 0}, {"transactions": 5, "seed": -1}, {"transactions": 5, "group": 3}):
        with pytest.raises(ValueError):
            generate.ChallengeConfig(**bad)


def test_an_audit_of_owners_reads_records_once(spark):
    c = generate.EntityConfig(300)
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(len(b))
            yield b

    records, owners = generate.entity_records(spark, c).cache(), generate.entity_truth(spark, c).cache()
    found = {r["check"]: r["breaches"] for r in generate.entity_audit(records.mapInPandas(counted, records.schema), owners).collect()}
    assert set(found.values()) == {0} and len(found) == 6 and made.value == records.count()


def test_an_audit_of_owners_finds_every_breach(spark):
    say = lambda **x: json.dumps({"txid": "a", "input_addresses": ["p"], "output_addresses": ["q"], "input_amounts": ["1"], "output_amounts": ["1"], "fee": "0", "script_type": None} | x)
    records = spark.createDataFrame([(0, say()), (1, say(fee="1")), (2, say(txid="b", entity_id="e")), (3, say(txid="b")), (4, say(txid="c", output_addresses=["r", "s"])), (5, say(txid=None, output_addresses=["s"])), (6, say(txid="d", input_addresses=None))], "position long, value string")
    owners = spark.createDataFrame([("e", "test", "p"), ("f", "test", "p"), ("f", "development", "q"), ("g", "elsewhere", "u"), ("h", None, "v")], "entity_id string, partition string, address string")
    assert [tuple(r) for r in generate.entity_audit(records, owners).collect()] == [
        ("TRUTH_IN_RECORDS", 1), ("TRANSACTION_TOLD_IN_SEVERAL_WAYS", 1), ("ADDRESS_OF_SEVERAL_OWNERS", 1), ("ADDRESS_WITHOUT_OWNER", 2), ("UNKNOWN_PARTITION", 1), ("OWNER_IN_SEVERAL_PARTITIONS", 1)
    ]


def test_value_checks_of_entities_need_no_bridges(spark, monkeypatch):
    t = canonical(spark, SMALL)
    members, evidence, supporting = structure.candidates(t)
    whole = entities.candidate_entities(members, evidence, supporting)
    sizes = entities.candidate_sizes(members, evidence)
    assert sizes.count() > 0 and sorted(map(tuple, sizes.collect())) == sorted(map(tuple, whole.select(*sizes.columns).collect()))

    def refused(edges):
        raise AssertionError("bridges are not checked")

    monkeypatch.setattr(entities, "bridges", refused)
    assert ingestion.tampered_checks(t).count() == 8


def test_hidden_owners(spark, tmp_path):
    c = generate.EntityConfig(300)
    records, owners, several = generate.entity_records(spark, c).cache(), generate.entity_truth(spark, c).cache(), generate.collaborative_truth(spark, c).cache()
    assert {r["breaches"] for r in generate.entity_audit(records, owners).collect()} == {0}
    t = canonical_tables(read_lines(records.withColumnRenamed("position", "record_index"), "owners"))
    assert t["rejected_records"].count() == 0 and several.count() == 15
    shares = {r["partition"]: r["count"] for r in owners.select("entity_id", "partition").distinct().groupBy("partition").count().collect()}
    assert shares["development"] > shares["validation"] > 0 and shares["test"] > 0
    truth.publish_entity_truth(owners, several, str(tmp_path / "truth"))
    back, collaborative = truth.entity_truth(spark, str(tmp_path / "truth"))
    assert back.exceptAll(owners).count() == owners.exceptAll(back).count() == 0
    detector = entities.collaborative_detector(t)
    evidence = entities.cospend_evidence(t, detector).cache()
    kept, raw = (entities.memberships(entities.all_addresses(t), evidence, suppress=s).cache() for s in (True, False))
    rate = lambda m: entities.collaborative_false_merges(m, back, collaborative).first()
    assert rate(raw)["collaborative_false_merge_rate"] > 0.9 > rate(kept)["collaborative_false_merge_rate"] and rate(kept)["collaborative_transaction_count"] == 15
    found = entities.candidate_entities(kept, evidence, entities.shared_ip_evidence(t))
    assert {r["breaches"] for r in entities.value_checks(t, kept, evidence, found, detector).collect()} == {0}
    broken = kept.withColumn("candidate", F.first("candidate").over(__import__("pyspark.sql.window", fromlist=["Window"]).Window.orderBy("address")))
    wrong = {r["code"]: r["breaches"] for r in entities.value_checks(t, broken, evidence, found, detector).collect()}
    assert wrong["MEMBERSHIP_EVIDENCE_MISMATCH"] > 0 and wrong["CANDIDATE_SET_MISMATCH"] > 0


# Truth


def test_truth_documents_are_checked(spark, tmp_path):
    c = generate.ChallengeConfig(50)
    labels = generate.challenge_truth(spark, c)
    truth.publish_scenario_truth(labels, str(tmp_path / "t"))
    back = truth.scenario_truth(spark, str(tmp_path / "t"))
    assert back.select("txid", "scenario_class").exceptAll(labels.select("txid", "scenario_class")).count() == 0
    assert truth.joined(labels.select("txid"), back, "txid").count() == 50
    with pytest.raises(truth.TruthError, match="lacks 1"):
        truth.joined(labels.select("txid").union(spark.createDataFrame([("x",)], "txid string")), back, "txid")
    good = {"truth_schema_version": "1.2.0", "not_criminal_ground_truth": True, "transactions": [{"txid": "a", "scenario_class": "baseline", "scenario_group_id": "g", "scenario_intensity": "weak", "secondary_tags": []}]}
    row = good["transactions"][0]
    bad = [good | {"truth_schema_version": "9"}, good | {"not_criminal_ground_truth": False}, good | {"transactions": [row, row]}, good | {"transactions": [row | {"scenario_class": "x"}]}, good | {"transactions": [row | {"scenario_group_id": ""}]}, good | {"transactions": [row | {"secondary_tags": ["baseline"]}]}]
    for k, document in enumerate([good, *bad]):
        (tmp_path / f"{k}.json").write_text(json.dumps(document, indent=1))
        if not k:
            assert truth.scenario_truth(spark, str(tmp_path / "0.json")).count() == 1
            continue
        with pytest.raises(truth.TruthError):
            truth.scenario_truth(spark, str(tmp_path / f"{k}.json"))
    owner = {"entity_id": "e", "partition": "test", "addresses": ["a"]}
    for k, listed in enumerate([[owner, owner], [owner, owner | {"entity_id": "f"}], [owner | {"partition": "x"}], [owner | {"addresses": []}]]):
        (tmp_path / f"e{k}.json").write_text(json.dumps({"truth_schema_version": "1.0.0", "evaluation_only": True, "entities": listed, "collaborative_transactions": []}))
        with pytest.raises(truth.TruthError):
            truth.entity_truth(spark, str(tmp_path / f"e{k}.json"))


# Stores and experiments


def test_a_store_that_was_changed_is_found_out(spark, tmp_path):
    rows = spark.range(100).selectExpr("id AS k", "id % 7 AS v")
    first = publish({"t": rows}, str(tmp_path / "a"), "1", {"t": ("k",)}, row_group_bytes=1 << 20)
    publish({"t": rows}, str(tmp_path / "b"), "1", lineage={"canonical": first["dataset_id"]})
    assert not any(store_checks(spark, str(tmp_path / "b"), "1", {"canonical": str(tmp_path / "a")}, "FEATURE").values())
    assert store_checks(spark, str(tmp_path / "b"), "2", {"canonical": str(tmp_path / "b")}, "FEATURE")["CANONICAL_LINEAGE_MISMATCH"] == 1
    write_layout(rows.filter("k <> 3"), str(tmp_path / "other"), files=1)
    part, other = next((tmp_path / "a" / "t").glob("*.parquet")), next((tmp_path / "other").glob("*.parquet"))
    part.write_bytes(other.read_bytes())
    for crc in (tmp_path / "a" / "t").glob(".*.crc"):
        crc.unlink()
    wrong = store_checks(spark, str(tmp_path / "a"), "1")
    assert wrong["STORE_ROW_COUNT_MISMATCH"] == 1 and wrong["STORE_FILE_HASH_MISMATCH"] >= 1 and not wrong["STORE_DATASET_ID_MISMATCH"]
    with pytest.raises(StoreError, match="ROW_COUNT"):
        open_store(spark, str(tmp_path / "a"), "1", verify=True)
    before = unchanged(spark, str(part))
    assert unchanged(spark, str(part), before) == before
    part.write_bytes(b"x")
    with pytest.raises(StoreError):
        unchanged(spark, str(part), before)
    write_layout(rows, str(tmp_path / "many"), files=4, codec="snappy")
    assert len(list((tmp_path / "many").glob("*.parquet"))) == 4
    with pytest.raises(StoreError):
        write_layout(rows, str(tmp_path / "bad"), codec="gzip9")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS copies LOCATION '{tmp_path}/copies'")
    assert materialised(rows, "copies.kept").count() == 100
    with pytest.raises(Exception, match="already exists"):
        materialised(rows, "copies.kept")
    spark.sql("DROP DATABASE copies CASCADE")


def labelled(spark, n=240):
    rng = np.random.default_rng(2)
    rows = [(i, float(x := rng.normal(i % 3, 0.4)), float(rng.normal(-(i % 3), 0.4)), 1.0, "abc"[i % 3], ("train", "train", "validation", "test")[i // 3 % 4]) for i in range(n)]
    return spark.createDataFrame(rows, "k long, x double, y double, z double, label string, part string")


def test_experiments_are_kept_and_verified(spark, tmp_path):
    rows = labelled(spark)
    model = learning.train_classifier(rows, ["x", "y", "z"], "label")
    out, labels = learning.class_probabilities(model, rows)
    settings = {"model": "logistic", "seed": 42, "columns": ["x", "y"]}
    assert experiments.experiment_id(settings) == experiments.experiment_id(dict(reversed(settings.items())))
    path = experiments.publish_experiment(str(tmp_path), settings, {"macro_f1": 0.9}, {"predictions": out.select("k", "predicted")}, model)
    assert experiments.inspect_experiment(spark, path)["measures"] == {"macro_f1": 0.9}
    with pytest.raises(StoreError):
        experiments.publish_experiment(str(tmp_path), settings, {}, {"predictions": out.select("k")})
    with pytest.raises(StoreError, match="trusted"):
        experiments.load_model(spark, path)
    again, _ = learning.class_probabilities(experiments.load_model(spark, path, trusted=True), rows)
    assert again.select("k", "predicted").exceptAll(out.select("k", "predicted")).count() == 0
    part = next((tmp_path / experiments.experiment_id(settings) / "predictions").glob("*.parquet"))
    part.write_bytes(part.read_bytes() + b" ")
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(StoreError, match="predictions"):
        experiments.inspect_experiment(spark, path)


def test_graph_and_entity_stores(spark, tmp_path):
    from txstrata.sources import sinks

    c = generate.EntityConfig(60)
    t = canonical_tables(read_lines(generate.entity_records(spark, c).withColumnRenamed("position", "record_index"), "g"))
    root = publish(t, str(tmp_path / "canonical"), "1")
    t, _ = open_store(spark, str(tmp_path / "canonical"), "1", verify=True)
    sinks.publish_graph(t, str(tmp_path / "graph"), root["dataset_id"])
    assert sinks.read_back(spark, str(tmp_path / "graph"), "1", {"canonical": str(tmp_path / "canonical")}, "GRAPH").filter("breaches > 0").count() == 0
    assert sinks.read_back(spark, str(tmp_path / "canonical"), "1", {}, "CANONICAL").filter("breaches > 0").count() == 0
    sinks.import_files(t, str(tmp_path / "csv"))
    edges = spark.read.option("header", True).csv(str(tmp_path / "csv" / "edges_spent_in"))
    assert edges.columns[:2] == [":START_ID(address)", ":END_ID(transaction)"] and edges.count() == t["transaction_inputs"].count()
    detector = entities.collaborative_detector(t)
    evidence = entities.cospend_evidence(t, detector)
    members = entities.memberships(entities.all_addresses(t), evidence)
    sinks.publish_entities({"members": members, "evidence": evidence, "detector": detector}, str(tmp_path / "entities"), root["dataset_id"], "none")
    wrong = {r["code"]: r["breaches"] for r in sinks.read_back(spark, str(tmp_path / "entities"), "1", {"canonical": str(tmp_path / "canonical"), "feature": str(tmp_path / "graph")}, "ENTITY").collect()}
    assert wrong["CANONICAL_LINEAGE_MISMATCH"] == 0 and wrong["FEATURE_LINEAGE_MISMATCH"] == 1 and wrong["ENTITY_DATASET_ID_MISMATCH"] == 0


# Learning


def test_classifiers_calibration_search_and_diagnostics(spark):
    rows = labelled(spark).cache()
    train, test = rows.filter("part = 'train'"), rows.filter("part = 'test'")
    for kind in ("logistic", "forest", "boosted"):
        model = learning.train_classifier(train, ["x", "y", "z"], "label", kind, rounds=5)
        out, labels = learning.class_probabilities(model, test)
        assert labels == ["a", "b", "c"] and out.filter("label = predicted").count() > 0.8 * test.count()
        assert out.filter(F.abs(F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9).count() == 0
        about = learning.diagnostics(model).collect()
        assert {r["feature"] for r in about} == {"x", "y"}  # the constant column is left out
    fitted = learning.calibrate(train, ["x", "y"], "label", "k", "logistic")
    scored = fitted.transform(test, "k").join(test.select("k", "label"), "k").cache()
    r = metrics.supervised_scores(scored, "label", "probabilities", fitted.labels, "k").first()
    y = {x["k"]: (x["label"], x["probabilities"]) for x in scored.collect()}
    brier = np.mean([sum((p - (c == label)) ** 2 for c, p in zip("abc", ps, strict=True)) for label, ps in y.values()])
    loss = np.mean([-math.log(max(ps["abc".index(label)], 1e-15)) for label, ps in y.values()])
    areas = [np.mean([(a[1][k] > b[1][k]) + 0.5 * (a[1][k] == b[1][k]) for a in y.values() if a[0] == c for b in y.values() if b[0] != c]) for k, c in enumerate("abc")]
    assert r["multiclass_brier_score"] == pytest.approx(brier) and r["log_loss"] == pytest.approx(loss) and r["roc_auc_ovr_macro"] == pytest.approx(np.mean(areas)) and r["roc_auc_ovr_macro"] > 0.9
    found = learning.validation_search(rows, ["x", "y"], "label", [("logistic", 1), ("forest", 1)]).collect()
    assert [r["kind"] for r in found] == ["logistic", "forest"] and {r["validation_rows"] for r in found} == {rows.filter("part = 'validation'").count()}
    with pytest.raises(ValueError):
        learning.validation_search(rows, ["x"], "label", [])
    for kind in ("xgboost", "lightgbm", "other"):
        with pytest.raises(ValueError):
            learning.classifier(kind)
    with pytest.raises(Exception, match="not finite"):
        learning.check_scores(spark.createDataFrame([(float("nan"),)], "anomaly_score double")).collect()


def points(spark, x):
    return spark.createDataFrame([(i, Vectors.dense(p)) for i, p in enumerate(x.tolist())], ["k", "features"])


def test_neighbours_and_outlier_factor_against_brute_force(spark):
    x = np.random.default_rng(3).normal(size=(90, 3))
    rows = points(spark, x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = {}
    for r in learning.neighbours(rows, rows, 4, "k").collect():
        near.setdefault(r["id"], []).append((r["rank"], r["other"], r["distance"]))
    for i, own in near.items():
        assert [o for _, o, _ in sorted(own)] == np.argsort(d[i])[:4].tolist() and [v for *_, v in sorted(own)] == pytest.approx(np.sort(d[i])[:4].tolist())
    k, order = 7, np.argsort(d, axis=1)[:, :7]
    radius = np.sort(d, axis=1)[:, k - 1]
    density_ = np.array([1 / (np.mean([max(d[i, j], radius[j]) for j in order[i]]) + 1e-10) for i in range(90)])
    want = [np.mean(density_[order[i]]) / density_[i] for i in range(90)]
    found = {r["k"]: r["anomaly_score"] for r in learning.local_outlier_factor(rows, "k", 7).collect()}
    assert [found[i] for i in range(90)] == pytest.approx(want)
    assert learning.local_outlier_factor(rows, "k", 7, limit=40).count() == 90 and learning.local_outlier_factor(rows.limit(1), "k").first()["anomaly_score"] == 1.0


def test_density_clusters(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.15, (40, 2)) for c in ((0, 0), (5, 5), (0, 6))] + [rng.uniform(-4, 10, (12, 2))])
    found = density.hdbscan(x, 8, 5)
    blobs = [found.labels[i : i + 40] for i in (0, 40, 80)]
    main = [np.bincount(b[b >= 0]).argmax() for b in blobs]
    assert len(set(main)) == 3 and all((b == m).mean() > 0.85 for b, m in zip(blobs, main, strict=True)) and (found.labels[120:] == -1).sum() >= 4
    tree = density.spanning_tree(x, found.core)
    reach = np.maximum(np.maximum(density.distances(x, x), found.core), found.core[:, None])
    cut = lambda w: len({tuple(np.flatnonzero(r)) for r in _closure(reach <= w)})
    for w in (0.2, 0.5, 2.0):  # single linkage by the tree and by all pairs
        assert len(x) - int((tree[:, 0] <= w).sum()) == cut(w)
    out = {r["k"]: r for r in density.behavioural_communities(points(spark, x), "k", 8, 5).collect()}
    assert len(out) == len(x) and all((r["community"] is None) == r["is_noise"] == (r["community_size"] == 0) for r in out.values())
    assert {r["community"] for r in out.values() if not r["is_noise"]} == {min(i for i in range(len(x)) if found.labels[i] == c) for c in set(found.labels) - {-1}}
    some = density.behavioural_communities(points(spark, x), "k", 5, 3, limit=70).cache()
    assert some.count() == len(x) and {r["breaches"] for r in entities.community_checks(some, some, "k").collect()} == {0}
    assert density.behavioural_communities(points(spark, x).limit(3), "k", 5, 5).filter("NOT is_noise").count() == 0


def _closure(near):
    out = near | np.eye(len(near), dtype=bool)
    while True:
        wider = (out.astype(int) @ out.astype(int)) > 0
        if (wider == out).all():
            return out
        out = wider


def test_mutual_information_beyond_chance(spark):
    rng = np.random.default_rng(6)
    t, p = rng.integers(0, 4, 60), rng.integers(0, 5, 60)

    def mutual(a, b):
        n = len(a)
        return sum((c := int(((a == x) & (b == y)).sum())) and c / n * math.log(n * c / ((a == x).sum() * (b == y).sum())) for x in set(a) for y in set(b))

    entropy = lambda a: -sum((a == x).mean() * math.log((a == x).mean()) for x in set(a))
    chance = np.mean([mutual(t, rng.permutation(p)) for _ in range(4000)])
    want = (mutual(t, p) - chance) / ((entropy(t) + entropy(p)) / 2 - chance)
    rows = spark.createDataFrame([(str(a), str(b)) for a, b in zip(t, p, strict=True)], "t string, p string")
    assert entities.adjusted_mutual_information(rows, "t", "p") == pytest.approx(want, abs=0.01)
    assert entities.adjusted_mutual_information(rows, "t", "t") == pytest.approx(1) and entities.adjusted_mutual_information(rows.limit(0), "t", "p") == 1.0


def test_fragile_bridges_of_candidates_by_removal(spark):
    members, evidence, supporting = structure.candidates(canonical(spark, SMALL))
    pairs = sorted({(r["anchor"], r["other"]) for r in evidence.filter("NOT suppressed").collect()})

    def parts(edges):
        parent = {v: v for e in pairs for v in e}

        def find(v):
            while parent[v] != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        for a, b in edges:
            parent[find(a)] = find(b)
        return sum(find(v) == v for v in parent)

    found = {(r["a"], r["b"]) for r in graph.bridges(evidence.filter("NOT suppressed").select(F.col("anchor").alias("a"), F.col("other").alias("b"))).collect()}
    whole = parts(pairs)
    for k in range(0, len(pairs), max(1, len(pairs) // 60)):
        assert (pairs[k] in found) == (parts(pairs[:k] + pairs[k + 1 :]) > whole)
    for r in entities.candidate_entities(members, evidence, supporting).filter("strong_evidence_edge_count > 0").limit(50).collect():
        assert r["robustness_score"] == pytest.approx(1 - r["fragile_bridge_count"] / r["strong_evidence_edge_count"])


# Databases of networks


class Writer:
    """Writes a database of networks: a tree of records of 24, 28 or 32 bits, a data section, metadata."""

    def __init__(self, kind, version, bits):
        self.kind, self.version, self.bits, self.nodes, self.data, self.places = kind, version, bits, [[None, None]], b"", {}

    def value(self, v):
        head = lambda kind, n: bytes([(kind << 5 if kind < 8 else 0) | (n if n < 29 else 29)]) + (bytes([kind - 7]) if kind > 7 else b"") + (bytes([n - 29]) if n >= 29 else b"")
        if isinstance(v, dict):
            return head(7, len(v)) + b"".join(self.value(k) + self.value(x) for k, x in v.items())
        if isinstance(v, str):
            return head(2, len(v.encode())) + v.encode()
        if isinstance(v, list):
            return head(11, len(v)) + b"".join(map(self.value, v))
        raw = v.to_bytes((v.bit_length() + 7) // 8, "big")
        return head(6 if v < 1 << 32 else 9, len(raw)) + raw

    def add(self, network, value):
        from ipaddress import ip_network

        n = ip_network(network)
        number, depth, total = int(n.network_address), n.prefixlen, n.max_prefixlen
        if self.version == 6 and total == 32:
            depth, total = depth + 96, 128
        if repr(value) not in self.places:
            self.places[repr(value)] = len(self.data)
            self.data += self.value(value)
        at = 0
        for k in range(depth):
            side = number >> (total - 1 - k) & 1
            if k == depth - 1:
                self.nodes[at][side] = ("data", self.places[repr(value)])
            else:
                if self.nodes[at][side] is None:
                    self.nodes.append([None, None])
                    self.nodes[at][side] = len(self.nodes) - 1
                at = self.nodes[at][side]

    def bytes(self):
        n, tree = len(self.nodes), b""
        number = lambda r: n if r is None else r if isinstance(r, int) else n + 16 + r[1]
        for a, b in ((number(x), number(y)) for x, y in self.nodes):
            if self.bits == 28:
                tree += (a & 0xFFFFFF).to_bytes(3, "big") + bytes([(a >> 24) << 4 | b >> 24]) + (b & 0xFFFFFF).to_bytes(3, "big")
            else:
                tree += a.to_bytes(self.bits // 8, "big") + b.to_bytes(self.bits // 8, "big")
        about = {"node_count": n, "record_size": self.bits, "ip_version": self.version, "database_type": self.kind, "build_epoch": 1_700_000_000, "languages": ["en"]}
        return tree + b"\0" * 16 + self.data + mmdb.MARK + self.value(about)


@pytest.mark.parametrize("version,bits", [(4, 24), (6, 28), (6, 32)])
def test_databases_of_networks(spark, tmp_path, version, bits):
    where = {"10.0.0.0/9": "NO", "10.128.0.0/10": "JP", "192.0.2.128/25": "CL"} | ({"2001:db8::/32": "KE"} if version == 6 else {})
    country, asn = Writer("Own-Country-Lite", version, bits), Writer("Own-ASN-Lite", version, bits)
    for k, (n, c) in enumerate(where.items()):
        country.add(n, {"country": {"iso_code": c}})
        asn.add(n, {"autonomous_system_number": 64496 + k, "autonomous_system_organization": f"holder {c} " * 5})
    (tmp_path / "c.mmdb").write_bytes(country.bytes())
    (tmp_path / "a.mmdb").write_bytes(asn.bytes())
    stated, c = mmdb.open_database(spark, str(tmp_path / "c.mmdb"), "country")
    _, a = mmdb.open_database(spark, str(tmp_path / "a.mmdb"), "asn")
    assert (stated.ip_version, stated.build_epoch, stated.size) == (version, 1_700_000_000, len(country.bytes())) and {n: v["country"]["iso_code"] for n, v in c.networks()} == where
    ips = spark.createDataFrame([(x,) for x in ("10.1.2.3", "10.140.0.1", "10.200.0.1", "192.0.2.129", "2001:db8::1")], "ip string")
    found = {r["ip"]: r for r in mmdb.enrich_from(spark, ips, c, a).collect()}
    assert (found["10.1.2.3"]["country_code"], found["10.1.2.3"]["asn"], found["10.140.0.1"]["country_code"], found["10.200.0.1"]["country_found"]) == ("NO", 64496, "JP", False)
    assert found["2001:db8::1"]["country_code"] == ("KE" if version == 6 else None) and found["192.0.2.129"]["holder"] == "holder CL " * 5
    for role, data in (("asn", country.bytes()), ("country", b"nothing"), ("country", country.bytes()[: -len(country.bytes()) // 2])):
        (tmp_path / "bad.mmdb").write_bytes(data)
        with pytest.raises(mmdb.ResourceError):
            mmdb.open_database(spark, str(tmp_path / "bad.mmdb"), role)


# The command line


def test_command_line(spark, tmp_path, capsys):
    c = generate.SyntheticConfig(30)
    records = [generate.record(c, i) for i in range(30)]
    (tmp_path / "r.json").write_text(json.dumps(records))
    store = str(tmp_path / "store")

    def run(*arguments):
        status = cli.main([arguments[0], "--dataset", store, *arguments[1:]], spark)
        return status, [json.loads(line) for line in capsys.readouterr().out.splitlines()]

    status, rows = run("ingest", "--source", str(tmp_path / "r.json"))
    assert status == 0 and {r["table"]: r["rows"] for r in rows}["transactions"] == c.unique
    status, rows = run("validate")
    assert status == 0 and len(rows) > 15
    assert run("tx", "--txid", records[0]["txid"])[1] and len(run("high-value", "--limit", "3")[1]) == 3 and run("ip", "--ip", records[0]["src_ip"])[1]
    assert sum(r["observation_count"] for r in run("temporal", "--bucket", "day")[1]) == 30
    with pytest.raises(SystemExit):
        run("no-such-command")


def test_sample_and_keys(spark):
    rows = spark.range(500).selectExpr("concat('k', id) AS k")
    assert [r["k"] for r in integrity.sample(rows, "k").collect()] == sorted(f"k{i}" for i in range(500))[:100]
    assert integrity.correlation_checks(rows.withColumnRenamed("k", "address").limit(499), rows.withColumnRenamed("k", "address")).first()["breaches"] == 1
