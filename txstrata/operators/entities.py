"""Conservative entity hypotheses: co-spending evidence, suppression, candidates, and their evaluation."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .graph import bridges
from .rounds import stored

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class EntityConfig:
    """Thresholds of the detector of collaborative transactions."""

    min_inputs: int = 3
    min_outputs: int = 3
    min_equal_outputs: int = 2
    min_equal_fraction: float = 0.5

    def __post_init__(self) -> None:
        if min(self.min_inputs, self.min_outputs, self.min_equal_outputs) < 2 or not 0 < self.min_equal_fraction <= 1:
            raise ValueError("counts must be at least 2 and the fraction in (0, 1]")


def collaborative_detector(t: Tables, config: EntityConfig = EntityConfig()) -> DataFrame:  # noqa: B008
    """One row per transaction with inputs or outputs: how much it looks like one of several parties."""
    outputs = t["transaction_outputs"]
    equal = outputs.groupBy("txid", "amount_sats").agg(F.count("*").alias("n")).groupBy("txid").agg(F.count_if(F.col("n") >= 2).alias("equal_output_group_count"), F.max("n").alias("most"), F.sum("n").alias("n"))
    mean = outputs.groupBy("txid").agg(F.avg("amount_sats").alias("mean"), F.count_distinct("address").alias("distinct_output_count"))
    near = outputs.join(mean, "txid").groupBy("txid", "distinct_output_count").agg(F.when(F.max("mean") != 0, F.count_if(F.col("amount_sats").between(F.col("mean") * 0.5, F.col("mean") * 1.5)) / F.count("*")).alias("balanced"))
    inputs = t["transaction_inputs"].groupBy("txid").agg(F.count_distinct("address").alias("distinct_input_count"))
    joined = t["transactions"].select("txid").join(inputs, "txid", "left").join(near, "txid", "left").join(equal, "txid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    fraction = F.coalesce(F.col("most") / F.col("n"), F.lit(0.0))
    rows = joined.select(
        "txid", zero("distinct_input_count").alias("distinct_input_count"), zero("distinct_output_count").alias("distinct_output_count"), zero("equal_output_group_count").alias("equal_output_group_count"),
        zero("most").alias("max_equal_output_multiplicity"), fraction.alias("equal_output_fraction"), F.coalesce("balanced", F.lit(0.0)).alias("balanced_output_fraction"),
    )
    suspected = (
        (F.col("distinct_input_count") >= config.min_inputs) & (F.col("distinct_output_count") >= config.min_outputs)
        & (F.col("max_equal_output_multiplicity") >= config.min_equal_outputs) & (F.col("equal_output_fraction") >= config.min_equal_fraction)
    )
    return rows.withColumn("suspected", suspected)


def star_pairs(rows: DataFrame, group: str, member: str = "address") -> DataFrame:
    """(group, anchor, other): every member of a group with its least one, so n members give n - 1 pairs."""
    members = rows.select(group, member).distinct()
    least = members.groupBy(group).agg(F.min(member).alias("anchor"))
    return members.join(least, group).filter(F.col(member) != F.col("anchor")).select(group, "anchor", F.col(member).alias("other"))


def cospend_evidence(t: Tables, detector: DataFrame) -> DataFrame:
    """Pairs spent together, each with its transaction, and whether that transaction is suspected."""
    flags = detector.select("txid", "suspected")
    return star_pairs(t["transaction_inputs"], "txid").join(flags, "txid").select("anchor", "other", "txid", F.col("suspected").alias("suppressed"))


def shared_ip_evidence(t: Tables) -> DataFrame:
    """Supporting pairs: addresses whose transactions were seen from one source IP.  Never merged."""
    seen = t["transaction_inputs"].select("address", "txid").distinct().join(t["network_observations"].select("txid", "src_ip"), "txid").select("address", "src_ip")
    return star_pairs(seen, "src_ip")


def all_addresses(t: Tables) -> DataFrame:
    return t["transaction_inputs"].select("address").union(t["transaction_outputs"].select("address")).distinct()


def memberships(addresses: DataFrame, evidence: DataFrame, suppress: bool = True) -> DataFrame:
    """(address, candidate): components of the evidence, named by their least address; others stand alone."""
    kept = evidence.filter(~F.col("suppressed")) if suppress else evidence
    labels = connected_components(kept.select(F.col("anchor").alias("src"), F.col("other").alias("dst")))
    return addresses.join(labels.withColumnRenamed("vertex", "address"), "address", "left").select("address", F.coalesce("component", "address").alias("candidate"))


def candidate_sizes(members: DataFrame, evidence: DataFrame) -> DataFrame:
    """(candidate, member_count, strong_evidence_edge_count): what value checks read of every candidate, without bridges or support."""
    strong = evidence.filter(~F.col("suppressed")).select("anchor", "other").distinct().join(members.select(F.col("address").alias("anchor"), "candidate"), "anchor")
    edges = strong.groupBy("candidate").agg(F.count("*").alias("edges"))
    sizes = members.groupBy("candidate").agg(F.count("*").alias("member_count"))
    return sizes.join(edges, "candidate", "left").select("candidate", "member_count", F.coalesce("edges", F.lit(0)).cast("long").alias("strong_evidence_edge_count"))


def candidate_entities(members: DataFrame, evidence: DataFrame, supporting: DataFrame) -> DataFrame:
    """Size, evidence, density, degrees, bridges and robustness of every candidate."""
    accepted = evidence.filter(~F.col("suppressed")).select("anchor", "other", "txid").distinct()
    pairs = accepted.groupBy("anchor", "other").agg(F.count("*").alias("sources"))
    home = members.select(F.col("address").alias("anchor"), "candidate")
    fragile = bridges(pairs.select(F.col("anchor").alias("a"), F.col("other").alias("b"))).select(F.col("a").alias("anchor"), F.col("b").alias("other"), F.lit(True).alias("bridge"))
    edges = pairs.join(home, "anchor").join(fragile, ["anchor", "other"], "left")
    by_edge = edges.groupBy("candidate").agg(F.count("*").alias("edges"), F.count_if(F.col("bridge") & (F.col("sources") == 1)).alias("fragile"))
    merges = accepted.join(home, "anchor").groupBy("candidate").agg(F.count_distinct("txid").alias("merges"))
    degree = edges.select("candidate", F.explode(F.array("anchor", "other")).alias("address")).groupBy("candidate", "address").agg(F.count("*").alias("degree"))
    direct = edges.filter("anchor = candidate").select(F.col("other").alias("address"), F.lit(1).alias("direct"))
    size = (
        members.join(degree, ["candidate", "address"], "left").join(direct, "address", "left").groupBy("candidate")
        .agg(F.count("*").alias("members"), F.min(F.coalesce("degree", F.lit(0))).alias("minimum_degree"), F.count_if((F.col("address") != F.col("candidate")) & F.col("direct").isNull()).alias("transitive_only"))
    )
    ends = supporting.join(home, "anchor").join(members.select(F.col("address").alias("other"), F.col("candidate").alias("other_candidate")), "other")
    support = ends.select(F.explode(F.array_distinct(F.array("candidate", "other_candidate"))).alias("candidate")).groupBy("candidate").agg(F.count("*").alias("supporting"))
    joined = size.join(by_edge, "candidate", "left").join(merges, "candidate", "left").join(support, "candidate", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    n, e = F.col("members"), zero("edges")
    return joined.select(
        "candidate", n.alias("member_count"), e.alias("strong_evidence_edge_count"), zero("supporting").alias("supporting_evidence_count"), zero("merges").alias("merge_transaction_count"), zero("fragile").alias("fragile_bridge_count"),
        F.when(n > 1, e / (n * (n - 1) / 2)).otherwise(0.0).alias("edge_density"), zero("minimum_degree").alias("minimum_degree"), F.col("transitive_only").alias("transitive_only_member_count"),
        F.when(e > 0, 1 - zero("fragile") / e).otherwise(1.0).alias("robustness_score"),
    )


def candidate_memberships(members: DataFrame, evidence: DataFrame) -> DataFrame:
    """How each address is tied to its candidate."""
    accepted = evidence.filter(~F.col("suppressed")).select("anchor", "other", "txid").distinct()
    home = members.select(F.col("address").alias("anchor"), "candidate")
    tied = accepted.join(home, "anchor")
    total = tied.groupBy("candidate").agg(F.count_distinct("txid").alias("total"))
    own = tied.select("candidate", "txid", F.explode(F.array("anchor", "other")).alias("address")).groupBy("address").agg(F.count_distinct("txid").alias("own"))
    direct = tied.filter("anchor = candidate").select(F.col("other").alias("address"), F.lit(True).alias("d")).distinct()
    joined = members.join(total, "candidate", "left").join(own, "address", "left").join(direct, "address", "left")
    is_direct = F.coalesce("d", F.col("address") == F.col("candidate"))
    return joined.select("candidate", "address", F.when(F.col("total").isNull(), 1.0).otherwise(F.coalesce("own", F.lit(0)) / F.col("total")).alias("membership_support"), is_direct.alias("direct_to_anchor"), (~is_direct).alias("transitive_only"), F.coalesce("own", F.lit(0)).cast("long").alias("accepted_evidence_count"))


def cooccurrence_weights(t: Tables) -> DataFrame:
    """Pairs of inputs (a < b) and the number of transactions that spend both."""
    rows = t["transaction_inputs"].select("txid", "address").distinct()
    left, right = rows.withColumnRenamed("address", "a"), rows.withColumnRenamed("address", "b")
    return left.join(right, "txid").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("weight"))


def content_ids(members: DataFrame, namespace: str) -> DataFrame:
    """Candidates named by the SHA-256 of the compact JSON list of the namespace and the sorted members."""
    listed = members.groupBy("candidate").agg(F.array_sort(F.collect_list("address")).alias("m"))
    return listed.select("candidate", F.sha2(F.to_json(F.concat(F.array(F.lit(namespace)), F.col("m"))), 256).alias("content_id"))


# Evaluation against known entities


def contingency(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts of (truth, predicted) with the sizes of both."""
    cells = rows.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    return cells.join(cells.groupBy("t").agg(F.sum("n").alias("tn")), "t").join(cells.groupBy("p").agg(F.sum("n").alias("pn")), "p")


def clustering_metrics(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Pairwise and B-cubed precision, recall and F1, adjusted Rand index, over-merged and fragmented shares; one row."""
    cells = contingency(rows, truth, predicted)
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    by_cell = cells.agg(two("n").alias("tp"), F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n") / F.col("pn")).alias("bp"), F.sum(F.col("n") * F.col("n") / F.col("tn")).alias("br"))
    by_truth = cells.groupBy("t").agg(F.max("tn").alias("tn"), F.count("*").alias("k")).agg(two("tn").alias("truth_pairs"), F.avg((F.col("k") > 1).cast("int")).alias("fragmented"))
    by_pred = cells.groupBy("p").agg(F.max("pn").alias("pn"), F.count("*").alias("k")).agg(two("pn").alias("pred_pairs"), F.avg((F.col("k") > 1).cast("int")).alias("overmerged"), F.count("*").alias("candidates"))
    one = by_cell.crossJoin(by_truth).crossJoin(by_pred)
    p, r = F.when(F.col("pred_pairs") > 0, F.col("tp") / F.col("pred_pairs")).otherwise(1.0), F.when(F.col("truth_pairs") > 0, F.col("tp") / F.col("truth_pairs")).otherwise(1.0)
    bp, br = F.col("bp") / F.col("total"), F.col("br") / F.col("total")
    f1 = lambda a, b: F.when(a + b > 0, 2 * a * b / (a + b)).otherwise(0.0)
    pairs = F.col("total") * (F.col("total") - 1) / 2
    chance = F.when(pairs > 0, F.col("truth_pairs") * F.col("pred_pairs") / pairs).otherwise(0.0)
    spread = (F.col("truth_pairs") + F.col("pred_pairs")) / 2 - chance
    return one.select(
        p.alias("pairwise_precision"), r.alias("pairwise_recall"), f1(p, r).alias("pairwise_f1"), bp.alias("b_cubed_precision"), br.alias("b_cubed_recall"), f1(bp, br).alias("b_cubed_f1"),
        F.when(spread != 0, (F.col("tp") - chance) / spread).otherwise(1.0).alias("adjusted_rand_index"), F.col("overmerged").alias("overmerged_candidate_rate"), F.col("fragmented").alias("fragmented_entity_rate"), F.col("candidates").alias("candidate_count"),
    )


def per_entity_overlap(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """For each true entity the candidate with the largest overlap (the greatest name among equals)."""
    best = contingency(rows, truth, predicted).groupBy("t").agg(F.max_by(F.struct("p", "n", "pn"), F.struct("n", "p")).alias("b"), F.max("tn").alias("address_count"), F.count("*").alias("fragment_count"))
    return best.select(F.col("t").alias("truth_entity"), "address_count", F.col("b.p").alias("best_candidate"), F.col("b.n").alias("best_overlap"), (F.col("b.n") / F.col("b.pn")).alias("precision"), (F.col("b.n") / F.col("address_count")).alias("recall"), "fragment_count")


def adjusted_mutual_information(rows: DataFrame, truth: str, predicted: str) -> float:
    """Mutual information beyond what chance gives, over the mean entropy beyond it; 1 for equal partitions.

    What chance gives depends on the sizes of groups only, and equal sizes are
    taken together, so the driver sees one row for each size that occurs.
    """
    cells = contingency(rows, truth, predicted)
    n = rows.count()
    if not n:
        return 1.0
    mutual = cells.agg(F.sum(F.col("n") / n * F.log(F.col("n") * n / (F.col("tn") * F.col("pn"))))).first()[0]

    def sizes(side: str) -> list[tuple[int, int]]:
        by = cells.groupBy(side).agg(F.max(f"{side}n").alias("size")).groupBy("size").agg(F.count("*").alias("k"))
        return [(r["size"], r["k"]) for r in by.collect()]

    a, b = sizes("t"), sizes("p")
    entropy = lambda s: -sum(k * x / n * math.log(x / n) for x, k in s)
    if sum(k for _, k in a) == sum(k for _, k in b) and sum(k for _, k in a) in (1, n):
        return 1.0
    log = math.lgamma
    expected = 0.0
    for x, k in a:
        for y, m in b:
            low, high = max(1, x + y - n), min(x, y)
            i = np.arange(low, high + 1, dtype=np.float64)
            lg = np.vectorize(log, otypes=[float])
            weight = np.exp(log(x + 1) + log(y + 1) + log(n - x + 1) + log(n - y + 1) - log(n + 1) - lg(i + 1) - lg(x - i + 1) - lg(y - i + 1) - lg(n - x - y + i + 1))
            expected += k * m * float((i / n * np.log(n * i / (x * y)) * weight).sum())
    spread = (entropy(a) + entropy(b)) / 2 - expected
    return float((mutual - expected) / (math.copysign(max(abs(spread), 2.2e-16), spread)))


def collaborative_false_merges(members: DataFrame, truth: DataFrame, collaborative: DataFrame) -> DataFrame:
    """One row: transactions of several parties with two known inputs at least, and the share that a candidate merges.

    ``members`` has (address, candidate), ``truth`` (address, entity_id) and
    ``collaborative`` (txid, input_addresses).
    """
    inputs = collaborative.select("txid", F.explode(F.array_distinct("input_addresses")).alias("address")).join(truth.select("address", "entity_id"), "address").join(members, "address")
    cells = inputs.groupBy("txid", "candidate").agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("owners"))
    by_tx = cells.groupBy("txid").agg(F.sum("n").alias("n"), F.max("owners").alias("owners")).filter("n >= 2")
    merged = F.count_if(F.col("owners") > 1)
    return by_tx.agg(F.count("*").alias("collaborative_transaction_count"), F.when(F.count("*") > 0, merged / F.count("*")).otherwise(0.0).alias("collaborative_false_merge_rate"))


def value_checks(t: Tables, members: DataFrame, evidence: DataFrame, candidates: DataFrame, detector: DataFrame) -> DataFrame:
    """(code, breaches): whether a stored set of hypotheses is what the tables and its own evidence give.

    Addresses are covered once; candidates are the components of the evidence
    that is not suppressed; evidence and detector are what the transactions
    give; sizes and evidence counts of candidates are those of their members.
    """
    from .integrity import bag_difference, excess, set_difference, tagged, together

    known = stored(all_addresses(t))
    again = stored(collaborative_detector(t))
    stated = cospend_evidence(t, again)
    rebuilt = memberships(known, evidence)
    counted = members.groupBy("candidate").agg(F.count("*").alias("member_count"))
    strong = evidence.filter(~F.col("suppressed")).join(members.select(F.col("address").alias("anchor"), "candidate"), "anchor")
    edges = strong.select("candidate", "anchor", "other").distinct().groupBy("candidate").agg(F.count("*").alias("strong_evidence_edge_count"))
    diagnosed = counted.join(edges, "candidate", "left").select("candidate", "member_count", F.coalesce("strong_evidence_edge_count", F.lit(0)).cast("long").alias("strong_evidence_edge_count"))
    across = strong.join(members.select(F.col("address").alias("other"), F.col("candidate").alias("other_candidate")), "other").filter("candidate <> other_candidate")
    return together(
        [
            tagged("MEMBERSHIP_ADDRESS_COVERAGE_MISMATCH", set_difference(members.select("address"), known)),
            tagged("DUPLICATE_MEMBERSHIP", excess(members, ("address",)), F.sum("excess")),
            tagged("CANDIDATE_SET_MISMATCH", set_difference(members.select("candidate"), candidates.select("candidate"))),
            tagged("MEMBERSHIP_EVIDENCE_MISMATCH", set_difference(members.select("address", "candidate"), rebuilt)),
            tagged("INVALID_OWNERSHIP_EVIDENCE", across),
            tagged("STRONG_EVIDENCE_COVERAGE_MISMATCH", bag_difference(evidence.select("anchor", "other", "txid", "suppressed"), stated)),
            tagged("CANDIDATE_DIAGNOSTIC_MISMATCH", set_difference(candidates.select("candidate", "member_count", "strong_evidence_edge_count"), diagnosed)),
            tagged("COLLABORATIVE_DETECTOR_MISMATCH", bag_difference(detector, again)),
        ]
    )


def community_checks(communities: DataFrame, known: DataFrame, key: str = "address") -> DataFrame:
    """(code, breaches): every address once; sizes as counted; noise without a community and of size 0."""
    from .integrity import set_difference, tagged, together

    counted = communities.filter("community IS NOT NULL").groupBy("community").agg(F.count("*").alias("n"))
    return together(
        [
            tagged("COMMUNITY_ADDRESS_COVERAGE_MISMATCH", set_difference(communities.select(key), known.select(key))),
            tagged("COMMUNITY_ID_OR_SIZE_MISMATCH", communities.filter("community IS NOT NULL").join(counted, "community").filter("n <> community_size")),
            tagged("INVALID_BEHAVIORAL_NOISE_ENCODING", communities.filter("is_noise <> (community IS NULL) OR (is_noise AND community_size <> 0)")),
        ]
    )
