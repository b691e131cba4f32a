"""Density clustering by a hierarchy of mutual reachability (HDBSCAN), on a bounded set of points."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import distances, reference_points

# The columns of an address that tell how it behaves.
BEHAVIOUR = (
    "input_occurrence_count", "output_occurrence_count", "unique_input_tx_count", "unique_output_tx_count", "unique_tx_count", "total_input_sats", "total_output_sats", "mean_input_sats", "mean_output_sats", "input_output_tx_ratio",
    "input_output_value_ratio", "co_transaction_address_count", "network_observation_count", "observation_span_seconds", "mean_inter_observation_seconds", "active_hour_count", "observations_per_active_hour", "bipartite_component_size",
)

#: Points that are clustered together; of more, these are chosen by a hash and the others follow their nearest.
LIMIT = 4_000


@dataclass
class Clustering:
    """Labels of the points (-1: noise) and how dense each one's place in its cluster is."""

    labels: np.ndarray
    strength: np.ndarray
    core: np.ndarray


def spanning_tree(x: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Rows (weight, a, b) of a least spanning tree of mutual reachability, lightest first."""
    n = len(x)
    best, source, left = np.full(n, np.inf), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    at, out = 0, []
    left[0] = False
    for _ in range(n - 1):
        d = np.maximum(np.maximum(distances(x[at : at + 1], x)[0], core), core[at])
        nearer = left & (d < best)
        best[nearer], source[nearer] = d[nearer], at
        at = int(np.argmin(np.where(left, best, np.inf)))
        left[at] = False
        out.append((best[at], source[at], at))
    tree = np.array(out).reshape(-1, 3)
    return tree[np.argsort(tree[:, 0], kind="stable")]


def condensed(tree: np.ndarray, n: int, least: int) -> list[tuple[int, int, float, int]]:
    """(parent, child, density, size): where the hierarchy, from its root n down, splits in two of ``least`` points or loses some.

    Children from n on are clusters, below it points.
    """
    children, size, parent = {}, [1] * n, list(range(2 * n - 1))

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for weight, a, b in tree:
        x, y = root(int(a)), root(int(b))
        new = len(size)
        children[new] = (x, y, weight)
        size.append(size[x] + size[y])
        parent[x] = parent[y] = new

    def points(v: int) -> list[int]:
        out, stack = [], [v]
        while stack:
            u = stack.pop()
            if u < n:
                out.append(u)
            else:
                stack += children[u][:2]
        return out

    rows, named, stack = [], n + 1, [(2 * n - 2, n)]
    while stack:
        v, label = stack.pop()
        if v < n:
            continue
        x, y, weight = children[v]
        density = 1 / weight if weight > 0 else np.inf
        big = [u for u in (x, y) if size[u] >= least]
        for u in (x, y):
            if len(big) == 2:
                rows.append((label, named, density, size[u]))
                stack.append((u, named))
                named += 1
            elif u in big:
                stack.append((u, label))
            else:
                rows += [(label, p, density, 1) for p in points(u)]
    return rows


def hdbscan(x: np.ndarray, least: int, near: int) -> Clustering:
    """Clusters of at least ``least`` points by excess of mass; the whole is never one cluster.

    ``near`` is the number of neighbours, the point included, within a point's
    core distance.
    """
    n = len(x)
    labels, strength = np.full(n, -1), np.zeros(n)
    if n < max(2, least):
        return Clustering(labels, strength, np.zeros(n))
    core = np.concatenate([np.partition(distances(x[i : i + 256], x), min(near, n) - 1, axis=1)[:, min(near, n) - 1] for i in range(0, n, 256)])
    rows = condensed(spanning_tree(x, core), n, least)
    born, mass, below = {n: 0.0}, {}, {}
    for parent, child, density, _ in rows:
        if child >= n:
            born[child] = density
            below.setdefault(parent, []).append(child)
    for parent, _, density, size in rows:
        mass[parent] = mass.get(parent, 0.0) + (min(density, 1e300) - min(born[parent], 1e300)) * size
    chosen: set[int] = set()
    worth: dict[int, float] = {}
    for c in sorted(born, reverse=True):
        inner = sum(worth[k] for k in below.get(c, []))
        if c != n and mass.get(c, 0.0) >= inner:
            worth[c] = mass.get(c, 0.0)
            stack = list(below.get(c, []))
            while stack:
                k = stack.pop()
                chosen.discard(k)
                stack += below.get(k, [])
            chosen.add(c)
        else:
            worth[c] = inner
    up = {child: parent for parent, child, _, _ in rows if child >= n}
    number = {c: k for k, c in enumerate(sorted(chosen))}
    for parent, child, density, _ in rows:
        if child < n:
            c = parent
            while c not in chosen and c in up:
                c = up[c]
            if c in chosen:
                labels[child], strength[child] = number[c], density
    return Clustering(labels, strength, core)


def behaviour(features: DataFrame, addresses: DataFrame, key: str = "address") -> DataFrame:
    """(address, features): the behaviour of every address, gaps filled with medians, scaled; raises if one has none.

    Only the columns of behaviour are read from the feature table.
    """
    from ..sources.truth import joined
    from .learning import as_doubles, prepared

    rows = as_doubles(joined(addresses.select(key), features.select(key, *BEHAVIOUR), key, "feature table"), list(BEHAVIOUR)).cache()
    return prepared(rows, list(BEHAVIOUR)).transform(rows).select(key, "features")


def behavioural_communities(points: DataFrame, key: str, least: int = 5, near: int = 5, features: str = "features", limit: int = LIMIT) -> DataFrame:
    """(key, community, community_size, is_noise) of every point; a community is named by its least key, noise has none.

    Of more than ``limit`` points those whose keys hash lowest are clustered;
    every other point joins the cluster of its nearest one if it lies within
    that one's core distance of it, and is noise otherwise.
    """
    ids, x = reference_points(points, key, features, limit)
    found = hdbscan(x, least, near)
    place = {i: k for k, i in enumerate(ids)}
    kind = dict(points.dtypes)[key]

    def assign(batches):
        for pdf in batches:
            own, out = pdf["id"].tolist(), []
            asked = np.array(pdf["x"].tolist(), dtype=np.float64).reshape(len(pdf), -1)
            for i in range(0, len(own), 256):
                d = distances(asked[i : i + 256], x) if len(ids) else np.zeros((len(own[i : i + 256]), 0))
                for r, o in enumerate(own[i : i + 256]):
                    if o in place:
                        out.append(int(found.labels[place[o]]))
                    else:
                        k = int(np.argmin(d[r]))
                        out.append(int(found.labels[k]) if d[r, k] <= found.core[k] else -1)
            yield pd.DataFrame({key: pdf["id"], "label": out})

    labelled = points.select(F.col(key).alias("id"), vector_to_array(features).alias("x")).mapInPandas(assign, f"{key} {kind}, label int")
    groups = labelled.filter("label >= 0").groupBy("label").agg(F.min(key).alias("community"), F.count("*").alias("community_size"))
    joined = labelled.join(F.broadcast(groups), "label", "left")  # at most one row for ``least`` of ``limit`` points
    return joined.select(key, "community", F.coalesce("community_size", F.lit(0)).alias("community_size"), (F.col("label") < 0).alias("is_noise"))
