"""Centroid clustering against a plain version with Python's integers."""
import hashlib
import math

import pytest

from lodestone.llm import centroids, queries
from tests.llm.data import SF, rows


def plain(vectors, k=8, rounds=10, dims=64, scale=1024, seed=3):
    """vec_id -> sorted results of its rows, for rows of dims finite components."""
    kept = [(i, tuple(math.floor(scale * float(x)) for x in v)) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    drawn = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), q) for i, q in kept)
    centres = [list(q) for _, q in drawn[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(centres)) for _, q in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(centres)):
            own = [q for (_, q), (_, c) in zip(kept, at, strict=True) if c == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    at = assign()
    inertia = [sum(d for d, c in at if c == j) for j in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, inertia[c], sum(inertia), digest[c]) for (i, _), (d, c) in zip(kept, at, strict=True)), key=str)


def got(found):
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_query_equals_the_plain_version(spark):
    assert got(queries.op13_centroid_clustering(spark, SF)) == plain(rows("embeddings", "vec_id", "embedding"))


def frame(spark, vectors, extra=""):
    return spark.createDataFrame(vectors, "vec_id long, embedding array<double>" + extra)


def test_ties_hot_vectors_repeats_and_rows_that_are_left_out(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(i, [float(i % 5), float(i // 20)]) for i in range(60)] + [(100 + i, [0.5, -0.5]) for i in range(40)]
    vectors += [(3, [9.0, 9.0]), (3, [9.0, 9.0]), (None, [1.0, 1.0]), (None, [0.5, -0.5])]
    odd = [(500, None), (501, []), (502, [1.0]), (503, [1.0, None]), (504, [nan, 0.0]), (505, [0.0, -inf]), (506, [1.0, 2.0, 3.0])]
    for k, rounds in ((8, 10), (3, 1), (2, 0), (200, 2)):
        found = centroids.clusters(frame(spark, vectors + odd), k=k, rounds=rounds, dims=2)
        assert got(found) == plain(vectors, k, rounds, dims=2)


def test_an_empty_table_one_without_kept_rows_and_clashing_columns(spark):
    assert got(centroids.clusters(frame(spark, []), dims=2)) == []
    assert got(centroids.clusters(frame(spark, [(1, None), (2, [1.0])]), dims=2)) == []
    vectors = [(1, [0.25, -0.25], 7, "a"), (2, [1.0, 1.0], 8, "b")]
    found = centroids.clusters(frame(spark, vectors, ", cluster int, Q string"), k=1, dims=2)
    assert got(found) == plain([v[:2] for v in vectors], k=1, dims=2)


def test_a_component_too_large_for_the_sums_is_an_error(spark):
    with pytest.raises(Exception, match="a component is 65536 or more in size"):
        centroids.clusters(frame(spark, [(1, [0.0, 70000.0])]), dims=2).collect()
