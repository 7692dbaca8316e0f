import random

import pytest

from lodestone.operators import entity


def in_order(nodes, edges):
    cluster = {i: i for i, _ in nodes}
    single = {i: k == "u" for i, k in nodes}
    for _, a, b in sorted((-c, a, b) for a, b, c in edges):
        x, y = sorted((cluster[a], cluster[b]))
        if x != y and sum(single[i] for i in cluster if cluster[i] in (x, y)) <= 1:
            cluster = {i: x if c == y else c for i, c in cluster.items()}
    return cluster


@pytest.mark.parametrize("seed", range(3))
def test_constrained_clusters_equal_the_edges_taken_in_order(spark, seed):
    rng = random.Random(seed)
    nodes = [(k, "u" if rng.random() < 0.2 else "p") for k in range(40)]
    edges = list({(a, b): (a, b, rng.randrange(1, 9) / 10) for _ in range(90) for a, b in [sorted(rng.sample(range(40), 2))]}.values())
    got = entity.constrained_clusters(spark.createDataFrame(nodes, "id long, kind string"), spark.createDataFrame(edges, "a long, b long, conf double"), "u")
    assert {r.id: r.cluster for r in got.collect()} == in_order(nodes, edges)


def test_constrained_clusters_without_edges_or_nodes(spark):
    nodes, edges = spark.createDataFrame([(2, "p"), (1, "u")], "id long, kind string"), spark.createDataFrame([], "a long, b long, conf double")
    assert sorted(map(tuple, entity.constrained_clusters(nodes, edges, "u").collect())) == [(1, 1), (2, 2)]
    assert entity.constrained_clusters(nodes.filter("false"), edges, "u").collect() == []


def test_components_of_chains_hubs_and_text_ids(spark):
    chain = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1400)] + [(5, 5)]
    got = {r.node: r.component for r in entity.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(301)} | {k: 1000 for k in range(1000, 1400)}
    text = spark.createDataFrame([("b", "a"), ("c", "b"), ("y", "x")], "a string, b string")
    assert {r.node: r.component for r in entity.components(text).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_near_names_by_force(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("abcd") for _ in range(rng.randrange(3, 9))) + " " + "".join(rng.choice("ab") for _ in range(rng.randrange(2, 6))) for _ in range(50)]
    rows = [(k, n if rng.random() < 0.7 else " ".join(reversed(n.split())), k % 2) for k, n in enumerate(names + names[:20])] + [(99, None, 0), (98, "", 0)]
    got = {(r.a, r.b): r.ratio for r in entity.fuzzy_edges(spark.createDataFrame(rows, "k long, n string, g int"), "k", "n", ["g"], 80).collect()}
    want = {(a, b): entity.token_sort_ratio(x, y) for a, x, g in rows for b, y, h in rows if a < b and g == h and x and y and entity.token_sort_ratio(x, y) >= 80}
    assert got == pytest.approx(want) and len(want) > 30


def test_ancestors_of_long_chains_forks_and_rings(spark):
    # a recursive query stops at 100 levels
    chain = [(i, i + 1) for i in range(150)]
    got = entity.ancestors(spark.createDataFrame(chain, "node long, parent long")).collect()
    assert sorted(map(tuple, got)) == [(i, j) for i in range(150) for j in range(i + 1, 151)]
    # two ways to one ancestor are two rows, as in UNION ALL; nulls lead nowhere
    fork = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, None), (None, 5)], "node long, parent long")
    assert sorted(map(tuple, entity.ancestors(fork).collect())) == [(1, 2), (1, 3), (1, 4), (1, 4), (2, 4), (3, 4)]
    assert entity.ancestors(fork.filter("false")).collect() == []
    with pytest.raises(ValueError, match="own ancestors"):
        entity.ancestors(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 1)], "node long, parent long"))
