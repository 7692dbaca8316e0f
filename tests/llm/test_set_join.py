"""The n-gram Jaccard join against brute force over all pairs."""
import random

import numpy as np
import pytest

from lodestone.llm import kernel, queries, set_join
from tests.llm.data import SF, texts_of
from tests.llm.test_dedup import components_of, shingles, varied


def brute(texts, num, width=3):
    sets = {i: shingles(t, width) for i, t in texts}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= num * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in ids}


def got(spark, texts, num=90, width=3, emitting=1.0):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = set_join.jaccard_components(docs, width, (num, 100), emitting)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()}


def groups(seed, copies=25, base=3, words=(9, 12, 30, 90, 300)):
    """Groups of copies with a few words changed: some pairs of a group link and some don't."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    out = []
    for size in words:
        for _ in range(base):
            text = [word() for _ in range(size)]
            for _ in range(copies):
                own = list(text)
                for _ in range(rng.randrange(0, max(2, size // 25) + 1)):
                    at = rng.randrange(len(own))
                    kind = rng.randrange(3)
                    own[at : at + (kind != 1)] = [] if kind == 0 else [word()]
                out.append((len(out), " ".join(own)))
    return out


@pytest.mark.parametrize("emitting", [1.0, 0.0])
def test_equals_brute_force_where_groups_hold_links_and_near_misses(spark, emitting):
    texts = groups(5)
    expected = brute(texts, 90)
    assert len({c for _, c in expected.values()}) > 30  # groups fall apart, so look-ups are needed
    assert got(spark, texts, emitting=emitting) == expected


def test_equals_brute_force_on_tiny_texts_nulls_and_chains(spark):
    texts = varied()
    assert got(spark, texts) == brute(texts, 90)
    assert got(spark, texts, num=80, width=5, emitting=0.0) == components_of(texts, 80)


def test_common_shingles_and_a_hot_group_of_copies(spark):
    rng = random.Random(2)
    common = " ".join(f"licence{k}" for k in range(60))
    texts = [(k, f"{common} " + " ".join(f"t{rng.randrange(10**6)}" for _ in range(rng.choice([8, 20, 60])))) for k in range(60)]
    texts += [(1000 + k, "the same text again and again " * 5) for k in range(60)]
    assert got(spark, texts, emitting=0.0) == brute(texts, 90)


def test_query_equals_brute_force(spark):
    texts = texts_of("documents")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op12_ngram_jaccard_join(spark, SF).collect()}
    assert found == brute(texts, 90)


def test_nulls_repeats_long_texts_empty_tables_and_other_columns(spark):
    assert set_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    long = " ".join(f"v{k % 9000}x{k // 9000}" for k in range(60_000))
    rows = [(5, "A b c d", "x"), (5, "other words stand here", "x"), (None, "a B c d", "x"), (None, None, None), (7, long, "x"), (8, long + " end", "x"), (9, " \t", "x"), (9, " \t", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string").withColumnRenamed("node", "KEY")
    found = sorted(((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in set_join.jaccard_components(docs).collect()), key=str)
    assert found == sorted([(5, 2, 5), (5, 2, 5), (-1, 2, 5), (-1, 0, None), (7, 59_998, 7), (8, 59_999, 7), (9, 0, 9), (9, 0, 9)], key=str)


@pytest.mark.parametrize("num", [80, 85, 90, 95])
def test_bands_reach_every_partner_and_have_a_segment_more_than_they_may_differ_in(num):
    bands = set_join.Bands(num, 100)
    for x in [*range(1, 400), 1000, 4321, 99_999]:
        home = int(bands.of(np.array([x]), False)[0][0])
        for y in range(x, x * 100 // num + 1):
            k = int(bands.of(np.array([y]), False)[0][0])
            assert k in (home, home + 1)
            role = bands.of(np.array([y]), k != home)
            assert int(role[0][0]) == home
            if bands.differ(x, y) > 0 or bands.segments[home]:
                assert bands.wanted(y, home) <= max(1, bands.segments[home]) and bands.differ(x, y) < max(1, bands.segments[home])


def test_choices_add_up_and_cost_no_more_than_once_each():
    rng = np.random.default_rng(4)
    for _ in range(300):
        m = int(rng.integers(1, 40))
        one, two = rng.integers(0, 50, m).astype(float), rng.integers(0, 50, m).astype(float)
        wanted = int(rng.integers(1, m + 1))
        v = set_join.allocated(one, two, wanted)
        assert v.sum() >= wanted and set(v) <= {0, 1, 2}
    # a segment that all share is left out, the others make up for it
    assert set_join.allocated(np.array([1000.0, 1, 1]), np.array([1000.0, 1, 1]), 3).tolist()[0] == 0


def test_a_choice_finds_sets_that_differ_by_less_than_it(spark):
    bands = set_join.Bands(90, 100)
    rng = np.random.default_rng(1)
    s = np.sort(rng.integers(0, 2**63, 100, dtype=np.uint64))
    exact, segment, without = set_join.neighbourhood(s, bands, False)
    assert exact.tolist() == set_join.subset_keys([s], bands, False)[0].tolist()
    for k in (0, 17, 99):
        # one member fewer in one segment: its subset is in the neighbourhood, all others are equal
        sizes = np.array([100])
        band, m = bands.of(sizes, False)
        less = np.delete(s, k)
        seg, code = set_join.placed(less, np.repeat(band, 99), np.repeat(m, 99))
        sums = np.zeros(int(m[0]), kernel.U)
        np.add.at(sums, seg, code)
        keys = set_join.keyed(sums, band, np.arange(int(m[0]))).view(np.int64)
        at = segment[k]
        assert keys[at] == without[k] and (np.delete(keys, at) == np.delete(exact, at)).all()


def test_the_filter_leaves_out_only_what_meets_nothing(spark):
    rng = np.random.default_rng(3)
    keys, kinds = rng.integers(-(2**63), 2**63, 3000), rng.integers(0, 2, 3000).astype(np.int32)
    index = spark.createDataFrame([(int(k), int(x)) for k, x in zip(keys, kinds, strict=True)], "key long, kind int")
    known = set_join._known(index)
    assert set_join.may_meet(known, keys, kinds).all()
    assert set_join.may_meet(known, rng.integers(-(2**63), 2**63, 3000), kinds).mean() < 0.1
