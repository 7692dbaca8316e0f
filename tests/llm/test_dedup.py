"""Exact, near and line dedup against brute force."""
import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from lodestone.llm import exact_dedup, graph, kernel, line_dedup, near_dedup, queries
from tests.llm.data import SF, texts_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def components_of(texts, num, den=100):
    sets = {i: shingles(t) for i, t in texts}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * den >= num * max(len(x), len(y)):
                both = len(x & y)
                if den * both >= num * (len(x) + len(y) - both):
                    lo, hi = sorted((find(a), find(b)))
                    parent[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in ids}


def varied(seed=3):
    """Chains of edited copies, tiny texts, blanks and nulls."""
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(30))
    out = [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "One"), (9004, "one"), (9005, "a b c d"), (9006, "A B c D"), (9007, "a b c e"), (9008, "one two")]
    for base in range(12):
        words = [word() for _ in range(rng.choice([6, 20, 60, 300]))]
        for copy in range(6):
            out.append((base * 10 + copy, " ".join(words)))
            words = list(words)
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = word()
    return out


@pytest.mark.parametrize("num", [85, 80])
def test_near_duplicates(spark, num):
    texts = [r for r in texts_of("documents") if r[0] < 10**9] + [(i + 10**6, t) for i, t in varied()]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, rep string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, 5, (num, 100)).collect()}
    assert got == components_of(texts, num)


def test_near_duplicates_hot_group(spark):
    """One group of near copies, all different, among which no hub is near to all."""
    words = [f"w{i}" for i in range(200)]
    texts = []
    for k in range(150):
        words[k % 200] = f"v{k}"
        texts.append((k, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == components_of(texts, 85)


def test_near_duplicates_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, band int")
    assert near_dedup.drop_near_duplicates(empty).columns == ["doc_id", "text", "band"] and near_dedup.near_duplicates(empty).count() == 0
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "a b c"), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(twice).filter("doc_id IS NOT NULL").collect()) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    assert [(r.component_id, r.kept) for r in near_dedup.near_duplicates(twice).filter("doc_id IS NULL").collect()] == [(1, False)]
    assert sorted(str(r.doc_id) for r in near_dedup.drop_near_duplicates(twice).collect()) == ["1", "1", "3"]
    alone = spark.createDataFrame([(None, "a b c"), (None, "a b  c"), (None, "x y z"), (None, None)], "doc_id long, text string")
    assert sorted((str(r.component_id), r.kept) for r in near_dedup.near_duplicates(alone).collect()) == [("None", False)] + [("None", True)] * 3
    assert near_dedup.drop_near_duplicates(alone).count() == 3


def test_one_id_with_two_texts(spark):
    """Each row gets the component of its own text, and only the copy goes."""
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:-1], "other"])
    docs = spark.createDataFrame([(1, "one text of its own that is here"), (1, near), (2, " ".join(words)), (0, " ".join(words)), (3, "quite another text that stands alone")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect())
    assert got == [(0, 56, 0), (1, 4, 1), (1, 56, 0), (2, 56, 0), (3, 2, 3)]
    assert sorted(map(tuple, near_dedup.drop_near_duplicates(docs).collect())) == [(0, " ".join(words)), (1, "one text of its own that is here"), (3, "quite another text that stands alone")]


def test_boilerplate_that_links_nothing(spark):
    """Half of every text is common, so buckets are hot, but only a few pairs are near: none is lost."""
    rng = random.Random(11)
    common = [f"c{i}" for i in range(100)]
    texts = []
    for k in range(120):
        own = [f"o{rng.randrange(10**6)}" for _ in range(100)]
        texts.append((k, " ".join(common + own)))
        if k % 10 == 0:
            own[50] = "edited"
            texts.append((1000 + k, " ".join(common + own)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == components_of(texts, 85) and sum(i != c for i, (_, c) in got.items()) == 12


@pytest.mark.parametrize("size", [6, 7, 12, 40, 150, 600, 4000])
def test_recall_of_bands(size):
    """Pairs just over the threshold share a band: measured with real registers, borrowed ones too."""
    rng = np.random.default_rng(size)
    for num in (80, 85):
        change = next(k for k in range(size, -1, -1) if 100 * (size - k) >= num * (size + k))  # each side has k of its own
        sets = []
        for _ in range(600 if size < 1000 else 60):
            both, a, b = rng.integers(0, 2**64, size - change, np.uint64), rng.integers(0, 2**64, change, np.uint64), rng.integers(0, 2**64, change, np.uint64)
            sets += [np.concatenate([both, a]), np.concatenate([both, b])]
        bands = near_dedup.band_hashes(near_dedup.registers(sets))
        assert (bands[::2] == bands[1::2]).any(1).mean() == 1


def thue_morse(n=11):
    word = [0]
    for _ in range(n):
        word += [1 - x for x in word]
    return "".join("ab"[x] for x in word), "".join("ba"[x] for x in word)


@pytest.mark.parametrize("n", [11, 13])
def test_words_that_polynomials_modulo_powers_of_two_confuse(spark, n):
    a, b = thue_morse(n)
    texts = [(1, f"{a} p q r s t"), (2, f"{b} p q r s t"), (3, a), (4, b), (5, a)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()} == components_of(texts, 85)
    lines = spark.createDataFrame([(1, a), (2, b), (3, f"{b}\n{a}")], "doc_id long, text string")
    got = sorted(map(tuple, line_dedup.repeated_lines(lines).collect()))
    assert got == [(3, 0, 2, 0, True), (3, 1, 1, 0, True)]


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.8, 0.95):
        pool = rng.integers(0, 2**64, 12000, dtype=np.uint64)
        n = int(4000 * share * 2 / (1 + share))
        a, b = np.unique(pool[:4000]), np.unique(np.concatenate([pool[:n], pool[8000 : 12000 - n]]))
        ra, rb = near_dedup.registers([a, b])
        found, used = near_dedup.estimate(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]))
        assert used[0] == near_dedup.BUCKETS and abs(found[0] - share) < 0.16


def test_chance_of_agreement():
    """The correction against registers of unrelated sets, by their sizes."""
    rng = np.random.default_rng(4)
    for na, nb in ((100, 100), (1000, 1000), (400, 4000), (20_000, 20_000)):
        agree = full = 0
        for _ in range(max(60, 400_000 // (na + nb))):
            ra, rb = near_dedup.registers([rng.integers(0, 2**64, n, np.uint64) for n in (na, nb)])
            both = (ra != near_dedup.EMPTY) & (rb != near_dedup.EMPTY)
            agree, full = agree + int((ra == rb)[both].sum()), full + int(both.sum())
        want = float(near_dedup.chance(np.array([na]), np.array([nb]))[0]) * full
        assert abs(agree - want) <= 5 * want**0.5 + 1, (na, nb, agree, want)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in list(parent)}


def test_exact(spark):
    texts = texts_of("documents") + [(9000001, None), (9000002, ""), (9000003, "ÄB"), (9000004, "äb"), (9000005, "Äb"), (9000005, "Äb"), (9000006, "x" * 2_000_000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, digest int")
    groups = defaultdict(list)
    for i, t in texts:
        groups[(t or "").translate(LOWER)].append(i)
    want = sorted((i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert sorted(map(tuple, exact_dedup.duplicates(docs).collect())) == want
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(w[0] for w in want if w[3])
    assert exact_dedup.duplicates(docs.limit(0)).count() == 0


def test_exact_by_ranges(spark, monkeypatch):
    """More rows than one filter has room for are dealt by hash ranges, also into filters that are nearly full."""
    monkeypatch.setattr(exact_dedup, "MAX_SLOTS", 1 << 8)
    docs = spark.createDataFrame([(i, f"t{i % 40}") for i in range(60)], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.duplicates(docs).collect()}
    assert got == {i: (i % 40 + 40, 2) if i % 40 < 20 else (i, 1) for i in range(60)}


def test_exact_plans_do_not_grow_with_the_ranges(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"t{i % 40}") for i in range(600)], "doc_id long, text string").repartition(2)

    def shape(slots):
        monkeypatch.setattr(exact_dedup, "MAX_SLOTS", slots)
        plan = exact_dedup.duplicates(docs)._jdf.queryExecution().executedPlan().toString()
        return plan.count("Scan parquet"), plan.count("BroadcastExchange")

    assert shape(1 << 27) == shape(1 << 11)  # one range, five ranges


def test_exact_rows_that_share_an_id(spark):
    docs = spark.createDataFrame([(1, "own text"), (1, "copy"), (5, "Copy"), (None, "copy"), (None, "alone"), (None, None)], "doc_id long, text string")
    assert sorted(map(str, map(tuple, exact_dedup.drop_duplicates(docs).collect()))) == ["(1, 'own text')", "(5, 'Copy')", "(None, 'alone')", "(None, None)"]


def lines_by_force(texts, least=line_dedup.NEAR_CHARS):
    found = []
    seen = []
    for doc, text in sorted((i, t) for i, t in texts if t is not None):
        for n, line in enumerate(text.split("\n")):
            body = line.strip("\t\n\x0b\x0c\r ").translate(LOWER)
            if body:
                seen.append((doc, n, body))
    for k, (doc, n, body) in enumerate(seen):
        same = [(d, m) for d, m, b in seen[:k] if b == body]
        near = [(d, m) for d, m, b in seen[:k] if b != body and min(len(b), len(body)) >= least and line_dedup.within_one(b, body)]
        if same:
            found.append((doc, n, *min(same), True))
        elif near:
            found.append((doc, n, *min(near), False))
    return sorted(found)


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_within_one():
    rng = random.Random(2)
    for _ in range(3000):
        a, b = (bytes(rng.choice(b"ab") for _ in range(rng.randrange(6))) for _ in range(2))
        assert line_dedup.within_one(a, b) == (slow_distance(a, b) <= 1), (a, b)


def edited(seed=4):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdef ghi") for _ in range(rng.randrange(24, 60))).strip() + "end" for _ in range(30)]
    texts = []
    for doc in range(40):
        lines = []
        for _ in range(rng.randrange(6)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                p = rng.randrange(len(line))
                how = rng.randrange(3)
                line[p : p + (how < 2)] = [] if how == 0 else [rng.choice("xyzé")]
            lines.append(rng.choice(["", "  "]) + "".join(line).upper() if rng.random() < 0.2 else "".join(line))
        texts.append((doc, "\n".join(lines)))
    return texts + [(100, None), (101, ""), (102, "\n\n"), (103, "é" * 30), (104, "é" * 30 + "\r"), (105, "z" * 500_000)]


def test_repeated_lines(spark):
    texts = edited()
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, line int")
    got = sorted(map(tuple, line_dedup.repeated_lines(docs).collect()))
    want = lines_by_force(texts)
    assert [(g[0], g[1], g[4]) for g in got] == [(w[0], w[1], w[4]) for w in want]
    assert [g for g in got if not g[4]] == [w for w in want if not w[4]]


def test_short_lines_are_compared_exactly(spark):
    import corpus_pipeline

    a = "the first long line of the text"
    texts = [(1, f"les.\n{a}\n\nx"), (2, f" LES. \nlex.\n{a}!\n\nx"), (3, "les."), (4, "own\n\n\nles."), (5, None), (6, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = lines_by_force(texts)
    assert sorted(map(tuple, line_dedup.repeated_lines(docs).collect())) == want and len(want) == 5
    kept = corpus_pipeline.lines(spark, docs, SF).orderBy("doc_id").collect()
    assert [tuple(r) for r in kept] == [(1, texts[0][1]), (2, "lex.\n"), (4, "own\n\n"), (5, None), (6, "")]


def test_drop_repeated_lines(spark):
    a, b = "the first long line of the text", "another long line that stands here"
    docs = spark.createDataFrame([(1, f"{a}\n{b}", 0), (2, f"{a}!\nshort\n{b}", 0), (3, a, 0), (4, None, 0), (5, "", 0), (6, "short", 0)], "doc_id long, text string, n_chars int")
    assert [tuple(r) for r in line_dedup.drop_repeated_lines(docs).orderBy("doc_id").collect()] == [(1, f"{a}\n{b}", len(a) + len(b) + 1), (2, "short", 5), (4, None, None), (5, "", 0)]
    assert line_dedup.drop_repeated_lines(docs.limit(0)).count() == 0


def test_lines_of_rows_that_share_an_id(spark):
    a, b = "the first long line of the text", "another long line that stands here"
    rows = [(1, f"{a}\n{b}"), (1, "own line\nsecond own line"), (None, f"{a}\nits own"), (0, f"{b}\n{b}"), (0, f"{b}\n{b}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, map(tuple, line_dedup.drop_repeated_lines(docs).collect()))) == sorted(map(str, [(1, a), (1, "own line\nsecond own line"), (None, "its own"), (0, b), (0, b)]))


def test_an_edit_is_a_character(spark):
    texts = [(1, "une ligne assez longue où l'été dure"), (2, "une ligne assez longue ou l'été dure"), (3, "une ligne assez longue où l'ét dure"), (4, "une ligne assez longue où l'ete dure")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(map(tuple, line_dedup.repeated_lines(docs).collect())) == lines_by_force(texts) == [(2, 0, 1, 0, False), (3, 0, 1, 0, False)]


def test_shingle_sets():
    import pyarrow as pa

    texts = [t for _, t in varied()]
    for text, got in zip(texts, kernel.shingle_sets(pa.array(texts, pa.string()), 5), strict=True):
        assert len(got) == len(shingles(text))


def test_queries_cover_every_row(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert queries.op7_exact_dedup(spark, SF).count() == n
