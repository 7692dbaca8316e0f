"""Pigeonhole edit matching against plain dynamic programming."""
import random

import numpy as np
import pytest

from lodestone.llm import decontamination, queries
from tests.llm.data import SF, rows, texts_of


def least(pattern: bytes, text: bytes) -> int:
    """Least edit distance of pattern to a substring of text, by columns."""
    p = np.frombuffer(pattern, np.uint8)
    column = np.arange(len(p) + 1)
    steps = np.arange(len(p) + 1)
    best = int(column[-1])
    for c in text:
        new = np.empty_like(column)
        new[0] = 0
        new[1:] = np.minimum(column[:-1] + (p != c), column[1:] + 1)
        column = np.minimum.accumulate(new - steps) + steps
        best = min(best, int(column[-1]))
    return best


def mangled(rng, body, n):
    body = list(body)
    for _ in range(n):
        p = rng.randrange(1, len(body) - 1)
        how = rng.randrange(3)
        body[p : p + (how < 2)] = [] if how == 0 else [rng.choice("qxz")]
    return "".join(body)


def test_myers():
    rng = random.Random(7)
    for _ in range(400):
        p, t = (bytes(rng.choice(b"abc") for _ in range(n)) for n in (rng.randrange(1, 40), rng.randrange(60)))
        assert decontamination.myers(decontamination.masks(p), len(p), t)[0] == least(p, t)


def test_against_dynamic_programming(spark):
    rng = random.Random(8)
    items = [(i, t) for i, t in rows("benchmark", "item_id", "text")][:12]
    texts = [(i, t[:1500]) for i, t in texts_of("documents")[:25]]
    for k in range(60):
        _, body = rng.choice(items)
        budget = int(len(decontamination.normal(body)) * decontamination.RATE)
        texts.append((10**6 + k, "before the text " + mangled(rng, body, rng.choice([0, 1, budget, budget + 3])).upper().replace(" ", "  \n") + " after"))
    texts += [(1, None), (2, ""), (3, items[0][1][:50])]
    want = set()
    for doc, text in texts:
        body = decontamination.normal(text or "")
        for item, t in items:
            p = decontamination.normal(t)
            budget = max(0, min(int(len(p) * decontamination.RATE), len(p) // 8 - 1))
            if p and budget and (d := least(p, body)) <= budget:
                want.add((doc, item, d))
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([*items, (900, None), (901, ""), (902, " \n"), (903, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in decontamination.leaks(docs, bench).collect()}
    assert got == want and len({x[2] for x in want}) > 2
    left = decontamination.drop_leaks(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, _ in texts if i not in {x[0] for x in want})


def test_blocks_and_repeats(spark, monkeypatch):
    items = rows("benchmark", "item_id", "text")
    bench = spark.createDataFrame(items + items[:3], "item_id long, text string")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = sorted(map(tuple, decontamination.leaks(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 1500)
    assert sorted(map(tuple, decontamination.leaks(docs, bench).collect())) == one
    assert sorted(r[:4] for r in one) == sorted(map(tuple, queries.op4_decontamination(spark, SF).collect()))
    assert decontamination.leaks(docs.limit(0), bench).count() == 0 and decontamination.leaks(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("case", ["verbatim"])
def test_verbatim_passages_are_found(spark, case):
    items = [(i, decontamination.normal(t)) for i, t in rows("benchmark", "item_id", "text") if t]
    found = {(r.doc_id, r.item_id) for r in queries.op4_decontamination(spark, SF).collect()}
    for doc, text in texts_of("documents"):
        body = decontamination.normal(text or "")
        for item, p in items:
            assert p not in body or (doc, item) in found


SHORT = [
    (1, "Yes"), (2, "a b"), (3, "is it so?"), (4, "what is the capital of x"), (5, "ΟΔΟΣ ΚΑΙ ΠΟΛΙΣ"), (6, "ΟΔΟΣ ΚΑΙ ΠΟΛΙΣ ΚΑΙ ΧΩΡΑ ΚΑΙ ΘΑΛΑΣΣΑ ΜΕΓΑΛΗ"), (7, "İSTANBUL'DA BİR GÜN GEÇİRMEK İSTİYORUM VE DENİZİ GÖRMEK"), (8, "?!"),
]


def test_items_of_any_length_and_script(spark):
    """Items under 20 bytes stand verbatim as whole words; longer ones within their budget; one lower-casing for all."""
    texts = [
        (1, "yes", {1}), (2, "yesterday, yes-men", {1}), (3, "yesterday eyes", set()), (4, "xa b", set()), (5, "a  B", {2}), (6, "so: is it\nso?", {3}), (7, "This it so? no", set()),
        (8, "what is the capitol of x", {4}), (9, "what is a capitol of xs", set()), (10, "ΟΔΟΣ ΚΑΙ ΠΟΛΙΣ", {5}), (11, "οδος και πολις", {5}), (12, SHORT[5][1], {5, 6}), (13, SHORT[5][1].lower(), {5, 6}), (14, SHORT[6][1], {7}),
        (15, "what?!", {8}), (16, None, set()), (17, "", set()), (18, "w " * 300_000 + "yes", {1}),
    ]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    bench = spark.createDataFrame(SHORT, "item_id long, text string")
    got = {}
    for r in decontamination.leaks(docs, bench).collect():
        got.setdefault(r.doc_id, set()).add(r.item_id)
    assert got == {i: w for i, _, w in texts if w}
    assert all(r.distance == 0 for r in decontamination.leaks(docs, bench).filter("doc_id IN (12, 13, 14)").collect())


def test_rows_that_share_an_id(spark):
    item = rows("benchmark", "item_id", "text")[0][1]
    docs = spark.createDataFrame([(1, "a clean text"), (1, f"x {item} y"), (None, item), (None, "another clean text"), (2, item), (2, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert sorted(map(str, map(tuple, decontamination.drop_leaks(docs, bench).collect()))) == ["(1, 'a clean text')", "(None, 'another clean text')"]
    assert sorted(str(r.doc_id) for r in decontamination.leaks(docs, bench).collect()) == ["1", "2", "2", "None"]
