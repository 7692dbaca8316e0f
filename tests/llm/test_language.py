"""Language ID: held-out accuracy, rejection and edge cases."""
import random

import pytest

from lodestone.llm import language, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.op3_language_id(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    assert len(got) == len(docs)
    judged = [(got[d.doc_id].lang_pred == d.lang) for d in docs if d.lang is not None and got[d.doc_id].held_out and any(c.isalpha() for c in d.text or "")]
    assert len(judged) > 100 and sum(judged) / len(judged) >= 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    held = language.held_out(docs.doc_id)
    from pyspark.sql import functions as F

    wrong = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(docs.lang))
    a, b = (language.fit(x.filter(~language.held_out(x.doc_id))) for x in (docs, wrong))
    assert a.languages == b.languages and (a.centroids == b.centroids).all()


def test_odd_rows(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(base)
    odd = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "123 !?", 5), (3, "123 !?", 5), (4, "ab " * 400_000, 5)], "doc_id long, text string, score int")
    got = language.predict(odd, model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got[:4]] == ["und"] * 4 and all(r.rejected and r.score == 0 for r in got[:4]) and got[4].lang_pred in model.languages
    none = language.fit(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string"))
    assert none is None and language.predict(odd, none).filter("lang_pred <> 'und'").isEmpty()
    assert language.predict(odd.limit(0), model).count() == 0


def test_rejection_leaves_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = language.drop_rejected(docs)
    assert kept.columns == docs.columns
    left = {r.doc_id for r in kept.select("doc_id").collect()}
    prose = [d.doc_id for d in docs.collect() if d.lang is not None and len((d.text or "").split()) >= 20]
    assert sum(i in left for i in prose) / len(prose) >= 0.98
    foreign = spark.createDataFrame([(-1, "日本語のテキストです。" * 20, None)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert language.predict(foreign, model).first().rejected


def test_unlearned_texts_of_any_length_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(1)
    scripts = [(0x430, 32), (0x3B1, 17), (0x4E00, 3000), (0x627, 20), (0x61, 26)]  # Cyrillic, Greek, Chinese, Arabic, random Latin letters
    odd = [" ".join("".join(chr(first + rng.randrange(n)) for _ in range(rng.randint(2, 9))) for _ in range(words)) for first, n in scripts for words in (20, 100, 500, 3000)]
    texts = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    held = language.held_out(docs.doc_id)
    model = language.fit(docs.filter(~held))
    assert [r.doc_id for r in language.predict(texts, model).collect() if not r.rejected] == []
    prose = {d.doc_id for d in docs.filter(held).collect() if d.lang is not None and len((d.text or "").split()) >= 20}
    kept = language.predict(docs.filter(held), model).filter("not rejected").collect()
    assert len(prose) > 50 and len(prose & {r.doc_id for r in kept}) / len(prose) >= 0.99


@pytest.mark.parametrize("text,want", [("", None), ("1 2", None), ("😀😀 🎉!!", None), ("\U0001f600", None)])
def test_no_letters(text, want):
    assert language.gram_counts(text, language.letter_table()) is want


def test_astral_letters_are_letters(spark):
    letters = language.letter_table()
    assert language.codes("𝔄 😀 𐐨x", letters).tolist() == [ord("𝔄"), 32, ord("𐐨"), ord("x")]
    model = language.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    odd = spark.createDataFrame([(1, "😀😀 🎉!!"), (2, "𐐨𐐨"), (None, "the and of the"), (None, None)], "doc_id long, text string")
    got = {(r.doc_id, r.lang_pred, r.score) for r in language.predict(odd, model).collect()}
    assert (1, "und", 0.0) in got and (None, "und", 0.0) in got and {g[1] for g in got if g[0] == 2} <= set(model.languages) and len(got) == 4


def plain_prediction(model, text):
    """Nearest centroid with dictionaries and loops."""
    code = language.codes(text, language.letter_table())
    if code is None:
        return "und", 0.0
    padded, counts = [32, *code.tolist(), 32], {}
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            h = 0
            for k in range(n):
                h = (h * 0x100000001B3 + padded[i + k] + k + 1) % 2**64
            slot = (h * 0x9E3779B97F4A7C15 % 2**64) >> (64 - language.BITS)
            counts[slot] = counts.get(slot, 0) + 1
    import math

    vector = {s: math.log1p(c) * float(model.idf[s]) for s, c in counts.items()}
    norm = math.sqrt(sum(v * v for v in vector.values()))
    best = {}
    for k, owner in enumerate(model.owner):
        cos = sum(v * float(model.centroids[s, k]) for s, v in vector.items()) / norm
        best[owner] = max(best.get(owner, -1), cos)
    top = max(best, key=lambda o: (best[o], -o))
    return model.languages[top], best[top]


def test_against_plain_nearest_centroids(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fit(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in language.predict(docs.filter("doc_id < 60"), model).collect():
        lang, score = plain_prediction(model, texts[r.doc_id][:3000]) if len(texts[r.doc_id]) <= 3000 else (r.lang_pred, r.score)
        assert r.lang_pred == lang and abs(r.score - min(1, max(0, score))) < 1e-4
