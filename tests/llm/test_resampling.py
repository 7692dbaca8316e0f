"""Importance resampling against a plain version."""
import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from lodestone.llm import queries, resampling
from tests.llm.data import SF, texts_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain(docs, target, per_cent=5, least=20, buckets=10_000, seed=42):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    found = [(i, *features(t)) for i, t in docs]
    s = Counter(bucket(g) for _, _, f in found for g in f)
    t = Counter(bucket(g) for text in target for g in features(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for i, n, f in found:
        weight = sum(gain[bucket(g)] for g in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: len(able) * per_cent // 100])}
    return sorted(((r[0], r[2], r[3], r[4], rank.get(id(r))) for r in out), key=str)


def got(found):
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_query_equals_the_plain_version(spark):
    assert got(queries.op11_importance_resampling(spark, SF)) == plain(texts_of("documents"), [t for _, t in texts_of("benchmark", "item_id")])


@pytest.mark.parametrize(("per_cent", "least"), [(50, 2), (100, 0), (0, 0), (7, 3)])
def test_other_shares_odd_words_nulls_and_long_texts(spark, per_cent, least):
    long = "naïve Ünïcode 42 _x_ don't\x00stop " * 20_000
    docs = [(k, "alpha beta " * (k % 7) + f"word{k % 3} Z9") for k in range(60)]
    docs += [(100, None), (101, ""), (102, "?! \n"), (103, "one"), (104, "one two"), (105, "日本語 テキスト 日本語"), (106, long), (107, "a1 " * 9), (None, "a1 " * 9)]
    target = [None, "", "alpha beta gamma", "日本語 テキスト", "a1 a1"]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, ROW string").withColumnRenamed("ROW", "Score")
    found = resampling.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), per_cent, least)
    assert got(found) == plain(docs, target, per_cent, least)


def test_ties_of_one_doc_id_take_places_of_their_own(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 4, "doc_id long, text string")
    found = resampling.resample(docs, docs.select("text"), per_cent=75, least_words=1)
    assert sorted(r["rank"] or 0 for r in found.collect()) == [0, 1, 2, 3]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert got(resampling.resample(none, none)) == []
    docs = [(1, "a b c"), (2, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(resampling.resample(frame, none, 100, 1)) == plain(docs, [], 100, 1)


def test_every_distinct_tuple_is_hashed_once_a_chunk(monkeypatch):
    import numpy as np

    hashed = []
    monkeypatch.setattr(resampling.zlib, "crc32", lambda b, real=zlib.crc32: hashed.append(bytes(b)) or real(b))
    data = np.frombuffer(b"a b a b a b c a b", np.uint8)
    resampling.chunk_buckets(data, np.array([0, 11, 17]), 100)
    assert len(hashed) == len(set(hashed)) and set(hashed) == {g.encode() for t in ("a b a b a b", "c a b") for g in features(t)[1]}
