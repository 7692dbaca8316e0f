"""Importance resampling towards a target distribution, over hashed word n-grams.

Every chunk of texts gets an integer dictionary of its distinct words; its n-grams are tuples of word ids, and each distinct
tuple's bytes are put together again and hashed once.  The tuple's bucket is joined back to all its occurrences, so a document becomes
the list of its features' buckets, which is written once; counts over all documents, weights and scores are read from that list.
Dictionaries belong to a chunk (about 256 kB of text, or one longer text) and not to the corpus: a dictionary of all words would have to
shuffle every occurrence of every word, and no result depends on it.

Counts of all buckets, and gains by bucket, are arrays of `buckets` numbers, whatever the input.  Drawn documents are
numbered by ranges of their order; a histogram by powers of two of the score first leaves out what can't be drawn.

Texts: null has no words; texts of any length are taken whole.  A null doc_id counts as empty text in the draw and as the largest in ties; rows that
repeat a doc_id are documents of their own and their ties are broken by their place in the input.  Empty documents tables give no rows; an empty target counts no
features.  Other columns are ignored.
"""
from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import kernel, scratch
from lodestone.operators.ranking import number_rows

BUCKETS = 10_000
#: Bytes of words once A-Z are lower-cased: digits, a-z and everything beyond ASCII.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True


def _codes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each value among the distinct ones, and these in order of appearance."""
    coded = pa.array(values).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy()


def _hashed(grams: pa.Array, buckets: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, grams.to_pylist()), np.int64, len(grams)) % buckets


def chunk_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words of each text of a chunk, and for n = 1, 2, 3 the bucket of the n-gram that begins at each word (-1: it would leave the text)."""
    low = kernel.LOWER[data]
    inside = WORD[low]
    start, end = kernel.runs(inside, offsets)
    bounds = np.searchsorted(start, offsets)
    ends = np.concatenate([[0], np.cumsum(end - start)])
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(low[inside]))]).dictionary_encode()
    ids, words = words.indices.to_numpy().astype(np.int64), words.dictionary
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(ids))  # words from here to the end of the text
    out = [_hashed(words, buckets)[ids] if len(ids) else ids]
    space = pa.scalar(b" ", pa.large_binary())
    grams, held = words, ids  # the distinct n-grams as bytes, and the one that begins at each word
    for n in (2, 3):
        bucket, after = np.full(len(ids), -1, np.int64), np.full(len(ids), -1, np.int64)
        at = np.flatnonzero(left >= n)
        if len(at):
            coded, distinct = _codes(held[at] * len(words) + ids[at + n - 1])
            head, last = np.divmod(distinct, len(words))
            grams = pc.binary_join_element_wise(grams.take(pa.array(head)), words.take(pa.array(last)), space)
            bucket[at], after[at] = _hashed(grams, buckets)[coded], coded
        out.append(bucket)
        held = after
    return np.diff(bounds), out


def _features(buckets: int):
    """For each row its words and the buckets of all its features, two bytes each (four beyond 65,536 buckets)."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches):
        for batch in batches:
            for first, data, offsets in kernel.text_chunks(batch.column("text")):
                sizes, found = chunk_buckets(data, offsets, buckets)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                lists = []
                for i, j in zip(ends[:-1], ends[1:], strict=True):
                    own = np.concatenate([f[i:j] for f in found])
                    lists.append(own[own >= 0].astype(kind).tobytes())
                named = batch.slice(first, len(sizes)).column("doc_id")
                yield pa.RecordBatch.from_arrays([named, pa.array(sizes, pa.int64()), pa.array(lists, pa.binary())], ["doc_id", "n_words", "buckets"])
        kernel.release()

    return run, kind


def _counted(features: DataFrame, buckets: int, kind) -> np.ndarray:
    """How often each bucket occurs; a task sends one row a bucket at most."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column("buckets"):
                total += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in features.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # at most `buckets` rows
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray, smooth: int) -> np.ndarray:
    """1000 times the log of the target's share of each bucket over the source's, both smoothed by one a bucket; floors."""
    s_all, t_all = int(source.sum()) + smooth, int(target.sum()) + smooth
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(seed: int, doc_id: int | None) -> int:
    """1000 times a Gumbel draw, keyed by seed and doc_id; floor."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(gain: np.ndarray, kind, seed: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            lists = [np.frombuffer(x.as_buffer(), kind) for x in batch.column("buckets")]
            weight = np.array([int(gain[x].sum()) for x in lists], np.int64)
            draw = np.array([noise(seed, i) for i in ids.to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([ids, batch.column("n_words"), pa.array([len(x) for x in lists], pa.int64()), pa.array(weight), pa.array(weight + draw)], ["doc_id", "n_words", "n_features", "weight", "score"])

    return run


def _level(score):
    """A bounded number of classes, in the order of the scores: sixteen for each power of two."""
    size = F.floor(F.log2(F.abs(score).cast("double") + 1) * 16)
    return F.when(score < 0, -size).otherwise(size)


def resample(docs: DataFrame, target: DataFrame, per_cent: int = 5, least_words: int = 20, buckets: int = BUCKETS, seed: int = 42) -> DataFrame:
    """docs (doc_id, text), target (text) -> doc_id, n_features, weight, score, rank (of the drawn; else null); one row for each row of docs."""
    run, kind = _features(buckets)
    shape = "doc_id long, n_words long, buckets binary"
    tables = scratch.Tables()
    of = lambda df, doc_id: df.select(doc_id.cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, shape)
    features = tables.table(of(docs, F.col("doc_id")), "features")
    gain = gains(_counted(features, buckets, kind), _counted(of(target, F.lit(None)), buckets, kind), buckets)
    scored = features.mapInArrow(_scored(gain, kind, seed), "doc_id long, n_words long, n_features long, weight long, score long")
    scored = tables.table(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    tables.drop(features)
    able = scored.filter(F.col("n_words") >= least_words)
    levels = able.groupBy(_level(F.col("score")).alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()  # about 2,000 at most
    wanted = sum(r["n"] for r in levels) * per_cent // 100
    lowest, above = None, 0
    for r in levels:
        if above < wanted:
            lowest, above = r["level"], above + r["n"]
    if not wanted:
        return scored.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    near = able.filter(_level(F.col("score")) >= lowest).select("row", scratch.identity(F.col("doc_id")).alias("id"), "score")
    ranks = number_rows(near, F.col("score"), ["id", "row"], "rank").filter(F.col("rank") <= wanted)
    return scored.join(ranks.select("row", F.col("rank").cast("long")), "row", "left").select("doc_id", "n_features", "weight", "score", "rank")


def oracle(per_cent: int = 5, least_words: int = 20, buckets: int = BUCKETS, seed: int = 42) -> str:
    """DuckDB SQL of `resample` over documents with unique doc_ids; CRC-32 by its table, over each distinct n-gram's bytes."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    polynomial = 0xEDB88320
    words = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {polynomial}::BIGINT) ELSE c >> 1 END)) AS tab),
texts AS MATERIALIZED (SELECT doc_id, true AS source, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{words}') AS w FROM documents
  UNION ALL SELECT NULL, false, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{words}') FROM benchmark),
placed AS MATERIALIZED (SELECT doc_id, source, len(w) AS n, w, unnest(range(1, len(w) + 1)) AS p FROM texts),
grams AS MATERIALIZED (SELECT doc_id, source, array_to_string(w[p : p + k], ' ') AS g FROM placed, (VALUES (0), (1), (2)) t(k) WHERE p + k <= n),
hexes AS (SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM grams)),
hashed AS MATERIALIZED (SELECT g, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, len(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT),
  lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % {buckets} AS bucket FROM hexes, crc),
coded AS MATERIALIZED (SELECT doc_id, source, bucket FROM grams JOIN hashed USING (g)),
counts AS (SELECT bucket, count(*) FILTER (WHERE source) AS s, count(*) FILTER (WHERE NOT source) AS t FROM coded GROUP BY bucket),
gains AS MATERIALIZED (SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + {buckets}))::DOUBLE / ((s + 1) * (sum(t) OVER () + {buckets}))::DOUBLE))::BIGINT AS gain FROM counts),
weights AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM coded JOIN gains USING (bucket) WHERE source GROUP BY doc_id),
scored AS MATERIALIZED (SELECT doc_id, len(w) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM texts LEFT JOIN weights USING (doc_id) WHERE source),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n >= {least_words})
SELECT doc_id, n_features, weight, score, r AS rank FROM scored LEFT JOIN (FROM ranked WHERE r <= n * {per_cent} // 100) k USING (doc_id)"""
