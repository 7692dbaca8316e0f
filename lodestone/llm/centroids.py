"""Centroid clustering of embeddings: Lloyd's rounds over weighted distinct vectors.

Vectors are quantised to integers; identical ones become one row with its multiplicity, so a vector that a
third of all rows share costs one distance a round.  A round assigns every distinct vector to its nearest centroid and adds up
weighted integer components in each task; only those sums, one row a task and centroid, are shuffled, and only k new centroids
reach the driver.  All is integer arithmetic, so partitioning changes nothing.  At the end the distinct vectors' assignments are
joined back to the rows.

Kept are vectors of exactly `dims` components, none null, NaN or infinite; other rows (a null vector too) have no row in the result.
A component of LIMIT or more in size is an error, because sums and distances must fit into 64 bits.  Rows with equal or null
vec_ids stay rows of their own; a null vec_id counts as empty text in the draw of the first centroids, whose ties go to the
smaller vector.  With fewer than k kept rows there are as many centroids as rows; with none the result is empty.  Other columns are ignored.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import scratch

#: Components are below this in size: times the scale 2**26, so 64 squared differences are below 2**60.
LIMIT = 1 << 16


def kept(vector: Column, dims: int) -> Column:
    """Whether a vector has dims finite components; null for a null vector."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce((F.size(vector) == dims) & F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False))), F.lit(False))


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * component), components as doubles."""
    wide = F.raise_error(F.lit(f"a component is {LIMIT} or more in size")).cast("long")
    return F.transform(vector, lambda x: F.when(F.abs(x.cast("double")) < LIMIT, F.floor(x.cast("double") * scale)).otherwise(wide))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller one of equals) and the squared distance."""
    at, best = np.zeros(len(vectors), np.int32), np.full(len(vectors), np.iinfo(np.int64).max)
    for j, c in enumerate(centroids):
        off = vectors - c
        distance = np.einsum("ij,ij->i", off, off)
        closer = distance < best
        at[closer], best[closer] = j, distance[closer]
    return at, best


def _sums(centroids: np.ndarray):
    """One row for each centroid that a task has vectors of: how many, and the sums of their components."""

    def run(batches):
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, weight = _matrix(batch.column("q")), batch.column("copies").to_numpy()
            at, _ = nearest(vectors, centroids)
            np.add.at(counts, at, weight)
            np.add.at(sums, at, vectors * weight[:, None])
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(counts[met]), pa.array(list(sums[met]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                at, distance = nearest(_matrix(batch.column("q")), centroids)
                yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("copies"), pa.array(at), pa.array(distance)], ["q", "copies", "cluster", "distance"])

    return run


def _moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid replaced by the floor of its vectors' weighted mean; one without vectors stays."""
    parts = distinct.mapInArrow(_sums(centroids), "cluster int, n long, sums array<long>")
    parts = parts.select("cluster", "n", F.posexplode("sums").alias("i", "x"))
    out = centroids.copy()
    for r in parts.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():  # k * dims rows
        out[r["cluster"], r["i"]] = r["x"] // r["n"]
    return out


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """vectors (vec_id, embedding) -> vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    The first centroids are the k kept rows with the smallest sha256 of `seed:vec_id`.
    """
    tables = scratch.Tables()
    rows = vectors.select("vec_id", F.col("embedding").alias("q")).filter(kept(F.col("q"), dims)).withColumn("q", quantised(F.col("q"), scale))
    rows = tables.table(rows, "quantised")
    distinct = tables.table(rows.groupBy("q").agg(F.count("*").alias("copies")), "distinct")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(drawn.alias("drawn"), "q").orderBy("drawn", "q").limit(k).collect()
    centroids = np.array([r["q"] for r in first], np.int64).reshape(len(first), dims)
    for _ in range(rounds if len(first) else 0):
        centroids = _moved(distinct, centroids)
    at = tables.table(distinct.mapInArrow(_assigned(centroids), "q array<long>, copies long, cluster int, distance long"), "assigned")
    tables.drop(distinct)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    spread = at.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)") * F.col("copies")).alias("d")).collect()  # k rows
    named = [(r["cluster"], int(r["d"]), int(sum(x["d"] for x in spread)), digest[r["cluster"]]) for r in spread]
    named = vectors.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    placed = rows.join(at.select("q", "cluster", "distance"), "q").join(F.broadcast(named), "cluster")
    return placed.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """DuckDB SQL of `clusters` over embeddings with unique vec_ids."""
    sql = [
        f"""WITH q AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: coalesce(isfinite(x::DOUBLE), false))) = {dims}),
v AS MATERIALIZED (SELECT vec_id, unnest(range({dims})) AS i, unnest(q) AS x FROM q),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h) - 1)::INT AS cluster, q FROM (SELECT sha256('{seed}:' || vec_id) AS h, q FROM q ORDER BY h LIMIT {k})),
m0 AS MATERIALIZED (SELECT cluster, unnest(range({dims})) AS i, unnest(q) AS x FROM c0)"""
    ]
    for r in range(rounds + 1):
        sql.append(
            f"d{r} AS (SELECT vec_id, cluster, sum((v.x - m.x) * (v.x - m.x))::BIGINT AS d FROM v JOIN m{r} m USING (i) GROUP BY ALL),\n"
            f"a{r} AS MATERIALIZED (SELECT vec_id, min({{'d': d, 'c': cluster}}) AS w FROM d{r} GROUP BY vec_id)"
        )
        if r < rounds:
            sql.append(
                f"n{r} AS (SELECT w.c AS cluster, i, sum(x)::BIGINT AS s, count(*) AS n FROM v JOIN a{r} USING (vec_id) GROUP BY ALL),\n"
                f"m{r + 1} AS MATERIALIZED (SELECT cluster, i, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM m{r} LEFT JOIN n{r} USING (cluster, i))"
            )
    return ",\n".join(sql) + f"""
SELECT vec_id, w.c AS cluster, w.d AS distance, sum(w.d) OVER (PARTITION BY w.c)::BIGINT AS cluster_inertia, sum(w.d) OVER ()::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM m{rounds} GROUP BY cluster) s ON s.cluster = w.c"""
