"""Plain Lloyd clustering of whole-number vectors.

Centroids are broadcast (k times dims numbers); each task takes integer squared differences for each centroid and the lowest number among the nearest. What a partition adds up for each cluster and component merges by groupBy; only these
k * (dims + 1) sums reach the driver, where floor(sum / count) is exact. Vectors are scaled once, into a table of whole numbers that every round reads.

64-bit arithmetic is exact while components stay below 2^27 in size; vectors or centroids beyond that take the same steps in Python's integers, and their sums travel in parts of 40 bits.

Defined results: vectors that are null, of another length, or hold a null or non-finite component (before or after scaling) are left out; repeated rows count as often as they occur; a null vec_id takes part and is drawn as a first centroid
last; vectors alike in id are drawn in order of their components; fewer vectors than centroids give as many centroids; an empty table gives an empty table; distances and sums beyond 64 bits are held at 2^63 - 1; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, staged

CLUSTERS, ROUNDS, DIMENSIONS, SCALE = 16, 3, 64, 64
#: Below this size, 64 squared differences add up within 64 bits.
NARROW = 1 << 27
_PART, _LIMIT = 40, 2**63 - 1
ASSIGNED = "vec_id long, cluster int, distance long"
_SUMS = "cluster int, component int, part int, value long"

Centroids = list[list[int]]


def whole_vectors(vectors: DataFrame, dims: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, x: floor(scale * component) of the vectors that take part, as doubles without fraction."""
    raw = F.transform(F.col("embedding"), lambda v: v.cast("double") * float(scale))
    fine = F.forall(raw, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(raw, lambda v: F.when(F.abs(v) < float(2**53), F.floor(v).cast("double")).otherwise(v))
    return vectors.where(F.size("embedding") == dims).where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))


def first_centroids(whole: DataFrame, k: int = CLUSTERS, seed: int = 1) -> Centroids:
    """The k vectors whose ids hash lowest, in that order; a top-k, so no task sorts all."""
    drawn = whole.withColumn("drawn", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    return [[int(v) for v in r["x"]] for r in drawn.orderBy(F.col("drawn").asc_nulls_last(), "x").limit(k).select("x").collect()]


def nearest(x: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each row of x (doubles without fraction)."""
    narrow = np.abs(x).max(axis=1, initial=0) < NARROW if max((abs(v) for c in centroids for v in c), default=0) < NARROW else np.zeros(len(x), bool)
    cluster, distance = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64)
    for rows, kind in ((np.flatnonzero(narrow), np.int64), (np.flatnonzero(~narrow), object)):
        if len(rows):
            own = x[rows].astype(np.int64) if kind is np.int64 else np.frompyfunc(int, 1, 1)(x[rows])
            squares = np.empty((len(rows), len(centroids)), kind)
            for n, c in enumerate(centroids):
                difference = own - np.array(c, kind)
                squares[:, n] = (difference * difference).sum(axis=1)
            cluster[rows] = squares.argmin(axis=1)  # the lowest number among equals
            least = squares[np.arange(len(rows)), cluster[rows]]
            distance[rows] = least if kind is np.int64 else [min(int(v), _LIMIT) for v in least]
    return cluster, distance


def _in_parts(value: int) -> list[int]:
    """value as parts of 40 bits from the lowest on; the last has the sign."""
    out = []
    while not -(1 << 62) <= value < 1 << 62:
        out.append(value & ((1 << _PART) - 1))
        value >>= _PART
    return [*out, value]


def _rows_of(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["x"].to_numpy()).astype(np.float64, copy=False)


def moved(whole: DataFrame, centroids: Centroids) -> Centroids:
    """The centroids after one round: floor of the mean of each one's vectors; one without vectors stays."""
    sent = whole.sparkSession.sparkContext.broadcast(centroids)

    def sums(frames):
        k, dims = len(sent.value), len(sent.value[0])
        narrow, wide, count = np.zeros((k, dims), np.int64), {}, np.zeros(k, np.int64)
        for frame in frames:
            if not len(frame):
                continue
            x = _rows_of(frame)
            cluster, _ = nearest(x, sent.value)
            count += np.bincount(cluster, minlength=k)
            small = np.abs(x).max(axis=1) < NARROW
            for n in range(k):
                own = cluster == n
                narrow[n] += x[own & small].astype(np.int64).sum(axis=0)
                if (own & ~small).any():
                    wide[n] = wide.get(n, 0) + np.frompyfunc(int, 1, 1)(x[own & ~small]).sum(axis=0)
        rows = [(n, -1, 0, int(count[n])) for n in range(k) if count[n]]
        rows += [(n, j, 0, int(narrow[n, j])) for n in range(k) if count[n] for j in range(dims)]
        rows += [(n, j, p, v) for n, values in wide.items() for j, value in enumerate(values.tolist()) for p, v in enumerate(_in_parts(value))]
        yield pd.DataFrame(rows, columns=["cluster", "component", "part", "value"])

    found: dict[tuple[int, int], int] = {}
    merged = whole.select("x").mapInPandas(sums, _SUMS).groupBy("cluster", "component", "part").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value"))
    for r in merged.collect():  # k * (dims + 1) rows, a few times as many if components are wide
        key = (r["cluster"], r["component"])
        found[key] = found.get(key, 0) + (int(r["value"]) << (_PART * r["part"]))
    sent.unpersist()
    return [[found[n, j] // found[n, -1] for j in range(len(c))] if (n, -1) in found else c for n, c in enumerate(centroids)]


def fitted(whole: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1) -> Centroids:
    centroids = first_centroids(whole, k, seed)
    for _ in range(rounds if centroids else 0):
        centroids = moved(whole, centroids)
    return centroids


def assigned(whole: DataFrame, centroids: Centroids) -> DataFrame:
    """vec_id, cluster, distance (squared) of every vector."""
    sent = whole.sparkSession.sparkContext.broadcast(centroids)

    def run(frames):
        for frame in frames:
            if len(frame):
                cluster, distance = nearest(_rows_of(frame), sent.value)
                yield pd.DataFrame({"vec_id": frame["vec_id"].astype("Int64"), "cluster": cluster, "distance": distance})

    return whole.mapInPandas(run, ASSIGNED)


def _held(total):
    return F.least(total, F.lit(_LIMIT).cast("decimal(38,0)")).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = staged(whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")))
    centroids = fitted(whole)
    rows = staged(assigned(whole, centroids) if centroids else spark.createDataFrame([], ASSIGNED))
    dropped(whole)
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")).collect()  # a row for each cluster
    total = min(sum(int(r["sum"]) for r in sums), _LIMIT)
    facts = [(r["cluster"], min(int(r["sum"]), _LIMIT), total, hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()) for r in sums]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    parts = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS cluster, x FROM v QUALIFY cluster < 16)",
    ]
    for n in range(ROUNDS + 1):
        square = f"list_sum(list_transform(list_zip(v.x, c{n}.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, any_value(v.vec_id) AS vec_id, any_value(v.x) AS x, min({{'distance': {square}, 'cluster': cluster}}) AS best FROM v, c{n} GROUP BY r)")
        if n < ROUNDS:
            parts.append(f"s{n} AS (SELECT best.cluster AS cluster, j, sum(x[j])::BIGINT AS s, count(*)::BIGINT AS n FROM a{n}, range(1, 65) t(j) GROUP BY ALL)")
            parts.append(f"m{n} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY j) AS x FROM s{n} GROUP BY cluster)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{n}.x, c{n}.x) AS x FROM c{n} LEFT JOIN m{n} USING (cluster))")
    last = f"""SELECT vec_id, best.cluster::INT AS cluster, best.distance AS distance, sum(best.distance) OVER (PARTITION BY best.cluster)::BIGINT AS cluster_inertia, sum(best.distance) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c{ROUNDS}.x, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} ON best.cluster = c{ROUNDS}.cluster"""
    return "WITH " + ",\n".join(parts) + "\n" + last


SQL = _sql()
