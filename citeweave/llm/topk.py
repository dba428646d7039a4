"""Exact top-k inner products by columnar branch-and-bound.

Vectors are dealt into blocks; a block lies in memory by dimension. For a pair of blocks, scores grow dimension block by dimension block; after each, what the remaining dimensions can add at
most (the product of the remaining norms) bounds every candidate, those below the k-th best lower bound are dropped and the survivors compacted. Each pair of a query block and a candidate block is one
task's work and sends at most k rows a query on; nothing is sent to all. Every query block first meets one candidate block, and its k-th best scores there are the bounds that the other pairs start from.
Blocks are stored in the narrowest whole numbers that hold them, as they travel to each pair.

Whole numbers below 2^53 are exact in doubles; where a sum could pass that, the same steps run on Python's integers.

Defined results: vectors that are null, empty or hold a null or non-finite component (before or after scaling) take no part; an id is a key, so rows alike in id and vector are one row; a row isn't its own candidate, nor is any with its id;
vectors of different lengths aren't compared; ties go to the smaller id; null ids take no part; scores beyond 64 bits are held at the limits and tie there; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged

CANDIDATES, QUERIES, DIMENSIONS, QUERY_STEP = 8192, 2048, 16, 64
_EXACT, _LIMIT = 2.0**53, 2.0**63


def whole_numbers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, x (array of doubles without fraction): floor(scale * component), without rows that take no part."""
    x = F.transform(F.col("embedding"), lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("double"))
    raw = F.transform(F.col("embedding"), lambda v: v.cast("double") * float(scale))
    fine = F.forall(raw, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    big = F.exists(raw, lambda v: F.abs(v) >= float(2**62))  # floor() would leave 64 bits; such doubles are whole already
    ok = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(fine)
    return ok.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(big, raw).otherwise(x).alias("x")).dropDuplicates(["vec_id", "x"])


def search(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, floors: dict[int, int], step: int = DIMENSIONS):
    """For each query (row of q): (query's place, ids, scores) of its k best among the columns of v. v is dimensions by candidates; floors has scores, by the query's id, below which none is wanted."""
    dims = len(v)
    peak = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * dims
    kind = np.float64 if peak < _EXACT else object
    if kind is object:
        to_int = np.frompyfunc(int, 1, 1)
        q, v = to_int(q), to_int(v)
    edges = [*range(step, dims, step), dims]
    # norms of what is left after each block, and a little more for rounding
    left_q = [np.sqrt((q[:, e:].astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9) for e in edges]
    left_v = [np.sqrt((v[e:].astype(np.float64) ** 2).sum(axis=0)) * (1 + 1e-9) for e in edges]
    for k0 in range(0, len(q), QUERY_STEP):
        part = q[k0 : k0 + QUERY_STEP]
        first = part[:, : edges[0]] @ v[: edges[0]]
        for j in range(len(part)):
            score, keep = first[j], np.flatnonzero(ids != q_ids[k0 + j])
            score, floor = score[keep], floors.get(int(q_ids[k0 + j]), -(2**63))
            for n, e in enumerate(edges):
                if n:
                    score = score + part[j, edges[n - 1] : e] @ v[edges[n - 1] : e][:, keep]
                if e < dims and (len(keep) > k or floor > -(2**63)):
                    slack = left_q[n][k0 + j] * left_v[n][keep] + 1
                    low = np.partition((score - slack).astype(np.float64), len(keep) - k)[len(keep) - k] if len(keep) > k else -np.inf
                    low = max(low, float(floor))
                    alive = np.flatnonzero(score + slack >= min(low, _LIMIT)) if low > -_LIMIT else np.arange(len(keep))
                    if len(alive) < 0.8 * len(keep):
                        score, keep = score[alive], keep[alive]
            if len(keep) > k and kind is not object:
                bar = np.partition(score, len(keep) - k)[len(keep) - k]
                alive = np.flatnonzero(score >= bar)
                score, keep = score[alive], keep[alive]
            held = ((max(-(2**63), min(2**63 - 1, int(s))), i) for s, i in zip(score.tolist(), ids[keep].tolist(), strict=True))
            best = sorted((-s, i) for s, i in held if s >= floor)[:k]
            yield k0 + j, [b[1] for b in best], [-b[0] for b in best]


def _blocks(rows: DataFrame, size: int, total: int, name: str) -> tuple[DataFrame, int]:
    """name, dims, ids, kind, data: rows dealt by a hash of their id into blocks of some ``size``, stored by dimension."""
    n = max(1, -(-total // size))

    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        dims = table.column("dims")[0].as_py()
        flat = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        peak = np.abs(flat).max()
        kind = next((t for t, most in (("<i2", 2**15), ("<i4", 2**31)) if peak < most), "<f8")
        data = np.ascontiguousarray(flat.T).astype(kind).tobytes()
        rest = {f"{name}_ids": [ids.astype("<i8").tobytes()], f"{name}_kind": [kind], f"{name}_data": [data]}
        return pa.table({name: table.column(name)[:1], "dims": table.column("dims")[:1], **{c: pa.array(x, pa.string() if c.endswith("kind") else pa.binary()) for c, x in rest.items()}})

    dealt = rows.withColumn(name, F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(n)).cast("int")).withColumn("dims", F.size("x"))
    return dealt.groupBy(name, "dims").applyInArrow(pack, f"{name} int, dims int, {name}_ids binary, {name}_kind string, {name}_data binary"), n


def _scores(pairs: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: search() for each row of pairs (the columns of both blocks, and floors: an array of query_id, floor, or null)."""
    columns = ("dims", "q_ids", "q_kind", "q_data", "c_ids", "c_kind", "c_data", "floors")

    def run(batches):
        for batch in batches:
            for dims, qi, qk, qd, ci, ck, cd, floors in zip(*(batch.column(n).to_pylist() for n in columns), strict=True):
                q_ids, ids = np.frombuffer(qi, "<i8"), np.frombuffer(ci, "<i8")
                q, c = (np.frombuffer(d, t).astype(np.float64).reshape(dims, -1) for d, t in ((qd, qk), (cd, ck)))
                found = list(search(q_ids, q.T, ids, c, k, {f["query_id"]: f["floor"] for f in floors or ()}))
                own = [int(q_ids[j]) for j, near, _ in found for _ in near]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([x for _, near, _ in found for x in near], pa.int64()), pa.array([s for _, _, scores in found for s in scores], pa.int64())], names=["query_id", "vec_id", "score"])

    return pairs.select(*columns).mapInArrow(run, "query_id long, vec_id long, score long")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of vectors for each row of queries; both as whole_numbers() makes them."""
    c, n_c = _blocks(vectors, CANDIDATES, vectors.count(), "c")
    q, n_q = _blocks(queries, QUERIES, queries.count(), "q")
    c, q = staged(c), staged(q)  # made once, read once a pair
    own = F.col("q") % n_c
    none = F.lit(None).cast("array<struct<query_id:bigint,floor:bigint>>").alias("floors")
    rows = _scores(q.withColumn("c", own).join(c, ["c", "dims"]).select("*", none), k)
    if n_c > 1:
        rows = staged(rows)
        enough = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
        dealt = enough.withColumn("q", F.pmod(F.xxhash64("query_id", F.lit(17)), F.lit(n_q)).cast("int"))
        floors = dealt.groupBy("q").agg(F.collect_list(F.struct("query_id", "floor")).alias("floors"))  # a block's queries
        others = q.join(floors, "q", "left").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1)))).where(F.col("c") != own)
        rows = rows.union(_scores(others.join(c.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))), ["q", "c", "dims"]), k))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(whole_numbers(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")))
    return nearest(rows, rows.where("vec_id % 50 = 0"))


SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
