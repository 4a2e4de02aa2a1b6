"""Exact top-k search by inner product, pruned with segment means and deviations from coarse to fine.

Cut into segments, a vector is summed up by each segment's mean and standard deviation. Over a segment of n parts,
sum (q - v)^2 >= n * ((mean_q - mean_v)^2 + (dev_q - dev_v)^2): a lower bound of the distance. With the vectors' own
lengths, which the same sums give, it is an upper bound of the inner product: sum q v <= n * (mean_q mean_v + dev_q
dev_v). Finer segments never make it worse. A candidate is dropped once the bound falls below the k-th best exact score
that its block has for the query; those that are left are scored exactly, in whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1_024
LEVELS = (1, 4, 16)
#: Vectors of a candidate block and of a query block, and groups that candidate blocks are dealt to.
CANDIDATES, QUERIES, SHARDS = 4_096, 512, 64
#: Largest whole number a double counts exactly.
EXACT = float(1 << 53)


def _summary(x: np.ndarray, segments: int) -> np.ndarray:
    """Per segment sqrt(n) * mean and sqrt(n) * deviation, so that a plain inner product of two summaries is the bound."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    n = np.diff(edges)
    sums = np.add.reduceat(x, edges[:-1], axis=1)
    squares = np.add.reduceat(x * x, edges[:-1], axis=1)
    mean = sums / n
    return np.concatenate([mean * np.sqrt(n), np.sqrt(np.maximum(0, squares - n * mean * mean))], axis=1)


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows; beyond a double's whole numbers with Python's integers."""
    if q.shape[1] * max(1.0, np.abs(q).max(initial=0)) * np.abs(v).max(initial=0) < EXACT:
        return (q @ v.T).astype(np.int64)
    top = (1 << 63) - 1
    return np.array([[max(-top - 1, min(top, sum(int(a) * int(b) for a, b in zip(x, y, strict=True)))) for y in v]
                     for x in q], dtype=np.int64).reshape(len(q), len(v))


def block_top(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query row, candidate row, score) of the k best candidates of each query in one block, and how many inner
    products were computed. Ties go to the smaller id; a query's own id is no candidate."""
    if not len(q) or not len(v):
        return (np.zeros(0, np.int64),) * 3 + (0,)
    slack = 1e-9 * max(1.0, float(np.abs(q).max()) * float(np.abs(v).max()) * q.shape[1])  # of rounding
    levels = [(_summary(q, s), _summary(v, s)) for s in LEVELS]
    out, computed = [], 0
    for row in range(len(q)):
        own = ids != query_ids[row]
        bound = levels[0][0][row] @ levels[0][1].T
        bound[~own] = -np.inf
        first = np.argpartition(-bound, min(4 * k, len(v) - 1))[:4 * k]  # the most promising set the threshold
        first = first[own[first]]
        scores = _exact(q[row:row + 1], v[first])[0]
        computed += len(first)
        least = np.sort(scores)[-k] if len(scores) >= k else -np.inf
        live = np.flatnonzero((bound + slack >= least) & own)
        live = live[~np.isin(live, first)]
        for of_q, of_v in levels[1:]:
            live = live[of_v[live] @ of_q[row] + slack >= least]
        rest = _exact(q[row:row + 1], v[live])[0]
        computed += len(live)
        at, score = np.concatenate([first, live]), np.concatenate([scores, rest])
        order = np.lexsort((ids[at], -score))[:k]
        out.append((np.full(len(order), row), at[order], score[order]))
    rows, places, scores = (np.concatenate(x) for x in zip(*out, strict=True))
    return rows, places, scores, computed


def whole_parts(vector: Column) -> Column:
    """floor(1024 * x) of every component, as double; null for a vector that is null or has a null or non-finite one."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    good = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & good, F.transform(wide, lambda x: F.floor(x * SCALE).cast("double")))


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Rows of ``size`` or fewer vectors of one dimension: dim, ids, flat components."""
    def run(batches):
        held: dict[int, tuple[list[int], list[np.ndarray]]] = {}

        def close(dim):
            ids, rows = held.pop(dim)
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([np.concatenate(rows) if dim else np.zeros(0)], pa.list_(pa.float64()))], names=["dim", "ids", "parts"])

        for batch in batches:
            for vec_id, parts in zip(batch.column("vec_id").to_pylist(), batch.column("parts"), strict=True):
                row = parts.values.to_numpy(zero_copy_only=False)
                ids, rows = held.setdefault(len(row), ([], []))
                ids.append(vec_id)
                rows.append(row)
                if len(ids) == size:
                    yield close(len(row))
        for dim in list(held):
            yield close(dim)

    return vectors.select("vec_id", "parts").mapInArrow(run, "dim int, ids array<long>, parts array<double>")


def top_k(vectors: DataFrame, queries: Column, k: int = 10, vec: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` best inner products of every query.

    ``vectors`` has vec_id and the vector column; rows for which ``queries`` holds are the queries, all rows but those
    with the query's own id are candidates. Vectors that are null or hold a null or non-finite component, and rows
    without an id, take no part; vectors of another length are never compared. Rows that share an id and a vector
    count once; different vectors under one id each stand for themselves. Scores beyond a long stop at its ends. An
    empty table gives an empty result.

    Candidates and queries are packed into blocks; candidate blocks are dealt to SHARDS groups and every query block
    is sent to each of them. A block pair gives at most ``k`` rows a query.
    """
    rows = (vectors.select("vec_id", whole_parts(vectors[vec]).alias("parts"), queries.alias("asked"))
            .where("vec_id is not null and parts is not null").dropDuplicates(["vec_id", "parts"]))
    candidates = _blocks(rows, CANDIDATES).withColumn(
        "shard", F.pmod(F.xxhash64(F.col("ids")[0], F.size("ids")), F.lit(SHARDS)).cast("int"))
    asked = (_blocks(rows.where("asked"), QUERIES).select("dim", F.col("ids").alias("q_ids"), F.col("parts").alias("q_parts"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1)))))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q, ids, v = (batch.column(c)[i].values.to_numpy(zero_copy_only=False)
                                    for c in ("q_ids", "q_parts", "ids", "parts"))
                dim = batch.column("dim")[i].as_py()
                if dim:
                    q, v = q.reshape(-1, dim), v.reshape(-1, dim)
                else:
                    q, v = np.zeros((len(q_ids), 1)), np.zeros((len(ids), 1))
                row, at, score, _ = block_top(q_ids, q, ids, v, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(row), pa.array(ids[at]), pa.array(score)],
                                                 names=["query_id", "row", "vec_id", "score"])

    met = (candidates.join(asked, ["shard", "dim"]).select("dim", "q_ids", "q_parts", "ids", "parts")
           .mapInArrow(run, "query_id long, row long, vec_id long, score long"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (met.drop("row").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
