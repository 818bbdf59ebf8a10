"""Approximate nearest neighbours by counting hash collisions.

Each of `PROJECTIONS` random directions is a hash function of its own: the vectors' projections
on it lie in a sorted array. A query doesn't fall into fixed buckets; a window centred on its
own projection is opened in every array, and a vector collides there if its projection lies in
the window. Windows of radius R are `HALF_WINDOW` * R wide to each side. Growing R (virtual
rehashing) only widens the windows, so each step counts the newly covered ends of the arrays. A
vector that collides in `threshold` arrays is verified by its distance in double precision. The
search ends when the k-th best distance is within R: whatever is nearer has then collided often
enough with the probability that the threshold was set for (0.97 at distance R, more below).
Nothing limits the number of candidates, and windows that cover all arrays verify every vector.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part,
nor do rows with a null id. Rows of one id count as one vector, the first in array order.
Vectors of another length than the query's aren't compared with it. Equal distances go to the
smaller id. Other columns are ignored, whatever their names; an empty table gives an empty result.

At scale: vectors are dealt to blocks by a hash of their id; each block has its own arrays. The
queries (a stated set) visit every block as a stream behind the block's vectors, sorted by Spark, so a task
holds one block and one Arrow batch. Blocks grow with the root of the table until a fraction of an
executor's memory, which keeps the copies of the queries few: queries times blocks rows. A block returns k
rows a query; the nearest k of those are ranked by Spark. The directions come from a fixed seed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantflow.llm.corpus_counts import part_limit

PROJECTIONS = 64
HALF_WINDOW = 1.36
THRESHOLD = 47
GROWTH = 1.12
SEED = 12
LEAST_BLOCK = 2_048
#: Rows that a batch of queries holds, and vectors whose distances open a search.
BATCH, PROBE = 256, 128


def usable(vector: Column) -> Column:
    """Whether a vector takes part: finite components, one of them not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def block_count(rows: int, row_bytes: int, limit: int) -> int:
    """Blocks for `rows` vectors: their size grows with the root of the table, up to `limit` bytes with their arrays."""
    size = max(LEAST_BLOCK, int(32 * math.sqrt(rows)))
    return max(1, -(-rows // min(size, max(LEAST_BLOCK, limit // row_bytes))))


class Index:
    """Sorted projection arrays of a block of vectors of one length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS, seed: int = SEED):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.directions = np.random.Generator(np.random.PCG64(seed)).standard_normal((vectors.shape[1], projections))
        values = (self.vectors.astype(np.float64) @ self.directions).T
        self.at = np.argsort(values, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(values, self.at, axis=1)
        self.finite = bool(np.isfinite(values).all())

    def distances(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        gap = self.vectors[rows].astype(np.float64) - query
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))

    def nearest(self, ident: int, query: np.ndarray, k: int, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the nearest `k` found, ties to the smaller id; the row of `ident` itself is left out."""
        n, arrays = len(self.ids), len(self.at)
        centre = query @ self.directions
        probe = self.distances(np.arange(0, n, max(1, n // PROBE)), query)
        probe = np.sort(probe[probe > 0])
        radius = max(float(probe[min(k, len(probe) - 1)]) / 2, np.finfo(float).tiny) if len(probe) else 1.0
        count, known = np.zeros(n, np.int16), np.zeros(n, bool)
        known[np.searchsorted(self.ids, ident) : np.searchsorted(self.ids, ident, "right")] = True
        rows, best = np.zeros(0, np.int64), np.zeros(0)
        low = high = None
        while True:
            reach = HALF_WINDOW * radius
            if self.finite and np.isfinite(reach) and np.isfinite(centre).all():
                new_low = np.array([np.searchsorted(line, c - reach) for line, c in zip(self.sorted, centre)])
                new_high = np.array([np.searchsorted(line, c + reach, "right") for line, c in zip(self.sorted, centre)])
            else:  # projections overflow: verify every vector
                new_low, new_high = np.zeros(arrays, np.int64), np.full(arrays, n)
            if low is None:
                covered = [self.at[j, a:b] for j, (a, b) in enumerate(zip(new_low, new_high))]
            else:
                covered = [self.at[j, a:b] for j, (a, b) in enumerate(zip(new_low, low))] + [self.at[j, a:b] for j, (a, b) in enumerate(zip(high, new_high))]
            low, high = new_low, new_high
            count += np.bincount(np.concatenate(covered), minlength=n).astype(np.int16)
            fresh = np.flatnonzero((count >= threshold) & ~known)
            if len(fresh):
                known[fresh] = True
                rows, best = np.concatenate([rows, fresh]), np.concatenate([best, self.distances(fresh, query)])
                order = np.lexsort((self.ids[rows], best))[:k]
                rows, best = rows[order], best[order]
            if (len(rows) >= k and best[-1] <= radius) or int(high.sum() - low.sum()) == n * arrays:
                return self.ids[rows], best
            radius *= GROWTH


def _stacked(batch: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of a table (vec_id, vector) whose vectors are of one length."""
    lists = batch["vector"].combine_chunks()
    return batch["vec_id"].to_numpy(), pc.list_flatten(lists).to_numpy().reshape(len(lists), -1)


def _first_of_each(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One vector of each id, the first in array order."""
    if len(np.unique(ids)) == len(ids):
        return ids, vectors
    order = np.lexsort((*vectors.T[::-1], ids))
    ids, vectors = ids[order], vectors[order]
    first = np.r_[True, ids[1:] != ids[:-1]]
    return ids[first], vectors[first]


def search(embeddings: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", projections: int = PROJECTIONS, threshold: int = THRESHOLD) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest `k` found of each row whose id `every` divides, against all other rows."""
    spark = embeddings.sparkSession
    vector = F.col(vector_col)
    if not isinstance(embeddings.schema[vector_col].dataType.elementType, (T.FloatType, T.DoubleType)):
        vector = vector.cast("array<double>")
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"))
    rows = rows.where(usable(F.col("vector")) & F.col("vec_id").isNotNull()).withColumn("dim", F.size("vector"))
    total, widest = rows.agg(F.count("*"), F.max("dim")).first()
    blocks = block_count(total, 12 * projections + 16 * (widest or 0), part_limit(spark))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "dim").agg(F.min("vector").alias("vector"))
    visits = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = rows.withColumn("block", block).withColumn("asks", F.lit(False)).unionByName(visits.withColumn("asks", F.lit(True)))
    dealt = dealt.repartitionById(blocks, "block").sortWithinPartitions("asks", "dim", "vec_id")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        indexes: dict[int, Index] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for dim in pc.unique(table["dim"]).to_pylist():
                group = table.filter(pc.equal(table["dim"], dim))
                stored, queries = group.filter(pc.invert(group["asks"])), group.filter(group["asks"])
                if stored.num_rows:
                    held.setdefault(dim, []).append(_stacked(stored))
                if not queries.num_rows:
                    continue
                if dim in held:
                    ids, vectors = zip(*held.pop(dim))
                    indexes[dim] = Index(*_first_of_each(np.concatenate(ids), np.concatenate(vectors)), projections)
                if dim not in indexes:
                    continue
                for lo in range(0, queries.num_rows, BATCH):
                    part = queries.slice(lo, BATCH)
                    found = [(q, *indexes[dim].nearest(q, v.astype(np.float64), k, threshold)) for q, v in zip(*_stacked(part))]
                    yield pa.RecordBatch.from_pydict({
                        "query_id": np.concatenate([np.full(len(ids), q, np.int64) for q, ids, _ in found]),
                        "vec_id": np.concatenate([ids for _, ids, _ in found]).astype(np.int64),
                        "score": np.concatenate([d for _, _, d in found]),
                    })

    near = dealt.select("asks", "dim", "vec_id", "vector").mapInArrow(answer, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = None
