"""K-means for the index: sample with replacement, random start, a fixed number of Lloyd steps.

Only the K centroids are ever on the driver. A step is one narrow pass with sums by centroid made in
each batch, so what is shuffled is at most K rows per task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.operators.knn import distances
from tessel.session import stored

#: Distances that a step holds at once in a task.
ENTRIES = 1 << 21
DEFAULT_K, DEFAULT_ITERS, DEFAULT_SAMPLE, DEFAULT_SEED = 2048, 12, 200_000, 1


def sample_with_replacement(refs: DataFrame, size: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """About min(size, n) rows drawn with replacement."""
    n = refs.count()
    return refs.sample(withReplacement=True, fraction=min(size, n) / n, seed=seed) if n else refs


#: A prime and multipliers of the order in which rows are drawn, which any SQL engine can compute in 64 bits.
PRIME, BY_ID, BY_SEED = 2_147_483_647, 1_103_515_245, 40_503


def drawn_order(seed: int) -> Column:
    """A seeded pseudo-random number of the row's id."""
    return F.pmod(F.pmod(F.col("ref_id"), F.lit(PRIME)) * BY_ID + F.lit(seed * BY_SEED), F.lit(PRIME))


def start(sample: DataFrame, k: int, seed: int = DEFAULT_SEED, column: str = "vector") -> np.ndarray:
    """``k`` rows of the sample in the seeded order; with repetition if there are fewer."""
    rows = sample.select(column, drawn_order(seed).alias("h"), "ref_id").orderBy("h", "ref_id").limit(k).collect()
    found = np.array([r[column] for r in rows], dtype=np.float64)
    return found[np.arange(k) % len(found)] if len(found) else found


def step_sums(sample: DataFrame, centroids: np.ndarray, column: str = "vector", metric: str = "float") -> DataFrame:
    """(centroid_id, n, sums, cost): each row goes to its nearest centroid, ties to the lowest id.

    Distances of floats are sums of squared differences, those of codes (``i16``) whole numbers, so ties are ties.
    """
    rows = max(1, ENTRIES // len(centroids))

    def assign(batches):
        for b in batches:
            cells = b.column(0).flatten().to_numpy().astype(np.float64).reshape(len(b), -1) if len(b) else np.zeros((0, 0))
            for s in range(0, len(cells), rows):
                v = cells[s : s + rows]
                d = distances(v, centroids, metric)
                near = d.argmin(axis=1)
                used, where = np.unique(near, return_inverse=True)
                sums = np.zeros((len(used), v.shape[1]))
                np.add.at(sums, where, v)
                cost = np.bincount(where, d[np.arange(len(v)), near])
                yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(np.bincount(where)), pa.array(list(sums), pa.list_(pa.float64())), pa.array(cost)], ["centroid_id", "n", "sums", "cost"])

    parts = sample.select(column).mapInArrow(assign, "centroid_id int, n long, sums array<double>, cost double")
    dims = centroids.shape[1]
    total = F.array(*[F.sum(F.col("sums")[i]) for i in range(dims)])
    return parts.groupBy("centroid_id").agg(F.sum("n").alias("n"), total.alias("sums"), F.sum("cost").alias("cost"))


def lloyd(sample: DataFrame, centroids: np.ndarray, iters: int, seed: int = DEFAULT_SEED, column: str = "vector", codes: bool = False) -> tuple[np.ndarray, list[float]]:
    """(centroids, cost before each step) after exactly ``iters`` steps from ``centroids``.

    A centroid without rows is set to a row of the sample, the empty ones in order to the rows that :func:`start`
    draws for the step, so the cost may rise after such a step. With ``codes`` centroids are rounded to whole numbers
    after each step, half up: whole numbers all the way, the same on any number of machines. ``sample`` is read twice
    a step, so it should be a written table.
    """
    costs = []
    for i in range(iters):
        rows = step_sums(sample, centroids, column, "i16" if codes else "float").collect()  # at most k rows
        costs.append(sum(r["cost"] for r in rows))
        filled = {r["centroid_id"] for r in rows}
        centroids = centroids.copy()
        for r in rows:
            mean = np.array(r["sums"]) / r["n"]
            centroids[r["centroid_id"]] = np.floor(mean + 0.5) if codes else mean
        empty = [c for c in range(len(centroids)) if c not in filled]
        if empty:
            centroids[empty] = start(sample, len(empty), seed + i + 1, column)
    return centroids, costs


def train(refs: DataFrame, k: int = DEFAULT_K, iters: int = DEFAULT_ITERS, sample: int = DEFAULT_SAMPLE, seed: int = DEFAULT_SEED, column: str = "vector") -> tuple[np.ndarray, list[float]]:
    """(centroids, cost before each step): :func:`lloyd` on a sample with replacement from a random start."""
    drawn = stored(sample_with_replacement(refs.select("ref_id", column), sample, seed))
    return lloyd(drawn, start(drawn, k, seed, column), iters, seed, column)


def centroid_table(spark, centroids: np.ndarray) -> DataFrame:
    """(centroid_id, c): the centroids quantised to int16 codes."""
    from tessel.functions.vectors import quantize_vector_i16

    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centroids)]
    df = spark.createDataFrame(rows, "centroid_id long, centroid array<float>")
    return df.select("centroid_id", "centroid", quantize_vector_i16(F.col("centroid")).alias("c"))


def lloyd_step(refs: DataFrame, assigned_column: str, dims: int, k: int) -> DataFrame:
    """(centroid_id, dim, cnt, mean) of the codes by bucket, as one declarative aggregation.

    Empty buckets are seeded with the codes of the reference whose id is k more than theirs.
    """
    spark = refs.sparkSession
    every = spark.range(k).select(F.col("id").alias("centroid_id"))
    means = refs.groupBy(F.col(assigned_column).alias("centroid_id")).agg(F.count(F.lit(1)).alias("cnt"), F.array(*[F.sum(F.col("q16")[i].cast("bigint")) for i in range(dims)]).alias("sums"))
    seeds = refs.where((F.col("ref_id") >= k) & (F.col("ref_id") < 2 * k)).select((F.col("ref_id") - k).alias("centroid_id"), F.col("q16").alias("seed"))
    joined = every.join(means, "centroid_id", "left").join(seeds, "centroid_id", "left")
    exploded = joined.select("centroid_id", F.coalesce("cnt", F.lit(0)).alias("cnt"), F.posexplode(F.coalesce("sums", F.transform("seed", lambda x: x.cast("bigint")))).alias("dim", "total"))
    return exploded.select("centroid_id", "dim", "cnt", F.round(F.col("total") / F.greatest(F.col("cnt"), F.lit(1)), 6).alias("mean"))
