"""Approximate nearest neighbours by a permutation index.

Every vector is described by its ``length`` nearest of a set of pivots, in order. It is posted in the
inverted files of its first ``postings`` pivots. A query opens the files of its first ``probes``
pivots (more of them the more pivots there are); in each, vectors are ranked by the footrule distance of the two
permutations and the nearest ``rerank`` share (``least`` at the least) is reranked by the exact cosine. Files are split
into shards of about ``shard`` vectors and the queries into blocks of four times that, by hash, so a pivot near which
most vectors lie (or one vector repeated in a third of the rows) gives many equal tasks.

Vectors travel with their postings: a file's share that is reranked is large where vectors form no clusters, and
fetching the vectors of all candidates afterwards would move each one once for every query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.llm.common import small, written

#: Rows of a batch of postings at most, each a vector and its permutation.
POSTED_ROWS = 1 << 14


def valid_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec array<double>): rows with an id and a finite vector other than zero; of a repeated id the least vector.

    Only the vectors of repeated ids are shuffled; the others stay where they were read.
    """
    vec = F.col(vec_col).cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).where("vec_id is not null and vec is not null and size(vec) > 0")
    rows = written(rows.where(F.forall("vec", fine) & F.exists("vec", lambda x: x != 0)), "ann-valid")
    repeated = written(rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id"), "ann-repeated")
    n = repeated.count()
    if not n:
        return rows
    repeated = small(repeated, n, 16)
    least = rows.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("vec").alias("vec"))
    return written(rows.join(repeated, "vec_id", "left_anti").unionByName(least), "ann-vectors")


def choose_pivots(vectors: DataFrame, count: int) -> np.ndarray:
    """Up to ``count`` distinct unit vectors from a bounded sample, the first 4 x count by a hash of the id."""
    rows = vectors.select("vec", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(4 * count).collect()
    if not rows:
        return np.zeros((0, 0))
    sample = np.array([r["vec"] for r in rows])
    sample = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    _, first = np.unique(sample, axis=0, return_index=True)
    return sample[np.sort(first)[:count]]


def files_opened(n_pivots: int) -> int:
    """Files that a query opens: 40 of 256, and with more pivots (smaller shares of the rows) as many more as their square root grows."""
    return min(n_pivots, int(np.ceil(40 * np.sqrt(max(n_pivots, 256) / 256))))


#: Bounds of the number of pivots; permutations hold them in 16 bits.
FEWEST, MOST = 256, 16_384


def footrule(perms: np.ndarray, query: np.ndarray, n_pivots: int) -> np.ndarray:
    """Footrule distances of permutations (rows of pivots, nearest first) to the query's, but for a constant.

    A pivot that one of the two doesn't name stands behind its last. Of the pivots of both, the sum of the differences
    of their places; what the query's other pivots add is a constant less the places of the common ones. For a pivot at
    place p of the query and j of the other both come to |p - j| + p = 2 max(p, j) - j, and the sum of j is a constant.
    """
    length = perms.shape[1]
    # 16 bits, where they suffice, make the sum and a stable sort (by radix) several times faster.
    kind = np.int16 if 2 * length * length < 1 << 15 else np.int32
    place = np.full(n_pivots, length, kind)
    place[query] = np.arange(length, dtype=kind)
    return 2 * np.maximum(place[perms], np.arange(length, dtype=kind)).sum(axis=1, dtype=kind)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def matrix(column: pa.Array | pa.ChunkedArray, kind: str, width: int) -> np.ndarray:
    """The rows of a binary column without nulls, ``width`` numbers each."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def nearest(
    rows: DataFrame,
    k: int = 5,
    is_query: str = "vec_id % 50 = 0",
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    pivots: int | None = None,
    length: int = 64,
    postings: int = 8,
    probes: int | None = None,
    rerank: float = 0.25,
    least: int = 32,
    shard: int = 4096,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` rows found nearest to each query by cosine.

    ``pivots`` defaults to the square root of the number of vectors, between 256 and 16,384, ``probes`` to
    :func:`files_opened` (40 to 320). All vectors are indexed; the pivots are a sample of that size.

    * Vectors that are null, empty or zero, or that hold a null or a non-finite number, take no part;
      neither do rows with a null id, nor vectors of another length than the commonest.
    * Of rows that repeat an id the one with the least vector (number by number, then the shorter) is used. A query
      never finds its own id.
    * Ties go to the smaller id. With fewer than ``k`` other vectors all are returned.
    * An empty table gives no rows; other columns are not read.
    """
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    vectors = valid_vectors(rows, id_col, vec_col)
    sizes = vectors.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    vectors = vectors.where(F.size("vec") == sizes["d"])
    total = sizes["count"]
    unit = choose_pivots(vectors, pivots or int(np.clip(np.sqrt(total), FEWEST, MOST)))
    n_pivots = len(unit)
    length, post, probe = min(length, n_pivots), min(postings, n_pivots), min(probes or files_opened(n_pivots), n_pivots)

    # Vectors travel as bytes of their own type; they are computed with in double precision.
    kind, width = "<f4" if rows.select(vec_col).dtypes[0][1] == "array<float>" else "<f8", sizes["d"]
    binary = lambda table: pa.array([r.tobytes() for r in table], pa.binary())

    def permute(batches):
        for b in batches:
            x = b["vec"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            sim = (x / norms(x)[:, None]) @ unit.T
            order = np.argsort(-sim, axis=1, kind="stable").astype("<i2")
            # A query may open more files than a permutation is long.
            opens = pa.array([o.tobytes() if a else None for o, a in zip(order[:, :probe], b["asks"].to_pylist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b["vec_id"], binary(x.astype(kind)), binary(order[:, :length]), opens, b["asks"]], ["vec_id", "vec", "perm", "opens", "asks"])

    permuted = written(vectors.withColumn("asks", F.expr(is_query)).mapInArrow(permute, "vec_id long, vec binary, perm binary, opens binary, asks boolean"), "ann-permutations")

    def openings(batches):
        for b in batches:
            posted = np.bincount(matrix(b["perm"], "<i2", length)[:, :post].ravel(), minlength=n_pivots)
            asked = np.bincount(matrix(b["opens"].drop_null(), "<i2", probe).ravel(), minlength=n_pivots)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_pivots, dtype=np.int32)), pa.array(posted), pa.array(asked)], ["pivot", "posted", "asked"])

    # One row per pivot: at most MOST rows, whatever the input.
    counts = permuted.select("perm", "opens").mapInArrow(openings, "pivot int, posted long, asked long").groupBy("pivot").agg(F.sum("posted").alias("posted"), F.sum("asked").alias("asked")).collect()
    shards, blocks = np.ones(n_pivots, np.int64), np.ones(n_pivots, np.int64)
    for r in counts:
        shards[r["pivot"]], blocks[r["pivot"]] = max(1, -(-r["posted"] // shard)), max(1, -(-r["asked"] // (4 * shard)))

    def dealt(side: int):
        """Copies of a row for the files (pivot, shard, block) that it belongs to."""

        def deal(batches):
            for b in batches:
                ids = b["vec_id"].to_numpy()
                spread = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
                own, across = (shards, blocks) if side == 0 else (blocks, shards)
                files = (matrix(b["perm"], "<i2", length)[:, :post] if side == 0 else matrix(b["opens"], "<i2", probe)).astype(np.int64)
                row = np.repeat(np.arange(len(ids)), files.shape[1])
                pivot = files.ravel()
                mine = (spread[row] % own[pivot].astype(np.uint64)).astype(np.int64)
                times = across[pivot]
                again = np.repeat(np.arange(len(row)), times)
                other = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
                row, pivot, mine = row[again], pivot[again], mine[again]
                s, block = (mine, other) if side == 0 else (other, mine)
                file = (pivot << 44) + (s << 22) + block
                for at in range(0, len(row), POSTED_ROWS):
                    of = pa.array(row[at : at + POSTED_ROWS])
                    yield pa.RecordBatch.from_arrays([pa.array(file[at : at + POSTED_ROWS]), *(b[c].take(of) for c in ("vec_id", "vec", "perm"))], ["file", "vec_id", "vec", "perm"])

        return deal

    dealt_schema = "file long, vec_id long, vec binary, perm binary"
    posted = permuted.select("vec_id", "vec", "perm").mapInArrow(dealt(0), dealt_schema)
    asked = permuted.where("asks").mapInArrow(dealt(1), dealt_schema)

    def search(index: pa.Table, queries: pa.Table) -> pa.Table:
        query_ids, near, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(index) and len(queries):
            index = index.sort_by("vec_id")
            ids, x = index["vec_id"].to_numpy(), matrix(index["vec"], kind, width).astype(float)
            size = norms(x)
            # Place after place in memory, and of the type that indexes arrays: each query looks all of them up.
            perm = np.asfortranarray(matrix(index["perm"], "<i2", length), np.intp)
            keep = max(int(np.ceil(rerank * len(ids))), least)
            asking, perms = matrix(queries["vec"], kind, width).astype(float), matrix(queries["perm"], "<i2", length)
            for qid, q, p, own in zip(queries["vec_id"].to_numpy(), asking, perms, norms(asking), strict=True):
                other = np.flatnonzero(ids != qid)
                if len(other) > keep:
                    far = footrule(perm, p, n_pivots)
                    other = other[np.argsort(far[other], kind="stable")[:keep]]
                score = (x[other] * q).sum(axis=1) / (size[other] * own)
                best = np.lexsort((ids[other], -score))[:k]
                query_ids.append(np.full(len(best), qid))
                near.append(ids[other][best])
                scores.append(score[best])
        return pa.table({"query_id": np.concatenate(query_ids), "vec_id": np.concatenate(near), "score": np.concatenate(scores)})

    found = posted.groupBy("file").cogroup(asked.groupBy("file")).applyInArrow(search, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
