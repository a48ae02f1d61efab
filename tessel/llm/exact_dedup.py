"""Exact dedup: group by a 128-bit content hash, keep one row, compare bytes inside groups.

Only DataFrame functions. Two scans of the documents: the first makes a narrow key table (id, length,
hash), the second fetches the texts of groups with more than one row and compares them byte for byte.
A group of copies, however large, collapses to one row per map task before either shuffle. Rows whose
hash has at least 1/HOT of all rows (so at most HOT hashes) meet their group by a broadcast; no task
gets such a group whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import BROADCAST_BYTES, small, stripped, without, written

#: A hash of at least 1/HOT of all rows is hot. At most HOT hashes are, whatever the input.
HOT = 1024


def hash128(text: Column) -> Column:
    """The 128-bit content hash, as 16 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def _best(ids: Column, chars: Column) -> Column:
    """The greatest of these has the most code points, then the smallest id; null ids come last."""
    return F.max(F.struct(chars.alias("n"), F.bitwise_not(ids).alias("not_id")))


def _hot_hashes(groups: DataFrame, total: int) -> DataFrame | None:
    """The hot hashes of ``groups`` (a row per hash), or None if there is none."""
    hot = groups.where(F.col("group_size") * F.lit(HOT) >= F.lit(total)).select("hash")
    return hot if hot.limit(1).count() else None


def _by_hash(rows: DataFrame, groups: DataFrame, hot: DataFrame | None, how: str) -> DataFrame:
    """``rows`` joined on hash with ``groups`` (a row per hash): by broadcast for hot hashes, else by a shuffle."""
    if hot is None:
        return rows.join(groups, "hash", how)
    hot = F.broadcast(hot)
    near = rows.join(F.broadcast(groups.join(hot, "hash", "left_semi")), "hash", how)
    return near.unionByName(rows.join(hot, "hash", "left_anti").join(groups, "hash", how))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = stripped,
    content_hash: Callable[[Column], Column] = hash128,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Rows are equal if their normalised texts are, byte for byte. The row with the most code points in
    the original text stays, of these the one with the smallest id.

    * A null text counts as empty; all empty texts form one group.
    * A null id loses against any other; several rows with a null id are told apart by nothing.
    * Rows that repeat an id and a text are equal and all carry ``kept`` if their id stays
      (:func:`keep_first` leaves one).
    * An empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    norm = base.select("doc_id", F.length("text").alias("n_chars"), normalise(F.col("text")).alias("norm"))
    hashed = norm.select("doc_id", "n_chars", content_hash(F.col("norm")).alias("hash"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "norm")

    keys = written(hashed.drop("norm"), "dedup-keys")
    groups = written(
        keys.groupBy("hash").agg(F.count(F.lit(1)).alias("group_size"), _best(F.col("doc_id"), F.col("n_chars")).alias("best")).select("hash", "group_size", F.bitwise_not("best.not_id").alias("keep_id")),
        "dedup-groups",
    )
    several = groups.where("group_size > 1").select("hash")
    n_several = several.count()
    hot = _hot_hashes(groups, keys.count())
    out = _by_hash(keys, groups, hot, "inner")
    if n_several:
        # Equal texts fall together map-side, so a group sends one text per task whatever its size.
        texts = hashed.select("hash", "norm")
        fits = n_several * 32 <= BROADCAST_BYTES
        texts = texts.join(F.broadcast(several), "hash", "left_semi") if fits else _by_hash(texts, several, hot, "left_semi")
        clashes = written(texts.groupBy("hash", "norm").agg(F.count(F.lit(1)).alias("n")).groupBy("hash").count().where("count > 1").select("hash"), "dedup-clashes")
        n_clashes = clashes.count()
        if n_clashes:  # different texts under one hash: there the text itself is the key
            apart = hashed.join(small(clashes, n_clashes, 32), "hash", "left_semi")
            classes = apart.groupBy("hash", "norm").agg(F.count(F.lit(1)).alias("group_size"), _best(F.col("doc_id"), F.col("n_chars")).alias("best"))
            classes = classes.select("hash", "norm", "group_size", F.bitwise_not("best.not_id").alias("keep_id"))
            fixed = apart.join(classes, ["hash", "norm"]).drop("norm")
            out = out.join(small(clashes, n_clashes, 32), "hash", "left_anti").unionByName(fixed)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_chars")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, columns unchanged.

    Rows that repeat an id and a text are reduced to one of them. Rows with a null id are never
    dropped, since nothing names them.
    """
    found = written(exact_dedup(docs, id_col, text_col), "dedup-result")
    dropped = found.where("not kept").select(F.col("doc_id").alias(id_col)).dropna()
    out = without(docs, dropped.distinct(), id_col)
    again = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(id_col))
    n_again = again.count()
    if n_again:
        again = written(again, "dedup-repeats")
        twice = out.join(small(again, n_again, 24), id_col, "left_semi").dropDuplicates([id_col])
        out = out.join(small(again, n_again, 24), id_col, "left_anti").unionByName(twice)
    return out
