"""Mixing sources to target weights by entropy balancing.

The documents' rates are those nearest in entropy to 1 (each between 0 and ``most``) under which each
source has its target of words. They have the form min(most, exp(lambda_source * size / mean size)):
the dual is convex and has one multiplier for each source, found by Newton steps, each a grouped
aggregation over the table of (source, size, number of documents). The rates become whole copies:
within a source, from the largest size to the smallest, what rounding leaves over is handed on, so the
words taken differ from the target by about the smallest size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.llm.common import salted_rank, small, small_batches, written
from tessel.llm.textbytes import word_counts

WEIGHTS = (5, 2, 1)


def with_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, source, size): words of the whole text, and a hash of it."""

    def sized(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["digest"], b["source"], pa.array(word_counts(b["text"]))], ["doc_id", "digest", "source", "size"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    return base.withColumn("digest", F.xxhash64("text")).mapInArrow(sized, "doc_id long, digest long, source string, size long")


def targets(cells: DataFrame, weights=WEIGHTS, most: float = 3.0) -> DataFrame:
    """(source, source_size, target, n): shares by weight, none above ``most`` times its source.

    What a cap leaves over is shared again by weight until no source is above: the target is
    min(cap, level * weight), and the level follows from prefix sums in the order of cap / weight.
    One row per source; the unpartitioned windows go over sources, not documents.
    """
    sources = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(nth, F.lit(len(weights))) + 1)
    sources = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    sums = sources.withColumn("capped", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    sums = sums.withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    every = Window.partitionBy(F.lit(1))
    sums = sums.withColumn("level", (F.sum("source_size").over(every) - F.col("capped")) / F.col("open"))
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    # Capping a source that fits lowers the level, so the highest level that fits is the right one.
    level = F.max(F.when(fits, F.col("level"))).over(every)
    sums = sums.withColumn("level", F.coalesce(level, F.lit(float("inf"))))
    return sums.select("source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"), "n")


def solve(cells: DataFrame, goals: DataFrame, most: float, tolerance: float, steps: int) -> DataFrame:
    """(source, lambda): the multipliers under which each source's expected words meet its target.

    Newton steps on all sources at once; a step that leaves the bracket of a source is replaced by
    halving it, so each converges whatever its sizes. A source at its cap has an infinite multiplier,
    one without a target a minus infinite one.
    """
    # One row per source (not per document) travels to the driver between steps.
    state = goals.where("source_size > 0").select("source", "source_size", "target", (F.col("source_size") / F.col("n")).alias("mean")).toPandas()
    spark = cells.sparkSession
    lam = np.zeros(len(state))
    full, none = state["target"].to_numpy() >= most * state["source_size"].to_numpy() * (1 - 1e-12), state["target"].to_numpy() <= 0
    lam[full], lam[none] = np.inf, -np.inf
    low, high = np.full(len(lam), -np.inf), np.full(len(lam), np.inf)
    goal, live = state["target"].to_numpy(), ~(full | none)
    known = cells.where("size > 0")
    exact = lambda x: x.cast("decimal(30,8)")  # noqa: E731  sums that don't hang on the order of the rows
    for _ in range(steps):
        if not live.any():
            break
        now = state.loc[live, ["source", "mean"]].assign(lam=lam[live])
        table = spark.createDataFrame([(None if s is None else str(s), float(m), float(v)) for s, m, v in now.itertuples(index=False)], "source string, mean double, lam double")
        tilted = known.join(small(table, len(now), 64).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        z = F.col("lam") * F.col("size") / F.col("mean")
        rate = F.when(z >= math.log(most), F.lit(float(most))).otherwise(F.exp(z))
        slope = F.when(z < math.log(most), F.exp(z) * F.col("size") / F.col("mean")).otherwise(0.0)
        got = tilted.groupBy("source").agg(F.sum(exact(F.col("n") * F.col("size") * rate)).cast("double").alias("words"), F.sum(exact(F.col("n") * F.col("size") * slope)).cast("double").alias("slope")).toPandas()
        got = {(None if pd.isna(r.source) else r.source): (r.words, r.slope) for r in got.itertuples()}
        for i in np.flatnonzero(live):
            source = state["source"].iloc[i]
            words, d = got[None if pd.isna(source) else source]
            if abs(words - goal[i]) <= tolerance * goal[i]:
                live[i] = False
                continue
            low[i], high[i] = (lam[i], high[i]) if words < goal[i] else (low[i], lam[i])
            step = lam[i] + (goal[i] - words) / d if d > 0 else np.nan
            if not low[i] < step < high[i] or abs(step - lam[i]) > 8:
                step = (low[i] + high[i]) / 2 if np.isfinite(low[i]) and np.isfinite(high[i]) else lam[i] + math.copysign(2 + 2 * abs(lam[i]), goal[i] - words)
            lam[i] = step
    rows = [(None if pd.isna(s) else str(s), float(v), float(m)) for s, v, m in zip(state["source"], lam, state["mean"], strict=True)]
    return spark.createDataFrame(rows, "source string, lam double, mean double")


def mix(docs: DataFrame, weights=WEIGHTS, most: float = 3.0, tolerance: float = 1e-6, steps: int = 60) -> DataFrame:
    """doc_id, digest, source, size, source_size, target, rate, copies, taken for each row of ``docs``.

    ``docs`` has doc_id, text, source; ``weights`` repeat over the sources in code point order, null
    last. ``copies`` is the number of times the document is taken, at most ``most``.

    * A null text has size 0; a document without words is taken 0 times, at rate 0.
    * Null sources are one source. Repeated rows are rows of their own; of equal ids any may get the
      extra copy, which shows in no total.
    * If no document has a word, all targets are 0. An empty table gives no rows.
    * Reruns agree: the extra copies of equally long documents of a source go by a hash of the id.
    """
    small_batches(docs.sparkSession)
    sized = written(with_sizes(docs), "mix-sizes")
    cells = written(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    goals = written(targets(cells, weights, most), "mix-targets")
    n_goals = goals.count()
    lams = solve(cells, goals, most, tolerance, steps)
    whole = int(most)

    def rounded(key, cell):
        """Copies for all documents of each size; the group has a row per size, not per document."""
        cell = cell.sort_values("size", ascending=False)
        owed, copies = 0.0, []
        for size, n, rate in zip(cell["size"], cell["n"], cell["rate"], strict=True):
            owed += size * n * rate
            c = min(max(round(owed / size), 0), whole * n) if size else 0
            owed -= c * size
            copies.append(c)
        cell["all_copies"] = copies
        return cell[["source", "size", "n", "rate", "all_copies"]]

    lams = small(lams, n_goals, 64).withColumnRenamed("source", "s")
    z = F.col("lam") * F.col("size") / F.col("mean")
    rate = F.when(F.col("size") == 0, 0.0).when(z >= math.log(most), F.lit(float(most))).otherwise(F.exp(z))
    rated = cells.join(lams, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "size", "n", F.coalesce(rate, F.lit(0.0)).alias("rate"))
    plan = written(rated.groupBy("source").applyInPandas(rounded, "source string, size long, n long, rate double, all_copies long"), "mix-copies")
    ranked = salted_rank(sized, ["source", "size"], ["doc_id"], "nth")
    joined = ranked.join(plan.select(F.col("source").alias("s"), F.col("size").alias("z"), "n", "rate", "all_copies"), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z")
    copies = F.floor(F.col("all_copies") / F.col("n")) + (F.col("nth") < F.col("all_copies") % F.col("n")).cast("long")
    joined = joined.withColumn("copies", copies.cast("long"))
    ends = small(goals, n_goals, 64).select(F.col("source").alias("s"), "source_size", "target")
    return joined.join(ends, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "digest", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as it is taken, columns unchanged.

    Rows that repeat an id and a text are taken as often as all of them together.
    """
    taken = mix(docs, **options).groupBy("doc_id", "digest").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    taken = written(taken.withColumnsRenamed({"doc_id": "mix_id", "digest": "mix_digest", "copies": "mix_copies", "rows": "mix_rows"}), "mix-taken")
    digest = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    again = taken.where("mix_rows > 1").limit(1).count()
    base = docs.withColumn("mix_key", digest)
    if again:
        base = base.dropDuplicates(["doc_id", "mix_key"])
    met = base.join(taken.where("mix_copies > 0"), base["doc_id"].cast("long").eqNullSafe(F.col("mix_id")) & (base["mix_key"] == F.col("mix_digest")))
    return met.withColumn("mix_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])
