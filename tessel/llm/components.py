"""Connected components by contraction, a few grouped aggregations a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for all nodes of ``edges`` (a long, b long): label is the least node of the component.

    In each round every node is replaced by the first of itself and its neighbours in the order of the round; what is
    left of the edges goes on. The first round goes by the nodes' numbers, so a star around its least node is done at
    once; later ones go by a fresh hash of them. Of a node and its neighbours each is equally likely to be first, so a
    constant share of the nodes is expected to go each round, whatever the graph and its numbers: about 10 to 16 rounds
    for a chain of 10,000 nodes. State is written each round. A node with very many edges is pre-aggregated map-side,
    and its partition of a join can be split. Loops and repeated edges are harmless.
    """
    one_way = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    edges = written(edges.where("a != b").select(*one_way(F.col("a"), F.col("b"))).distinct(), "components-edges")
    labels, turn = None, 0
    while True:
        place = lambda c, turn=turn: F.struct((F.xxhash64(c, F.lit(turn)) if turn else F.col(c)).alias("h"), F.col(c).alias("n"))
        first = F.least(place("a"), place("b"))
        ends = edges.select(F.col("a").alias("node"), first.alias("first")).unionByName(edges.select(F.col("b").alias("node"), first.alias("first")))
        near = written(ends.groupBy("node").agg(F.min("first")["n"].alias("to")), "components-first")
        if labels is None:
            labels = near.select("node", F.col("to").alias("label"))
        else:
            step = near.select(F.col("node").alias("label"), "to")
            labels = written(labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "components-labels")
        left, right = near.select(F.col("node").alias("a"), F.col("to").alias("x")), near.select(F.col("node").alias("b"), F.col("to").alias("y"))
        edges = edges.join(left, "a").join(right, "b").where("x != y").select(*one_way(F.col("x"), F.col("y"))).distinct()
        edges = written(edges, "components-edges")
        if not edges.limit(1).count():
            break
        turn += 1
    if not turn:
        return labels
    least = labels.groupBy("label").agg(F.min("node").alias("least"))
    return written(labels.join(least, "label").select("node", F.col("least").alias("label")), "components-labels")
