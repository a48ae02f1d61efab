"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

Documents are sets of shingles (``shingle`` consecutive words). Documents with equal sets are one class
of copies, of which only the first goes on. Each set is entered in ``TREES`` prefix tries by ``DEPTH``
minimum hashes a trie; a node of a trie is a prefix, its members the sets below it.

A set opens one node on its path in each trie, and is compared with the members of the nodes that it opens. How
long the prefixes are hangs on the data: they start at all ``DEPTH`` levels and are shortened, where that adds the
fewest members for what it gains, until a partner at the threshold is met with the target recall
(:func:`opened_depths`). Nodes of at most ``crowd`` members are opened at once at the shortest prefix that is ever needed,
where they cost little; so a set in a sparse part of the corpus ends at short prefixes in all tries, and one
among many that share boilerplate at long ones in the tries where it is crowded. A node that any member opens is
opened for all of them, so both sides of a pair agree. Every candidate pair is verified on the whole sets.

Verification works on blocks of documents, so that a large group of near copies is neither gathered in
one task nor expanded into rows of pairs: the groups that opened nodes connect are dealt, by size of the sets, into
blocks of about ``block`` documents; each pair of blocks that shares a node, and whose sizes can be similar, is a
task, and a task returns numbers of links and a spanning forest of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.llm import textbytes as T
from tessel.llm.common import small, small_batches, without, written
from tessel.llm.components import components

_rng = np.random.Generator(np.random.PCG64(8128))
#: Tries, and levels of each.
TREES, DEPTH = 32, 8
#: Multipliers and additions of the minimum hashes, one for each trie and level.
_MUL = _rng.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)
#: Entries of a dense block product, which bounds the memory of a verification.
COLUMNS = 8192
#: Matches of keys that a task holds at once.
MATCHES = 1 << 20


def gains(threshold: float) -> np.ndarray:
    """By depth from 0: what a trie adds to -log(share of the pairs at the threshold that are missed)."""
    return -np.log1p(-np.minimum(threshold ** np.arange(DEPTH + 1, dtype=float), 1 - 1e-15))


def shortest_prefix(threshold: float, recall: float) -> int:
    """The longest prefix with which all tries together reach the recall: none is ever shortened beyond it."""
    need = -np.log1p(-recall)
    return max([d for d in range(1, DEPTH + 1) if TREES * gains(threshold)[d] >= need], default=1)


def opened_depths(sizes: np.ndarray, threshold: float, recall: float) -> np.ndarray:
    """The depth of the node that a set opens in each trie.

    ``sizes[i, j]`` is the number of members of its node at depth ``floor + j`` of trie i, ``floor`` being the
    :func:`shortest_prefix`. All start at the full depth; steps to shorter prefixes are taken, the one that adds the fewest members
    for its gain first, until the recall is reached.
    """
    g, floor = gains(threshold), DEPTH - sizes.shape[1] + 1
    depth = np.full(len(sizes), DEPTH)
    have, need = len(sizes) * g[DEPTH], -np.log1p(-recall)
    if have >= need or floor == DEPTH:
        return depth
    # Steps from depth d to d - 1, the first at the full depth; one is taken only after those before it in its trie.
    more = (sizes[:, :-1] - sizes[:, 1:])[:, ::-1]
    gain = (g[floor:DEPTH] - g[floor + 1 : DEPTH + 1])[::-1]
    price = np.maximum.accumulate(more / gain, axis=1)
    order = np.argsort(price, axis=None, kind="stable")
    taken = order[: int(np.searchsorted(have + np.cumsum(np.broadcast_to(gain, price.shape).ravel()[order]), need)) + 1]
    return depth - np.bincount(taken // price.shape[1], minlength=len(sizes))


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, distinct shingle hashes row by row, offsets of the rows).

    A text of fewer than ``k`` words (but some) has one shingle, all its words; one without words none.
    """
    for row, stop, at, data in T.chunks(texts):
        starts, ends = T.word_spans(data, at, T.NOT_SPACE)
        words = T.span_hash(T.prefix_hash(data), starts, ends)
        n = np.diff(np.searchsorted(starts, at))
        of = np.repeat(np.arange(stop - row), n)
        grams = T.gram_hash(words, k)
        inside = np.flatnonzero(of[: len(grams)] == of[k - 1 :]) if len(grams) else np.zeros(0, np.int64)
        hashes, rows = grams[inside], of[inside]
        few = np.flatnonzero((n > 0) & (n < k))
        if len(few):
            first = np.cumsum(n) - n
            whole = np.array([T.gram_hash(words[first[r] : first[r] + n[r]], int(n[r]))[0] for r in few], np.uint64)
            hashes, rows = np.concatenate((hashes, whole)), np.concatenate((rows, few))
        order = np.lexsort((hashes, rows))
        hashes, rows = hashes[order], rows[order]
        new = np.ones(len(rows), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
        hashes, rows = hashes[new], rows[new]
        yield row, stop, hashes, np.searchsorted(rows, np.arange(stop - row + 1))


def set_hash(hashes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit hash of each set, two sums over its members."""
    with np.errstate(over="ignore"):
        sums = [np.concatenate(([np.uint64(0)], np.cumsum(T.mix(hashes ^ np.uint64(seed)), dtype=np.uint64))) for seed in (0x5BF03635, 0x2545F4914F6CDD1D)]
        return tuple((s[cuts[1:]] - s[cuts[:-1]]).view(np.int64) for s in sums)


#: A set's path in a trie: a hash of the prefix of the shortest length, and 16 bits of each level.
PATH = np.dtype([("top", "<u8"), ("levels", "<u2", DEPTH)])


def signatures(hashes: np.ndarray, cuts: np.ndarray, floor: int) -> np.ndarray:
    """(rows, TREES) of :data:`PATH`; zeros for empty sets."""
    rows = np.flatnonzero(cuts[1:] > cuts[:-1])
    out = np.zeros((len(cuts) - 1, TREES), PATH)
    if len(rows):
        at = cuts[rows]
        with np.errstate(over="ignore"):
            for tree in range(TREES):
                key = np.full(len(rows), tree + 1, np.uint64)
                for level in range(DEPTH):
                    i = tree * DEPTH + level
                    least = T.mix(np.minimum.reduceat((hashes * _MUL[i] + _ADD[i]) >> np.uint64(20), at))
                    if level < floor:
                        key = T.mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
                    out["levels"][rows, tree, level] = least & np.uint64(0xFFFF)
                out["top"][rows, tree] = key
    return out


def node_keys(paths: np.ndarray, floor: int) -> np.ndarray:
    """(…, DEPTH - floor + 1): the keys of the nodes on the paths, from depth ``floor`` on."""
    out = np.empty((*paths.shape, DEPTH - floor + 1), np.uint64)
    out[..., 0] = key = paths["top"]
    with np.errstate(over="ignore"):
        for d in range(floor, DEPTH):
            key = T.mix(key * np.uint64(0x9E3779B97F4A7C15) + paths["levels"][..., d].astype(np.uint64) + np.uint64(d + 1))
            out[..., d - floor + 1] = key
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray], pairs: np.ndarray, threshold: float) -> np.ndarray:
    """Those of ``pairs`` (indices into left and right) whose sets have the Jaccard similarity, exactly."""
    if not len(pairs):
        return pairs
    n_left, n_right = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    a, b = n_left[pairs[:, 0]], n_right[pairs[:, 1]]
    pairs = pairs[np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9]
    if len(pairs) < 64:
        both = np.array([len(np.intersect1d(left[i], right[j], assume_unique=True)) for i, j in pairs], np.int64)
    else:
        rows, cols = np.unique(pairs[:, 0]), np.unique(pairs[:, 1])
        x, y = np.concatenate([left[i] for i in rows]), np.concatenate([right[j] for j in cols])
        x_row, y_row = np.repeat(np.arange(len(rows)), n_left[rows]), np.repeat(np.arange(len(cols)), n_right[cols])
        shared = np.intersect1d(x, y)
        xi, yi = np.searchsorted(shared, x), np.searchsorted(shared, y)
        xi_in, yi_in = xi < len(shared), yi < len(shared)
        xi_in[xi_in] = shared[xi[xi_in]] == x[xi_in]
        yi_in[yi_in] = shared[yi[yi_in]] == y[yi_in]
        x_row, xi, y_row, yi = x_row[xi_in], xi[xi_in], y_row[yi_in], yi[yi_in]
        x_by, y_by = np.argsort(xi, kind="stable"), np.argsort(yi, kind="stable")
        x_row, xi, y_row, yi = x_row[x_by], xi[x_by], y_row[y_by], yi[y_by]
        total = np.zeros((len(rows), len(cols)), np.float64)
        for c in range(0, len(shared), COLUMNS):
            u, v = np.zeros((len(rows), COLUMNS), np.float32), np.zeros((len(cols), COLUMNS), np.float32)
            s, e = np.searchsorted(xi, (c, c + COLUMNS))
            u[x_row[s:e], xi[s:e] - c] = 1
            s, e = np.searchsorted(yi, (c, c + COLUMNS))
            v[y_row[s:e], yi[s:e] - c] = 1
            total += u @ v.T
        both = total[np.searchsorted(rows, pairs[:, 0]), np.searchsorted(cols, pairs[:, 1])].astype(np.int64)
    a, b = n_left[pairs[:, 0]], n_right[pairs[:, 1]]
    return pairs[both >= threshold * (a + b - both) - 1e-9]


def forest_pairs(left: list[np.ndarray], right: list[np.ndarray], same: bool) -> np.ndarray:
    """Pairs of rows with an opened node in common, each pair once; a row is the keys of its nodes."""
    key, other = np.concatenate(left), np.concatenate(right)
    row, col = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    order = np.argsort(other, kind="stable")
    other, col = other[order], col[order]
    lo, hi = np.searchsorted(other, key, "left"), np.searchsorted(other, key, "right")
    found = [np.zeros(0, np.int64)]
    n = hi - lo
    steps = np.concatenate(([0], np.flatnonzero(np.diff(np.cumsum(n) // MATCHES)) + 1, [len(n)]))
    for s, e in zip(steps, steps[1:], strict=False):  # a few matches at a time, which bounds the memory
        m = n[s:e]
        j = col[np.repeat(lo[s:e] - np.cumsum(m) + m, m) + np.arange(m.sum())]
        found.append(np.unique(np.repeat(row[s:e], m) * len(right) + j))
    codes = np.unique(np.concatenate(found))
    pairs = np.stack([codes // len(right), codes % len(right)], 1)
    return pairs[pairs[:, 0] < pairs[:, 1]] if same else pairs


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the pairs connect: each node and the least node of its component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = label.copy()
        np.minimum.at(least, x, label[y])
        np.minimum.at(least, y, label[x])
        least = least[least]
        if (least == label).all():
            return nodes[label], nodes
        label = least


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, shingle: int = 5, recall: float = 0.99999, block: int = 256, crowd: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, set_id, n_copies, n_links, n_shingles.

    Two documents are linked if the Jaccard similarity of their sets of ``shingle`` consecutive words
    (split at the contracts' white space) is ``threshold`` or more. ``class_id`` is the least id that
    links lead to, ``set_id`` the least id with an equal set, ``n_copies`` the number of other rows with
    an equal set and ``n_links`` that of all other rows that the document is linked to.

    * A text of fewer words than a shingle has one shingle, all its words.
    * Null texts, and texts without words, have empty sets: they are copies of each other and linked to
      nothing else.
    * Rows with a null id take part as copies of equal sets, but a set of which no row has an id isn't
      compared with others; its class is null.
    * Rows that repeat an id are rows of their own; if their texts differ and their set names itself by
      that id, each text is still compared as its own set.
    * A pair at the threshold is found with probability ``recall`` or more, a more similar one more surely, and
      always verified exactly; no list of candidates has a cap. Other columns are not read. An empty table gives no rows.
    """
    floor = shortest_prefix(threshold, recall)
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def signed(batches):
        for b in batches:
            ids = b["doc_id"]
            for row, stop, hashes, cuts in shingle_sets(b["text"], shingle):
                one, two = set_hash(hashes, cuts)
                blobs = [s.tobytes() for s in signatures(hashes, cuts, floor)]
                yield pa.RecordBatch.from_arrays([ids[row:stop], pa.array(one), pa.array(two), pa.array(np.diff(cuts).astype(np.int64)), pa.array(blobs, pa.binary())], ["doc_id", "one", "two", "n_shingles", "sig"])

    signed_rows = written(base.mapInArrow(signed, "doc_id long, one long, two long, n_shingles long, sig binary"), "jaccard-signatures")
    # Copies collapse map-side; signatures of equal sets are equal.
    sets = written(
        signed_rows.groupBy("one", "two").agg(F.min("doc_id").alias("set_id"), F.count(F.lit(1)).alias("size"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")),
        "jaccard-sets",
    )
    # One number for a set: its hash folded, so that two sets that share an id stay apart.
    node = F.xxhash64("one", "two")
    live = sets.where("n_shingles > 0 and set_id is not null").withColumn("node", node)
    met = _forest(live, threshold, recall, floor, crowd)
    if met.limit(1).count():
        counts, edges = _verified(base, live, met, threshold, shingle, block)
    else:
        spark = docs.sparkSession
        counts, edges = spark.createDataFrame([], "node long, links long"), spark.createDataFrame([], "a long, b long")
    named = sets.drop("sig").withColumn("node", node).join(counts, "node", "left")
    classes = components(edges)
    ends = named.join(classes.withColumnRenamed("label", "class_node"), "node", "left").withColumn("class_node", F.coalesce("class_node", "node"))
    least = ends.groupBy("class_node").agg(F.min("set_id").alias("class_id"))
    ends = written(ends.join(least, "class_node").select("one", "two", "set_id", "class_id", "size", F.coalesce("links", F.lit(0)).alias("links")), "jaccard-classes")
    out = signed_rows.select("doc_id", "one", "two", "n_shingles").join(ends, ["one", "two"])
    return out.select("doc_id", "class_id", "set_id", (F.col("size") - 1).alias("n_copies"), (F.when(F.col("n_shingles") > 0, F.col("size") - 1).otherwise(0) + F.col("links")).alias("n_links"), "n_shingles")


def _paths(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), PATH).reshape(-1, TREES)


def _forest(live: DataFrame, threshold: float, recall: float, floor: int, crowd: int) -> DataFrame:
    """(prefix, node) of the opened nodes with several members; a set is in one node of a trie at most."""

    def tops(batches):
        for b in batches:
            keys = _paths(b["sig"])["top"]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b["node"].to_numpy(), TREES)), pa.array(keys.ravel().view(np.int64))], ["node", "prefix"])

    prefixes = written(live.select("node", "sig").mapInArrow(tops, "node long, prefix long"), "jaccard-prefixes")
    shared = prefixes.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = written(prefixes.join(shared, "prefix"), "jaccard-shared")
    if not met.where(F.col("n") > crowd).limit(1).count():
        return met.select("prefix", "node")
    # Sets with a crowded node: the sizes of all nodes on their paths there, then the depths that they open.
    sized = met.groupBy("node").agg(F.collect_list(F.struct("prefix", "n")).alias("tops"), F.max("n").alias("most")).where(F.col("most") > crowd)
    busy = written(sized.join(live.select("node", "sig"), "node").select("node", "sig", "tops"), "jaccard-busy")

    def top_sizes(paths: np.ndarray, tops: list) -> np.ndarray:
        """(sets, TREES): members of the shortest prefixes; 1 where a set is alone."""
        out = np.ones(paths.shape, np.int64)
        for row, (path, known) in enumerate(zip(paths["top"], tops, strict=True)):
            n = {t["prefix"] & 0xFFFFFFFFFFFFFFFF: t["n"] for t in known}
            out[row] = [n.get(k, 1) for k in path.tolist()]
        return out

    def deeper(batches):
        for b in batches:
            paths = _paths(b["sig"])
            row, tree = np.nonzero(top_sizes(paths, b["tops"].to_pylist()) > crowd)
            keys = node_keys(paths, floor)[row, tree, 1:]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b["node"].to_numpy()[row], keys.shape[1])), pa.array(keys.ravel().view(np.int64))], ["node", "prefix"])

    deep = written(busy.mapInArrow(deeper, "node long, prefix long"), "jaccard-deeper")
    several = deep.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    several = deep.join(several, "prefix").groupBy("node").agg(F.collect_list(F.struct("prefix", "n")).alias("deep"))
    ready = busy.join(several, "node", "left")

    def opened(batches):
        """The keys of a set's nodes in its crowded tries by depth; ``wanted``: it opens the node, which has other members."""
        for b in batches:
            paths = _paths(b["sig"])
            sizes = np.ones((*paths.shape, DEPTH - floor + 1), np.int64)
            sizes[..., 0] = top_sizes(paths, b["tops"].to_pylist())
            keys = node_keys(paths, floor)
            out = []
            for row, (node, known) in enumerate(zip(b["node"].to_pylist(), b["deep"].to_pylist(), strict=True)):
                n = {t["prefix"] & 0xFFFFFFFFFFFFFFFF: t["n"] for t in known or ()}
                crowded = np.flatnonzero(sizes[row, :, 0] > crowd)
                for tree in crowded:
                    sizes[row, tree, 1:] = [n.get(k, 1) for k in keys[row, tree, 1:].tolist()]
                depth = opened_depths(np.where((sizes[row, :, :1] > crowd), sizes[row], 0), threshold, recall)
                for tree in crowded.tolist():
                    out += [(node, tree, d, int(keys[row, tree, d].view(np.int64)), bool(depth[tree] == floor + d)) for d in range(DEPTH - floor + 1) if sizes[row, tree, d] > 1]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["node", "tree", "depth", "prefix", "wanted"])

    paths = written(ready.mapInArrow(opened, "node long, tree int, depth int, prefix long, wanted boolean"), "jaccard-paths")
    wanted = paths.where("wanted").select("prefix").distinct()
    # The shortest opened prefix on a path holds the longer ones.
    crowded = paths.join(wanted, "prefix").groupBy("node", "tree").agg(F.min(F.struct("depth", "prefix"))["prefix"].alias("prefix")).select("prefix", "node")
    return written(met.where(F.col("n") <= crowd).select("prefix", "node").unionByName(crowded), "jaccard-opened")


def _verified(base: DataFrame, live: DataFrame, met: DataFrame, threshold: float, shingle: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(node, links) and the spanning edges (a, b) of the pairs that share a prefix and are similar."""
    roots = met.groupBy("prefix").agg(F.min("node").alias("root"))
    groups = components(met.join(roots, "prefix").where("node != root").select(F.col("root").alias("a"), F.col("node").alias("b")))
    # Sets whose sizes lie two steps apart can't be similar.
    step = F.floor(F.log(F.col("n_shingles").cast("double")) / float(-np.log(threshold * 0.999))).cast("int") if threshold < 1 else F.col("n_shingles").cast("int")
    groups = written(groups.join(live.select("node", step.alias("step")), "node"), "jaccard-groups")
    sizes = groups.groupBy("label", "step").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("members", F.sum("n").over(Window.partitionBy("label"))).withColumnsRenamed({"label": "l", "step": "s"})
    sized = groups.join(sizes, (F.col("label") == F.col("l")) & (F.col("step") == F.col("s"))).drop("l", "s")
    # Small groups share a block; a large one is dealt into several by size.
    n_small = sized.where(F.col("members") <= block).count()
    bins = max(1, -(-n_small // block))
    large = F.col("members") > block
    within = F.when(large, F.pmod(F.xxhash64("node", F.lit(7)), F.ceil(F.col("n") / block))).otherwise(0)
    area = F.when(large, F.col("label")).otherwise(F.pmod(F.xxhash64("label"), F.lit(bins)))
    step = F.when(large, F.col("step"))
    placed = written(sized.select("node", F.xxhash64(large, area, F.coalesce(step, F.lit(-1)), within).alias("block"), step.alias("step")), "jaccard-blocks")
    # Pairs of blocks with a prefix in common; a prefix is in few blocks, as those hold many documents.
    seen = met.join(placed, "node").select("prefix", "block", "step").distinct()
    near = F.col("step").isNull() | F.col("other_step").isNull() | (F.abs(F.col("step") - F.col("other_step")) <= 1)
    pairs = seen.join(seen.withColumnsRenamed({"block": "other", "step": "other_step"}), "prefix").where("block <= other").where(near).select("block", "other").distinct()
    tasks = written(pairs, "jaccard-tasks")

    # Shingles of the sets' first documents, found again by id and set, and the nodes that they are in.
    opened = met.groupBy("node").agg(F.collect_list("prefix").alias("keys"))
    wanted = live.join(placed, "node").join(opened, "node").select("node", "set_id", "one", "two", "size", "keys", "block")
    wanted = written(wanted, "jaccard-wanted")
    n = wanted.count()
    texts = base.join(small(wanted.select("set_id").distinct(), n, 24), F.col("doc_id") == F.col("set_id"), "left_semi")

    def sets_again(batches):
        for b in batches:
            ids = b["doc_id"]
            for row, stop, hashes, cuts in shingle_sets(b["text"], shingle):
                one, two = set_hash(hashes, cuts)
                blobs = [hashes[s:e].tobytes() for s, e in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([ids[row:stop], pa.array(one), pa.array(two), pa.array(blobs, pa.binary())], ["doc_id", "one", "two", "shingles"])

    shingled = texts.mapInArrow(sets_again, "doc_id long, one long, two long, shingles binary").withColumnRenamed("doc_id", "set_id")
    members = shingled.join(wanted, ["set_id", "one", "two"]).dropDuplicates(["node"]).select("node", "size", "keys", "shingles", "block")
    members = written(members, "jaccard-members")
    sides = tasks.select(F.xxhash64("block", "other").alias("task"), "block", F.lit(0).alias("side"), (F.col("block") == F.col("other")).alias("same"))
    sides = sides.unionByName(tasks.where("block != other").select(F.xxhash64("block", "other").alias("task"), F.col("other").alias("block"), F.lit(1).alias("side"), F.lit(False).alias("same")))
    rows = members.join(sides, "block").select("task", "side", "same", "node", "size", "keys", "shingles")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [pdf[pdf["side"] == s].sort_values("node") for s in (0, 1)]
        same = bool(pdf["same"].iloc[0])
        if same:
            parts[1] = parts[0]
        keys = [[np.asarray(k, np.int64) for k in p["keys"]] for p in parts]
        sets = [[np.frombuffer(x, np.uint64) for x in p["shingles"]] for p in parts]
        nodes, weight = [p["node"].to_numpy() for p in parts], [p["size"].to_numpy() for p in parts]
        empty = pd.DataFrame({"node": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "other": np.zeros(0, np.int64)})
        if not len(nodes[0]) or not len(nodes[1]):
            return empty
        good = linked(*sets, forest_pairs(*keys, same), threshold)
        if not len(good):
            return empty
        a, b = nodes[0][good[:, 0]], nodes[1][good[:, 1]]
        gained = pd.DataFrame({"node": np.concatenate((a, b)), "links": np.concatenate((weight[1][good[:, 1]], weight[0][good[:, 0]]))}).groupby("node", as_index=False)["links"].sum()
        root, node = spanning(a, b)
        # The node's links here, and the node that it is connected with (itself for the least).
        return gained.merge(pd.DataFrame({"node": node, "other": root}), on="node")

    checked = written(rows.groupBy("task").applyInPandas(verify, "node long, links long, other long"), "jaccard-links")
    counts = checked.groupBy("node").agg(F.sum("links").alias("links"))
    return counts, checked.where("node != other").select(F.col("node").alias("a"), F.col("other").alias("b"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class (the least id), columns unchanged; null ids stay."""
    found = written(join(docs, id_col, text_col, **options), "jaccard-result")
    dropped = found.where("doc_id != class_id").select(F.col("doc_id").alias(id_col)).distinct()
    return without(docs, dropped, id_col)
