"""Quality classifier with hierarchical empirical Bayes over sites.

A document's own evidence comes from a logistic model on the shape of its text and on the log-likelihood
ratios of the heads (first bytes) of its words, fitted on a bounded sample of labelled documents. The
evidence of all documents is summed by host and by path; a host's rate is shrunk to the global one and a
path's to its host's, the more the fewer documents there are, with strengths estimated from the spread
of the rates (moments). The posterior of a document is its own evidence with its path's rate as the
prior in place of the global one. Quality and toxicity each have rates, priors and posteriors of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm import textbytes as T
from tessel.llm.common import small, small_batches, written

#: Labelled documents that the model is fitted on at most, the first by a hash of the id.
SAMPLE = 12_000
#: Bytes of a word's head; a stem shows in all words that begin with it.
HEAD = 6
#: A head of the labelled sample counts if this many of its documents have it and its rates differ by this many
#: deviations; the model has at most so many, those that differ most.
LEAST_DOCS, LEAST_Z, MOST_HEADS = 8, 6.0, 4096
#: Bound of what a site's rate can add to a document's log odds.
SHIFT = 2.0
TARGETS = ("quality", "toxic")

_UPPER, _DIGIT, _SYMBOL, _LINE, _WIDE = (np.zeros(256, bool) for _ in range(5))
_UPPER[0x41:0x5B] = _DIGIT[0x30:0x3A] = _WIDE[0x80:] = _LINE[0x0A] = True
_SYMBOL[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in ".,'\"-:;?()"]] = True
SHAPE = 12


def features(texts: pa.Array):
    """(first row, row after the last, shape features, row and hash of each word's head) by chunk."""
    for row, stop, at, data in T.chunks(texts):
        n_rows = stop - row
        size = np.maximum(np.diff(at), 1)

        def share(table, data=data, at=at, size=size):
            sums = np.concatenate(([0], np.cumsum(table[data])))
            return (sums[at[1:]] - sums[at[:-1]]) / size

        starts, ends = T.word_spans(data, at, T.NOT_SPACE)
        hashes = T.span_hash(T.prefix_hash(data), starts, ends)
        n = np.diff(np.searchsorted(starts, at))
        of = np.repeat(np.arange(n_rows), n)
        again = np.zeros(len(of), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
        order = np.lexsort((hashes, of))
        new = np.ones(len(of), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
        words = np.maximum(n, 1)
        marked = np.zeros(len(of), bool)
        if len(of):
            marked = _SYMBOL[data[ends - 1]]
        by = lambda flags: np.bincount(of, flags, n_rows) / words
        upper, symbol, repeat = share(_UPPER), share(_SYMBOL), by(again)
        shape = np.stack([np.log1p(n), upper, np.sqrt(upper), symbol, np.sqrt(symbol), share(_DIGIT), share(_LINE), share(_WIDE), repeat, np.sqrt(repeat), np.log(np.maximum(np.bincount(of, new[np.argsort(order)], n_rows), 1) / words), by(marked)], 1)
        low = T.LOWER[data]
        starts, ends = T.word_spans(low, at, T.LOWER_WORD)
        heads = T.span_hash(T.prefix_hash(low), starts, np.minimum(ends, starts + HEAD))
        yield row, stop, shape, np.repeat(np.arange(n_rows), np.diff(np.searchsorted(starts, at))), heads


class Model:
    """Log-likelihood ratios of heads and a logistic model for each target."""

    def __init__(self, heads: np.ndarray, gain: np.ndarray):
        self.heads, self.gain = heads, gain  # gain: (targets, heads)
        self.weights: list[np.ndarray | None] = []
        self.mean = self.scale = None

    def evidence(self, n_rows: int, of: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """(rows, 2 x targets): log-likelihood ratios of the words with chosen heads, summed and per word."""
        targets = len(self.gain)
        out = np.zeros((n_rows, 2 * targets))
        if len(self.heads) and len(heads):
            at = np.minimum(np.searchsorted(self.heads, heads), len(self.heads) - 1)
            hit = self.heads[at] == heads
            words = np.maximum(np.bincount(of, minlength=n_rows), 1)
            for t in range(targets):
                out[:, t] = np.bincount(of[hit], self.gain[t][at[hit]], n_rows)
                out[:, targets + t] = 50 * out[:, t] / words
        return np.clip(out, -40, 40)

    def inputs(self, shape: np.ndarray, evidence: np.ndarray) -> np.ndarray:
        return np.concatenate([shape, evidence, np.sign(evidence) * np.sqrt(np.abs(evidence))], axis=1)

    def fit(self, x: np.ndarray, targets: np.ndarray, least: int = 5) -> None:
        """Ridge logistic models by Newton steps; a target without enough of both classes has none."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        x = np.concatenate([(x - self.mean) / self.scale, np.ones((len(x), 1))], axis=1)
        ridge = np.eye(x.shape[1])
        ridge[-1, -1] = 1e-6
        for t in range(targets.shape[1]):
            y, w = targets[:, t], np.zeros(x.shape[1])
            if min(y.sum(), len(y) - y.sum()) < least:
                self.weights.append(None)
                continue
            for _ in range(50):
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
                w -= step
                if np.abs(step).max() < 1e-8:
                    break
            self.weights.append(w)

    def predict(self, shape: np.ndarray, of: np.ndarray, heads: np.ndarray, unknown: tuple[float, ...]) -> np.ndarray:
        """(rows, targets) log odds; ``unknown`` where a target has no model."""
        out = np.empty((len(shape), len(unknown)))
        x = None
        for t, other in enumerate(unknown):
            if not self.weights or self.weights[t] is None:
                out[:, t] = other
                continue
            if x is None:
                x = (self.inputs(shape, self.evidence(len(shape), of, heads)) - self.mean) / self.scale
            out[:, t] = x @ self.weights[t][:-1] + self.weights[t][-1]
        return np.clip(out, -12, 12)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, heads: int = MOST_HEADS) -> Model:
    """A model for (quality, toxic) from at most ``sample`` labelled documents of ``docs``, with at most ``heads`` heads.

    Of ``labels`` (doc_id, quality, toxic) rows with a null are passed over, of repeated ids the least (quality, toxic) counts.
    Heads are chosen on half of the documents, the logistic models fitted on the others.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.groupBy("label_id").agg(F.min(F.struct("quality", "toxic")).alias("least")).select("label_id", "least.*")
    known = known.withColumn("order", F.xxhash64("label_id")).orderBy("order", "label_id").limit(sample)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))
    chosen = written(chosen.select("text", "quality", "toxic", (F.pmod("order", F.lit(2)) == 0).alias("held")), "quality-sample")

    def counted(batches):
        for b in batches:
            quality, toxic = (b[c].to_numpy().astype(np.int64) for c in ("quality", "toxic"))
            for row, stop, _, of, heads in features(b["text"]):
                pairs, count = np.unique(np.stack([of.astype(np.uint64), heads], 1), axis=0, return_counts=True) if len(heads) else (np.zeros((0, 2), np.uint64), np.zeros(0, np.int64))
                r = pairs[:, 0].astype(np.int64) + row
                # Sums of a chunk: one row per head and label.
                table = pd.DataFrame({"head": pairs[:, 1].view(np.int64), "quality": quality[r], "toxic": toxic[r], "n": count, "docs": 1}).groupby(["head", "quality", "toxic"], as_index=False).sum()
                yield pa.RecordBatch.from_pandas(table.astype(np.int64), preserve_index=False)

    training = chosen.where("not held")
    sums = training.mapInArrow(counted, "head long, quality long, toxic long, n long, docs long").groupBy("head")
    case = lambda c, v, x: F.sum(F.when(F.col(c) == v, F.col(x)).otherwise(0))
    sums = written(sums.agg(*(case(c, v, x).alias(f"{c}{v}_{x}") for c in ("quality", "toxic") for v in (0, 1) for x in ("n", "docs")), F.sum("docs").alias("docs"), F.sum("n").alias("n")), "quality-heads")
    words = sums.agg(*(F.sum(f"{c}{v}_n") for c in ("quality", "toxic") for v in (0, 1))).first()
    total = {k: float(w or 0) + 1 for k, w in zip(((c, v) for c in ("quality", "toxic") for v in (0, 1)), words, strict=True)}
    rated = sums.where(F.col("docs") >= LEAST_DOCS)
    for c in ("quality", "toxic"):
        docs_of = {r[0]: r[1] for r in training.groupBy(c).count().collect()}
        n_one, n_none = docs_of.get(1, 0) + 1, docs_of.get(0, 0) + 1
        one, none = F.col(f"{c}1_docs"), F.col(f"{c}0_docs")
        pooled = (one + none + 1) / (n_one + n_none + 1)
        spread = F.sqrt(pooled * (1 - pooled) * (1 / n_one + 1 / n_none)) if n_one > 1 and n_none > 1 else F.lit(float("inf"))
        rated = rated.withColumn(f"z_{c}", (one / n_one - none / n_none) / spread)
    rows = rated.where(F.greatest(F.abs("z_quality"), F.abs("z_toxic")) >= LEAST_Z).orderBy(F.greatest(F.abs("z_quality"), F.abs("z_toxic")).desc(), "head").limit(heads).collect()
    heads = np.array([r["head"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(heads)
    rate = lambda c, v: np.array([(r[f"{c}{v}_n"] + 0.5) / total[c, v] for r in rows])[order] if rows else np.zeros(0)
    used = lambda c: np.array([abs(r[f"z_{c}"]) >= LEAST_Z for r in rows])[order] if rows else np.zeros(0)
    gain = np.array([np.log(rate(c, 1) / rate(c, 0)) * used(c) for c in ("quality", "toxic")])
    model = Model(heads[order], gain)

    def measured(batches):
        for b in batches:
            for row, stop, shape, of, found in features(b["text"]):
                x = model.inputs(shape, model.evidence(stop - row, of, found))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b["quality"][row:stop], b["toxic"][row:stop]], ["x", "quality", "toxic"])

    held = chosen.where("held").mapInArrow(measured, "x array<double>, quality int, toxic int").collect()  # half of the sample
    if held:
        held.sort(key=lambda r: (r["x"], r["quality"], r["toxic"]))
        model.fit(np.array([r["x"] for r in held]), np.array([[r["quality"] > 0, r["toxic"] > 0] for r in held], float))
    return model


def _strength(rates: DataFrame, mean: str) -> float:
    """The prior strength (in documents) of the groups of ``rates`` (n, p), from the spread of their rates.

    With the within-group variance m(1-m)/n, what the rates vary beyond it is the variance of the prior.
    """
    m = F.col(mean)
    r = rates.where("n > 0").agg(F.avg((F.col("p") - m) * (F.col("p") - m) - m * (1 - m) / F.col("n")).alias("between"), F.avg(m * (1 - m)).alias("within")).first()
    if r["between"] is None or not r["within"]:
        return 1.0
    return float(np.clip(r["within"] / max(r["between"], 1e-9) - 1, 1.0, 1e6))


def classify(docs: DataFrame, model: Model, site: Column | None = None, threshold: float = 0.5, shift: float = SHIFT) -> DataFrame:
    """doc_id, digest, quality, toxic, host_ and path_quality, host_ and path_toxic, kept for each row of ``docs``.

    ``quality`` and ``toxic`` are posterior probabilities; a document is kept if the first is at least
    ``threshold`` and the second below it (at a tie with it, quality is enough and toxicity too much). ``site`` names host and path, "host/path", by default the
    source and the language. A site's rate adds at most ``shift`` to a document's log odds, up or down, so that no site
    is kept or rejected whole against clear evidence.

    * A null text is empty; a null source or language is a site like any other.
    * Without labels of both classes for a target there is nothing to reject by: quality 1, toxic 0.
    * Repeated rows get equal results. An empty table gives no rows. ``docs`` has doc_id, text and what
      ``site`` needs; other columns are not read.
    """
    small_batches(docs.sparkSession)
    site = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))) if site is None else site
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), site.alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("digest", F.xxhash64("text"))

    def scored(batches):
        for b in batches:
            for row, stop, shape, of, heads in features(b["text"]):
                odds = model.predict(shape, of, heads, (12.0, -12.0))
                yield pa.RecordBatch.from_arrays([*(b[c][row:stop] for c in ("doc_id", "path", "digest")), pa.array(odds[:, 0]), pa.array(odds[:, 1])], ["doc_id", "path", "digest", "q", "t"])

    rows = written(base.mapInArrow(scored, "doc_id long, path string, digest long, q double, t double"), "quality-scores")
    rows = rows.withColumn("host", F.substring_index("path", "/", 1))
    one = lambda c: F.sum(1 / (1 + F.exp(-F.col(c))))
    # Sums by path first (partial, so a host with a third of all rows sends a row per task), then by host.
    sums = [one(c).alias(t) for c, t in zip(("q", "t"), TARGETS, strict=True)]
    paths = written(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *sums), "quality-paths")
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("n"), *[F.sum(t).alias(t) for t in TARGETS]), "quality-hosts")
    everything = hosts.agg(F.sum("n").alias("n"), *[F.sum(t).alias(t) for t in TARGETS]).first()
    means = {t: float((everything[t] or 0.0) + 0.5) / float((everything["n"] or 0) + 1.0) for t in TARGETS}
    shrunk = lambda t, k, mean: (F.col(t) + k * mean) / (F.col("n") + k)
    strength = {t: _strength(hosts.select("n", (F.col(t) / F.col("n")).alias("p"), F.lit(means[t]).alias("mean")), "mean") for t in TARGETS}
    hosts = hosts.select(F.col("host").alias("h"), *[shrunk(t, strength[t], means[t]).alias(f"host_{t}") for t in TARGETS])
    n_hosts, n_paths = hosts.count(), paths.count()
    paths = written(paths.join(small(hosts, n_hosts, 64), F.col("host") == F.col("h")), "quality-rates")
    strength = {t: _strength(paths.select("n", (F.col(t) / F.col("n")).alias("p"), f"host_{t}"), f"host_{t}") for t in TARGETS}
    rates = paths.select(F.col("path").alias("r"), *[f"host_{t}" for t in TARGETS], *[shrunk(t, strength[t], F.col(f"host_{t}")).alias(f"path_{t}") for t in TARGETS])
    joined = rows.join(small(rates, n_paths, 128), F.col("path") == F.col("r"))
    edge = lambda x: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), x))
    odds = lambda x: F.log(edge(x) / (1 - edge(x)))
    moved = lambda t: F.greatest(F.lit(-shift), F.least(F.lit(shift), odds(F.col(f"path_{t}")) - odds(F.lit(means[t]))))
    quality, toxic = (1 / (1 + F.exp(-(F.col(c) + moved(t)))) for c, t in zip(("q", "t"), TARGETS, strict=True))
    return joined.select("doc_id", "digest", quality.alias("quality"), toxic.alias("toxic"), *[f"{level}_{t}" for t in TARGETS for level in ("host", "path")], ((quality >= threshold) & (toxic < threshold)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the classifier rejects, columns unchanged."""
    found = written(classify(docs, fit(docs, labels)), "quality-result")
    bad = written(found.where("not kept").select(F.col("doc_id").alias("bad_id"), F.col("digest").alias("bad_digest")).distinct(), "quality-rejected")
    match = docs["doc_id"].cast("long").eqNullSafe(F.col("bad_id")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("bad_digest"))
    return docs.join(small(bad, bad.count(), 32), match, "left_anti")
