import math
import random

import numpy as np
import pytest

from tessel.llm import quality as Q
from tests.llm.helpers import AWKWARD, documents, with_clashes

LABELS = "doc_id long, quality int, toxic int, extra string"


@pytest.fixture(scope="module")
def big(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_held_out_accuracy(spark, big):
    docs, labels = big
    fitted = labels.where("doc_id % 4 != 0")
    rows = {r.doc_id: r for r in Q.classify(docs, Q.fit(docs, fitted)).collect()}
    held = labels.where("doc_id % 4 = 0").collect()
    right_q = sum((rows[r.doc_id].quality >= 0.5) == (r.quality == 1) for r in held)
    right_t = sum((rows[r.doc_id].toxic >= 0.5) == (r.toxic == 1) for r in held)
    clean = [r for r in held if r.quality == 1 and r.toxic == 0]
    kept = sum(rows[r.doc_id].kept for r in clean)
    bad = [r for r in held if r.quality == 0 or r.toxic == 1]
    caught = sum(not rows[r.doc_id].kept for r in bad)
    print("quality", right_q / len(held), "toxic", right_t / len(held), "clean kept", kept / len(clean), "bad rejected", caught / len(bad))
    assert right_q >= 0.97 * len(held) and right_t >= 0.97 * len(held)
    assert kept >= 0.99 * len(clean) and caught >= 0.93 * len(bad)


def test_sparse_sites_shrink(spark, big):
    docs, labels = big
    model = Q.fit(docs, labels)
    from pyspark.sql import functions as F

    bad = labels.where("quality = 0").select("doc_id").limit(200)
    few = F.when(F.col("doc_id").isin([r.doc_id for r in bad.limit(2).collect()]), "few/x").when(F.col("doc_id").isin([r.doc_id for r in bad.collect()]), "many/x").otherwise("rest/x")
    rows = Q.classify(docs, model, site=few).withColumn("site", F.lit(1)).collect()
    rates = sorted({(round(r.host_quality, 6), round(r.path_quality, 6)) for r in rows})
    assert len(rates) == 3
    assert rates[0][0] < rates[1][0] < rates[2][0]  # many, few (shrunk), rest


def test_awkward_rows_without_labels(spark):
    labels = spark.createDataFrame([], LABELS)
    docs = with_clashes(documents(spark).drop("quality")).drop("quality")
    rows = Q.classify(docs, Q.fit(docs, labels)).collect()
    assert len(rows) == len(AWKWARD) and all(r.kept and r.quality > 0.99 for r in rows)
    assert Q.keep_good(docs, labels).count() == len(AWKWARD)
    nothing = documents(spark, [])
    assert Q.classify(nothing, Q.fit(nothing, labels)).count() == 0


def test_awkward_rows_with_labels(spark, big):
    docs, labels = big
    model = Q.fit(docs, labels.unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 0), (3, 1, None)], "doc_id long, quality int, toxic int")))
    rows = Q.classify(with_clashes(documents(spark)), model).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.quality <= 1 and 0 <= r.toxic <= 1 for r in rows)
    twice = [r for r in rows if r.doc_id == 2]
    assert twice[0] == twice[1]


class ByWords:
    """A model whose evidence is the number of words of a text: log odds are exact."""

    def predict(self, shape, of, heads, unknown):
        n = np.rint(np.expm1(shape[:, 0]))
        return np.stack([n - 10, 4 - n], axis=1)


def plain_posteriors(rows, shift):
    """The hierarchy by plain loops: (id -> quality, toxic) of rows (id, site, words)."""
    out = {}
    for t, odds in (("quality", lambda n: n - 10), ("toxic", lambda n: 4 - n)):
        p = {i: 1 / (1 + math.exp(-odds(n))) for i, _, n in rows}
        mean = (sum(p.values()) + 0.5) / (len(p) + 1)

        def rate(groups, prior, p=p):
            """Shrunk rates of (group -> ids), with the strength from the spread of the rates."""
            raw = {g: sum(p[i] for i in ids) / len(ids) for g, ids in groups.items()}
            within = sum(prior[g] * (1 - prior[g]) for g in groups) / len(groups)
            between = sum((raw[g] - prior[g]) ** 2 - prior[g] * (1 - prior[g]) / len(groups[g]) for g in groups) / len(groups)
            k = min(max(within / max(between, 1e-9) - 1, 1.0), 1e6)
            return {g: (sum(p[i] for i in ids) + k * prior[g]) / (len(ids) + k) for g, ids in groups.items()}

        paths, hosts = {}, {}
        for i, site, _ in rows:
            paths.setdefault(site, []).append(i)
            hosts.setdefault(site.split("/")[0], []).append(i)
        host = rate(hosts, dict.fromkeys(hosts, mean))
        path = rate(paths, {s: host[s.split("/")[0]] for s in paths})
        log_odds = lambda x: math.log(x / (1 - x))
        for i, site, n in rows:
            moved = max(-shift, min(shift, log_odds(path[site]) - log_odds(mean)))
            out.setdefault(i, []).append(1 / (1 + math.exp(-(odds(n) + moved))))
    return out


@pytest.mark.parametrize("shift", [0.0, 0.4, 2.0])
def test_posteriors_against_plain_loops(spark, shift):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a/x", "a/y", "b/x", "c/z", "c/x"]), rng.choice([2, 4, 9, 10, 11, 14])) for i in range(300)] + [(300, "d/x", 3), (301, "d/x", 10)]
    docs = documents(spark, [(i, " ".join(["w"] * n), site.split("/")[1], site.split("/")[0], 1, "x") for i, site, n in rows])
    want = plain_posteriors(rows, shift)
    for r in Q.classify(docs, ByWords(), shift=shift).collect():
        assert (r.quality, r.toxic) == pytest.approx(want[r.doc_id], abs=1e-9)
        if shift == 0:  # ten words are a tie in quality, four one in toxicity
            n = rows[r.doc_id][2]
            assert r.kept == (n >= 10)
    tied = documents(spark, [(1, "w " * 10, "x", "a", 1, "x"), (2, "w " * 4, "x", "a", 1, "x")])
    assert {r.doc_id: (r.quality, r.toxic >= 0.5, r.kept) for r in Q.classify(tied, ByWords(), shift=0.0).collect()}[1] == (0.5, False, True)


def test_repeated_labels_take_the_least(spark, big):
    docs, labels = big
    labels = labels.select("doc_id", "quality", "toxic").where("doc_id < 3000")
    other = labels.where("doc_id % 3 = 0").selectExpr("doc_id", "1 - quality as quality", "1 - toxic as toxic")
    least = {}
    for r in labels.unionByName(other).collect():
        least[r.doc_id] = min(least.get(r.doc_id, (1, 1)), (r.quality, r.toxic))
    want = Q.fit(docs, spark.createDataFrame([(i, q, t) for i, (q, t) in least.items()], "doc_id long, quality int, toxic int"))
    got = Q.fit(docs, other.unionByName(labels).repartition(5))
    assert (got.heads == want.heads).all()
    for a, b in zip(got.weights, want.weights, strict=True):
        assert (a is None) == (b is None) and (a is None or np.allclose(a, b, rtol=1e-9, atol=1e-9))
