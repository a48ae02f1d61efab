import re
from collections import defaultdict

from tessel.llm import mixing
from tests.llm.helpers import AWKWARD, documents, with_clashes


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        room = total - sum(fixed.values())
        share = {s: room * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def check(rows, docs, slack=None):
    sizes = defaultdict(int)
    for d in docs:
        sizes[d[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or ""))
    want, taken = brute_targets(dict(sizes)), defaultdict(int)
    assert len(rows) == len(docs)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s in sizes:
        smallest = min([len((d[1] or "").split()) for d in docs if d[3] == s and (d[1] or "").split()], default=0)
        assert abs(taken[s] - want[s]) <= (slack or max(smallest + 1, 0.01 * want[s])), s


def test_awkward_rows(spark):
    docs = with_clashes(documents(spark).drop("extra"))
    rows = mixing.mix(docs).collect()
    check(rows, AWKWARD, slack=100_000)
    assert [r.taken for r in rows if r.size == 0] == [0] * 3


def test_targets_are_met_and_reruns_agree(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = mixing.mix(docs).orderBy("doc_id").collect()
    check(rows, [(r.doc_id, r.text, None, r.source) for r in docs.collect()])
    assert rows == mixing.mix(docs.repartition(5)).orderBy("doc_id").collect()


def test_hot_source_and_ties(spark):
    docs = [(i, "w " * (i % 5 + 1), "en", "big" if i % 3 else f"s{i % 4}", 1, "x") for i in range(3000)]
    check(mixing.mix(documents(spark, docs)).collect(), docs)


def test_rates_are_tilted_by_size(spark):
    docs = [(i, "w " * (i % 50 + 1), "en", "a" if i % 2 else "b", 1, "x") for i in range(2000)]
    rows = mixing.mix(documents(spark, docs)).collect()
    import math

    for s in "ab":
        slopes = {round(math.log(r.rate) / r.size, 6) for r in rows if r.source == s and 1e-9 < r.rate < 2.999}
        assert len(slopes) == 1


def test_empty_and_wordless(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    rows = mixing.mix(documents(spark, [(1, "", "en", "a", 0, "x"), (2, None, "en", None, 0, "x")])).collect()
    assert [(r.target, r.taken) for r in rows] == [(0.0, 0), (0.0, 0)]
