import random

import numpy as np

from tessel.llm import jaccard_join as J
from tessel.llm.components import components
from tests.llm.helpers import AWKWARD, documents, with_clashes


def shingles(text, k=5):
    w = (text or "").replace("\v", " ").encode().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(docs, t=0.8):
    sets = [shingles(x) for _, x in docs]
    n = len(docs)
    links, parent = [0] * n, list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a and b and len(a & b) >= t * len(a | b)):
                links[i] += bool(a)
                links[j] += bool(a)
                parent[find(i)] = find(j)
    least = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), 1 << 60), docs[i][0])
    return sorted((docs[i][0], least[find(i)], links[i], sum(s == sets[i] for s in sets) - 1) for i in range(n))


def got(df):
    return sorted((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in df.collect())


def corpus(seed, families, size, words=120):
    rng = random.Random(seed)
    out = []
    for f in range(families):
        base = [f"{rng.randrange(5000)}w" for _ in range(rng.randint(8, words))]
        for _ in range(size):
            x = list(base)
            for _ in range(rng.randint(0, max(1, len(x) // 25))):
                x[rng.randrange(len(x))] = f"e{rng.randrange(10**6)}"
            out.append(" ".join(x))
    out += ["a b c", "a b c", "a  b\tc", "a b c d", "", None, " ", "a b c d e", "a b c d e f", "one"]
    rng.shuffle(out)
    return list(enumerate(out))


def test_against_brute_force(spark):
    docs = corpus(1, 40, 8)
    df = with_clashes(documents(spark, [(i, t, "en", "s", 1, "x") for i, t in docs]))
    assert got(J.join(df)) == brute(docs)


def test_large_group_is_dealt_into_blocks(spark):
    docs = corpus(2, 2, 150, 60)
    df = documents(spark, [(i, t, "en", "s", 1, "x") for i, t in docs])
    assert got(J.join(df, block=16)) == brute(docs)


def test_real_texts(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    sets = [(i, shingles(t)) for i, t in docs]
    by = {}
    for i, s in sets:
        for x in s:
            by.setdefault(x, []).append(i)
    rows = {r.doc_id: r for r in J.join(df).collect()}
    named, links = dict(sets), dict.fromkeys(rows, 0)
    pairs = {(a, b) for v in by.values() for a in v for b in v if a < b}
    for a, b in pairs:
        if len(named[a] & named[b]) >= 0.8 * len(named[a] | named[b]):
            links[a] += 1
            links[b] += 1
            assert rows[a].class_id == rows[b].class_id
    assert {i: r.n_links for i, r in rows.items()} == links


def test_awkward_rows(spark):
    rows = J.join(with_clashes(documents(spark))).collect()
    assert len(rows) == len(AWKWARD)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert [by[i][0].class_id for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)] == [1, 1, 1, 4, 4, 4, 7, 8, 8, 10]
    assert by[1][0].n_links == 4 and by[4][0].n_links == 0 and by[4][0].n_copies == 2
    assert sorted((r.class_id for r in by[None]), key=str) == [1, None]
    assert J.join(documents(spark, [])).count() == 0
    kept = sorted((r.doc_id for r in J.keep_one(with_clashes(documents(spark))).collect()), key=str)
    assert kept == sorted([1, 4, 7, 8, 10, None, None], key=str)


def test_equal_ids_of_different_texts(spark):
    a, b = "one two three four five six seven", "un deux trois quatre cinq six sept"
    rows = [(1, a, None, None, 0, "x"), (1, b, None, None, 0, "x"), (2, b + " huit", None, None, 0, "x"), (3, a, None, None, 0, "x")]
    assert sorted((r.doc_id, r.n_copies) for r in J.join(documents(spark, rows)).collect()) == [(1, 0), (1, 1), (2, 0), (3, 1)]


def missed(depths, t=0.8):
    return float(np.prod([1 - t**d for d in depths]))


def test_depths_meet_the_recall():
    floor = J.shortest_prefix(0.8, 0.99999)
    assert missed([floor] * J.TREES) <= 1e-5 < missed([floor + 1] * J.TREES)
    rng = np.random.default_rng(3)
    ends = set()
    for _ in range(200):
        # Members of the nodes on a path: fewer the longer the prefix, many in some tries.
        sizes = np.sort(rng.integers(1, rng.integers(2, 10_000), (J.TREES, J.DEPTH - floor + 1)), axis=1)[:, ::-1]
        depth = J.opened_depths(sizes, 0.8, 0.99999)
        assert depth.min() >= floor and depth.max() <= J.DEPTH and missed(depth) <= 1e-5
        ends.add(tuple(depth.tolist()))
        # Less shortening isn't enough: the last step was needed.
        cost = lambda d, sizes=sizes: sum(sizes[i, x - floor] for i, x in enumerate(d))
        assert cost(depth) <= cost([floor] * J.TREES)
    assert len(ends) > 100
    crowded = np.ones((J.TREES, J.DEPTH - floor + 1), int)
    crowded[:4] = [[1000 - j for j in range(J.DEPTH - floor + 1)]] * 4
    depth = J.opened_depths(crowded, 0.8, 0.99999)
    assert depth[:4].min() == J.DEPTH and depth[4:].min() == floor  # only where it costs nothing


def boilerplate(seed, n=400, shared=60, own=25):
    """Texts with a long passage in common: crowded in many tries, similar to few."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(shared)]
    out = [" ".join(passage + [f"{rng.randrange(10**6)}w" for _ in range(own)]) for _ in range(n)]
    for i in range(0, n, 5):  # near copies of some
        words = out[i].split()
        words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    return list(enumerate(out))


def test_sets_end_at_different_depths(spark, monkeypatch):
    docs = boilerplate(4) + [(10_000 + i, t) for i, t in corpus(5, 10, 6)]
    df = documents(spark, [(i, t, "en", "s", 1, "x") for i, t in docs])
    seen = {}
    monkeypatch.setattr(J, "written", lambda frame, name, own=J.written: seen.setdefault(name, own(frame, name)))
    assert got(J.join(df, crowd=16)) == brute(docs)
    used = {r.depth: r["count"] for r in seen["jaccard-paths"].where("wanted").groupBy("depth").count().collect()}
    assert len(used) > 1 and min(used) == 0 and max(used) > 0  # some crowded nodes are shortened, others aren't
    every = J.join(df, crowd=10**6)
    assert got(every) == brute(docs)


def test_dense_and_sparse_verification_agree():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 50)).astype(np.uint64) for _ in range(40)]
    pairs = np.array([(i, j) for i in range(40) for j in range(i)])
    want = [(i, j) for i, j in pairs.tolist() if len(set(sets[i].tolist()) & set(sets[j].tolist())) >= 0.5 * len(set(sets[i].tolist()) | set(sets[j].tolist()))]
    assert J.linked(sets, sets, pairs, 0.5).tolist() == [list(x) for x in want]
    few = pairs[:50]
    assert J.linked(sets, sets, few, 0.5).tolist() == [list(x) for x in want if list(x) in few.tolist()]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (5, 5), (400, 400)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    from tessel.llm import components as C

    n, rounds = 10_000, []
    chain = spark.range(n).selectExpr("id as a", "id + 1 as b")
    monkeypatch.setattr(C, "written", lambda frame, name, own=C.written: (rounds.append(name), own(frame, name))[1])
    found = C.components(chain)
    assert found.where("label != 0").count() == 0 and found.count() == n + 1
    assert rounds.count("components-first") <= 20
