import numpy as np

from tessel.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, score string, perm string, file long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y", 1) for i, v in rows], SCHEMA)


def brute(rows, k=5):
    rows = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in rows:
        if q % 50 == 0:
            s = [(-float(rows[q] @ x / np.sqrt(rows[q] @ rows[q]) / np.sqrt(x @ x)), i) for i, x in rows.items() if i != q]
            out[q] = [(i, -d) for d, i in sorted(s, key=lambda t: (round(t[0], 12), t[1]))[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_on_real_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    want, got = brute(rows), found(ann.nearest(df))
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    true = {(q, i): s for q in want for i, s in want[q]}
    for q in got:
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
        assert all(abs(s - true[q, i]) < 1e-12 for i, s in got[q] if (q, i) in true)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (None, [1.0, 2.0]), (50, [0.0, 3.0]), (9, [2.0, 0.0])]
    assert {q: [i for i, _ in v] for q, v in found(ann.nearest(frame(spark, rows + rows[:1]))).items()} == {0: [1, 9, 2, 50], 50: [2, 0, 1, 9]}
    assert found(ann.nearest(frame(spark, []))) == {}
    assert found(ann.nearest(frame(spark, [(50, [1.0, 2.0])]))) == {}


def test_one_vector_in_most_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 else rng.normal(size=4).tolist()) for i in range(1500)]
    got = found(ann.nearest(frame(spark, rows), shard=64))
    for q, near in got.items():
        if q % 3:
            assert [i for i, _ in near] == [i for i in range(1, 12) if i % 3 and i != q][:5]
    want = brute(rows)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)


def test_more_files_are_opened_with_more_pivots(spark):
    assert [ann.files_opened(n) for n in (3, 256, 1024, 16_384)] == [3, 40, 80, 320]
    rng = np.random.default_rng(11)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 64)).astype(np.float32).astype(float))]
    want, got = brute(rows), found(ann.nearest(frame(spark, rows), pivots=1024))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)


def test_footrule_against_its_definition():
    rng = np.random.default_rng(2)
    n, length = 40, 12
    perms = np.array([rng.permutation(n)[:length] for _ in range(50)])
    query = rng.permutation(n)[:length]
    plain = []
    for p in perms:
        at, other = ({x: i for i, x in enumerate(v)} for v in (p.tolist(), query.tolist()))
        plain.append(sum(abs(at.get(x, length) - other.get(x, length)) for x in range(n)))
    got = ann.footrule(perms, query, n)
    assert len(set((np.array(plain) - got).tolist())) == 1


def test_footrule_ranks_what_is_scored(spark):
    """With files far larger than what is reranked, the footrule finds the neighbours."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(200, 32))
    data = centres[rng.integers(0, 200, 8000)] + 0.4 * rng.normal(size=(8000, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(data.astype(np.float32).astype(float))]
    df = frame(spark, rows)
    want = brute(rows)
    share = lambda got: sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / (5 * len(want))
    assert share(found(ann.nearest(df, pivots=64, length=32))) >= 0.95
    few = share(found(ann.nearest(df, pivots=64, length=32, probes=4, rerank=0.05, least=8)))
    assert few >= 0.9  # a file holds about 1000 vectors, of which 50 are scored


def test_repeated_ids_take_the_least_vector(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=6).round(3).tolist()) for i in range(200)] + [(i, rng.normal(size=6).round(3).tolist()) for i in range(0, 200, 3)]
    rows += [(300, [1.0, 2.0]), (301, [1.0] * 7)]  # lengths other than the commonest take no part
    least = {}
    for i, v in rows[:-2]:
        v = np.array(v, np.float32).astype(float).tolist()
        least[i] = min(least.get(i, v), v)
    want = {q: [i for i, _ in near] for q, near in brute(list(least.items())).items()}
    for n in (1, 5):
        got = found(ann.nearest(frame(spark, rows).repartition(n)))
        assert {q: [i for i, _ in near] for q, near in got.items()} == want
