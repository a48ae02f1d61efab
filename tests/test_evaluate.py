import gzip
import json
import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessel import session
from tessel.config import Settings
from tessel.operators import evaluate
from tessel.plans import golden
from tessel.sources import payload
from tessel.streaming import score


def counts(spark, tp, tn, fp, fn):
    rows = [(False, False)] * tp + [(True, True)] * tn + [(False, True)] * fp + [(True, False)] * fn
    return evaluate.confusion(spark.createDataFrame(rows, "approved boolean, expected boolean"))


def test_confusion_and_scores(spark):
    r = evaluate.with_scores(counts(spark, 40, 55, 3, 2)).first()
    assert (r.n, r.tp, r.tn, r.fp, r.fn, r.e) == (100, 40, 55, 3, 2, 9)
    assert r.fail_rate == 0.05 and r.accuracy == 95.0
    assert r.det_score == pytest.approx(1000 * math.log10(1 / 0.09) - 300 * math.log10(10), abs=1e-5)
    perfect = counts(spark, 5, 5, 0, 0).select(evaluate.det_score().alias("d"), evaluate.det_score_projected().alias("p")).first()
    assert (perfect.d, perfect.p) == (3000, 3000)
    assert counts(spark, 84, 0, 16, 0).select(evaluate.det_score().alias("d")).first().d == -3000
    assert counts(spark, 85, 0, 15, 0).select(evaluate.det_score().alias("d")).first().d > -3000
    e = counts(spark, 9, 0, 1, 0).select(evaluate.det_score_projected().alias("p")).first().p
    assert e == pytest.approx(1000 * math.log10(10) - 300 * math.log10(1 + 0.1 * 54100))


def test_p99_score(spark):
    got = [spark.range(1).select(evaluate.p99_score(F.lit(x)).alias("x")).first().x for x in (0.2, 35.0, 2000.0, 2000.1)]
    assert got == pytest.approx([3000, 1000 * math.log10(1000 / 35), 1000 * math.log10(0.5), -3000])


def test_percentiles(spark, monkeypatch):
    df = spark.range(100).select((F.col("id") * 7 % 100).cast("double").alias("v"))
    assert evaluate.percentiles(df, "v") == (50.0, 99.0)
    monkeypatch.setattr(evaluate, "GATHER", 50)
    big = spark.range(20_000).select((F.xxhash64("id") % 1000).cast("double").alias("v"))
    values = sorted(r.v for r in big.collect())
    assert evaluate.percentiles(big, "v") == (values[10_000], values[19_800])
    assert evaluate.percentiles(df.where("false"), "v") == (None, None)


def test_order_statistics_of_awkward_values(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "GATHER", 3)
    inf, nan = math.inf, math.nan
    for values in (
        [1.0, 2.0] * 500,
        [5.0] * 1000,
        [0.0, 5e-324, 1e-323] * 200,
        [1.7e308, -1.7e308, 0.0] * 50 + [1e-300 * i for i in range(100)],
        [inf, -inf, nan, 3.0, 3.0, 4.0, inf, -inf, 2.5, 2.0, 1.0, 7.0],
        [10.0**i for i in range(-300, 300, 40)],
    ):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        want = sorted(values, key=lambda v: (v != v, v if v == v else 0))
        places = [len(values) // 2, len(values) - 2]
        got = evaluate.order_statistics(df, "v", [*places, len(values), -1])
        assert [str(x) for x in got] == [str(want[i]) for i in places] + ["None", "None"]


def test_references_and_test_sets(spark, tmp_path):
    path = str(tmp_path / "references.json.gz")
    rows = [{"vector": [i / 10] * 14, "label": "fraud" if i % 3 == 0 else "legit", "more": {"a": [1]}} for i in range(10)] + [{"vector": [0.0] * 14}]
    with gzip.open(path, "wt") as f:
        json.dump(rows, f)
    got = payload.read_references(spark, path).orderBy("ref_id").collect()
    assert [r.fraud for r in got] == [int(i % 3 == 0) for i in range(10)] + [0]
    assert got[3].vector == pytest.approx([0.3] * 14)
    with gzip.open(path, "wt") as f:
        f.write("not json")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        payload.read_references(spark, path).collect()
    path = str(tmp_path / "tests.json")
    body = golden.GOLDEN["legit"][0]
    (tmp_path / "tests.json").write_text(json.dumps({"entries": [{"request": body, "expected_approved": i % 2 == 0} for i in range(5)]}))
    read = payload.read_test_set(spark, path, limit=3)
    assert [(r.entry, r.expected_approved) for r in read.orderBy("entry").collect()] == [(0, True), (1, False), (2, True)]
    assert payload.with_features(read).first().vector == pytest.approx(golden.GOLDEN["legit"][1], abs=1e-3)


def test_scoring_a_batch(spark):
    zero = [0] * 14
    vectors = spark.createDataFrame([(i, 0, zero, int(i < 3)) for i in range(6)], "ref_id long, bucket_id long, q16 array<smallint>, fraud tinyint")
    centroids = spark.createDataFrame([(0, zero)], "centroid_id long, c array<smallint>")
    requests = spark.createDataFrame([(0, json.dumps(golden.GOLDEN["legit"][0])), (1, "{bad"), (2, "{}")], "request_id long, body string")
    got = {r.request_id: (r.fallback, r.scanned, r.fc, r.approved, r.response) for r in score.score_requests(requests, vectors, centroids).collect()}
    denied = (False, 1, 3, False, '{"approved":false,"fraud_score":0.6}')
    assert got == {0: denied, 1: (True, None, None, True, '{"approved":true,"fraud_score":0.0}'), 2: denied}


def test_equal_requests_are_searched_once_and_all_answered(spark, monkeypatch):
    zero, asked = [0] * 14, []
    vectors = spark.createDataFrame([(i, 0, zero, int(i < 3)) for i in range(6)], "ref_id long, bucket_id long, q16 array<smallint>, fraud tinyint")
    centroids = spark.createDataFrame([(0, zero)], "centroid_id long, c array<smallint>")
    bodies = ["{}", '{"transaction":{"amount":5}}', "{bad", None]
    requests = spark.createDataFrame([(i, bodies[i % 4]) for i in range(400)], "request_id long, body string")
    adaptive = score.ivf.adaptive
    monkeypatch.setattr(score.ivf, "adaptive", lambda queries, *more: asked.append(queries.count()) or adaptive(queries, *more))
    for strategy in ("relational", "arrow"):
        got = {r.request_id: (r.fallback, r.scanned, r.fc) for r in score.score_requests(requests, vectors, centroids, 1, 2, strategy).collect()}
        assert got == {i: (True, None, None) if i % 4 > 1 else (False, 1, 3) for i in range(400)}
    assert asked == [2, 2]


def test_a_stream_writes_what_it_reads_twice_and_keeps_nothing(spark, tmp_path, monkeypatch):
    zero, seen, made = [0] * 14, [], []
    vectors = spark.createDataFrame([(i, 0, zero, int(i < 3)) for i in range(6)], "ref_id long, bucket_id long, q16 array<smallint>, fraud tinyint")
    centroids = spark.createDataFrame([(0, zero)], "centroid_id long, c array<smallint>")
    requests = spark.createDataFrame([(0, json.dumps(golden.GOLDEN["legit"][0])), (1, "{bad"), (2, "{}")], "request_id long, body string")
    requests.write.parquet(str(tmp_path / "in"))
    answer, folder = score.answer, session.scratch_folder
    monkeypatch.setattr(session, "scratch_folder", lambda s: made.append(folder(s)) or made[-1])
    monkeypatch.setattr(score, "answer", lambda read, *more: seen.append((read.storageLevel.useMemory, [(Path(f) / "table").exists() for f in made])) or answer(read, *more))
    stream = spark.readStream.schema(requests.schema).parquet(str(tmp_path / "in"))
    run = score.score_stream(stream, vectors, centroids, str(tmp_path / "out"), str(tmp_path / "state"))
    run.awaitTermination()
    assert seen == [(False, [True])] and len(made) == 2 and not any(Path(f).exists() for f in made)
    got = sorted(spark.read.parquet(str(tmp_path / "out")).drop("batch").collect())
    assert got == sorted(score.score_requests(requests, vectors, centroids).collect())


def test_round_robin(spark):
    got = score.round_robin(spark.range(10), "id").orderBy("id").collect()
    assert [r.instance for r in got] == [0, 1] * 5


def test_settings():
    assert Settings.from_environment({"NLOW": "4", "NHIGH": "many", "INDEX_PATH": "x"}) == Settings("x", 4, 128)
