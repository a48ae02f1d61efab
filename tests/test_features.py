import json
import re

import pytest
from pyspark.sql import functions as F

from tessel.functions import decision, features, vectors
from tessel.plans import golden
from tessel.sources import payload
from tessel.streaming import score


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def scored(spark, bodies):
    rows = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    return [(r["fallback"], r["vector"]) for r in payload.with_features(rows).orderBy("i").collect()]


def test_golden_requests(spark):
    assert golden.differences(spark) == []


def test_with_history_and_online(spark):
    body = json.loads(json.dumps(golden.GOLDEN["legit"][0]))
    body["terminal"]["is_online"] = True
    body["last_transaction"] = {"timestamp": "2026-03-11T12:45:53-03:00", "km_from_current": 250.0}
    late = json.loads(json.dumps(body))
    late["last_transaction"]["timestamp"] = "2026-03-11T19:45:53Z"
    (ok, v), (ok2, w) = scored(spark, [json.dumps(body), json.dumps(late)])
    assert not ok and v[5] == pytest.approx(180 / 1440) and v[6] == 0.25 and v[9] == 1
    assert not ok2 and w[5] == 0  # a history after the request


def test_damaged_bodies_fall_back(spark):
    bad = ["{bad", "[1]", None, '{"transaction":{"installments":2.5}}', '{"transaction":{"requested_at":"x"}}', '{"last_transaction":{"timestamp":"2026-13-01T00:00:00Z"}}']
    assert all(fallback and v is None for fallback, v in scored(spark, bad))


def test_nulls_and_other_types_of_scalars_fall_back(spark):
    parts = {
        "transaction": ("amount", "installments", "requested_at"),
        "customer": ("avg_amount", "tx_count_24h"),
        "merchant": ("avg_amount",),
        "terminal": ("is_online", "card_present", "km_from_home"),
        "last_transaction": ("timestamp", "km_from_current"),
    }
    bad = [json.dumps({part: {field: value}}) for part, fields in parts.items() for field in fields for value in (None, [1], {"a": 1}, "NaN" if field != "requested_at" else 5)]
    bad += ['{"merchant":{"mcc":5411}}', '{"merchant":{"id":7}}', '{"merchant":{"id":true}}', '{"merchant":{"mcc":["5411"]}}', '{"terminal":{"is_online":1}}', '{"customer":{"tx_count_24h":2.0}}']
    assert [b for b, (fallback, _) in zip(bad, scored(spark, bad), strict=True) if not fallback] == []
    good = ['{"merchant":{"id":null,"mcc":null}}', '{"transaction":null,"customer":null,"merchant":null,"terminal":null,"last_transaction":null}', '{"transaction":{"amount":7}}', '{"transaction":{"amount":7.25e1}}', '{"customer":{"known_merchants":null}}']
    assert [fallback for fallback, _ in scored(spark, good)] == [False] * 5


def test_the_code_that_reads_requests_is_short_enough_to_be_compiled(spark, tmp_path):
    spark.createDataFrame([(0, "{}")], "request_id long, body string").write.parquet(f"{tmp_path}/requests")
    plan = score.read_requests(spark.read.parquet(f"{tmp_path}/requests"))._jdf.queryExecution().executedPlan()
    sizes = re.findall(r"maxMethodCodeSize:(\d+)", spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan))
    assert sizes and max(map(int, sizes)) < 8000  # beyond, the JVM only interprets


def test_defaults(spark):
    (a, v), (b, w), (c, x) = scored(spark, ["{}", '{"merchant":{"mcc":"9999"},"customer":{"avg_amount":-1},"transaction":{"amount":5}}', '{"customer":{"known_merchants":["M","M"]},"merchant":{"id":"M"},"later":{"a":[1]}}'])
    assert not (a or b or c)
    assert v == pytest.approx([0, 0, 0, 0, 0, -1, -1, 0, 0, 0, 0, 1, 0.5, 0])
    assert w[2] == 0 and w[12] == 0.5 and x[11] == 0


def test_clamp_keeps_null_and_nan(spark):
    got = [one(spark, features.clamp(F.lit(x).cast("double"))) for x in (-3.0, 0.25, 7.0, None, float("nan"))]
    assert got[:4] == [0, 0.25, 1, None] and got[4] != got[4]


@pytest.mark.parametrize(
    "text,hour,day",
    [
        ("2027-01-01T00:00:00Z", 0, 4),
        ("2026-03-11T23:30:00-03:00", 2, 3),
        ("2026-03-11T23:30:00+0530", 18, 2),
        ("2026-03-15T01:00:00.1234567", 1, 6),
        ("2026-03-15T01:00:00.5-0300", 4, 6),
        ("2026-03-15T01:00:00.5-03", None, None),
        ("2026-03-11T23:30:00\n", 23, 2),
        ("2026-03-11T23:30:00+9900", None, None),
        ("2026-02-30T00:00:00Z", None, None),
        ("2026-03-11", None, None),
        ("", None, None),
    ],
)
def test_iso8601(spark, text, hour, day):
    at = features.parse_iso8601(F.lit(text))
    assert (one(spark, F.hour(at)), one(spark, F.weekday(at))) == (hour, day)


def test_quantisers(spark):
    i16 = lambda x: one(spark, vectors.quantize_i16(F.lit(x).cast("float")))
    assert [i16(x) for x in (1.0, -1.0, 0.00005, -0.00005, 9.0, -9.0)] == [10000, -10000, 1, -1, 32767, -32768]
    assert one(spark, vectors.quantize_i16(F.lit(None).cast("float"))) is None
    i8 = lambda x, s: one(spark, vectors.quantize_i8(F.lit(x).cast("float"), s))
    assert [i8(1.0, False), i8(-1.0, False), i8(-1.0, True), i8(1.0, True), i8(0.0, True)] == [255, 0, 0, 255, 128]


def test_decisions(spark):
    assert [one(spark, decision.approved(F.lit(n))) for n in range(6)] == [True, True, True, False, False, False]
    assert one(spark, decision.response_body(F.lit(3))) == '{"approved":false,"fraud_score":0.6}'
    assert one(spark, decision.response_body(F.lit(None).cast("int"))) == '{"approved":true,"fraud_score":0.0}'
    assert one(spark, decision.count_from_score(F.lit(0.6))) == 3
    assert [one(spark, decision.label_bit(F.lit(0b101), F.lit(i).cast("long"))) for i in (8, 9, 10)] == [1, 0, 1]
