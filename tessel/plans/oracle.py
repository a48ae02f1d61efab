"""DuckDB SQL for the engine's queries, over views named as the tables."""

from __future__ import annotations

from tessel.functions import constants as K

DIMS, BUCKETS = 64, 20

CODE = "CAST(greatest(-32768, least(32767, round(CAST({x} AS FLOAT) * CAST(10000 AS FLOAT)))) AS INTEGER)"
CLAMP = "CASE WHEN CAST({x} AS FLOAT) < 0 THEN CAST(0 AS FLOAT) WHEN CAST({x} AS FLOAT) > 1 THEN CAST(1 AS FLOAT) ELSE CAST({x} AS FLOAT) END"


def code(x: str) -> str:
    return CODE.format(x=x)


def clamp(x: str) -> str:
    return CLAMP.format(x=f"({x})")


_MCC_LIST = "['5411','5812','5912','5944','7801','7802','7995','4511','5311','5999','0000',NULL]"
_RISK = "CASE mcc " + " ".join(f"WHEN '{m}' THEN {r}" for m, r in K.MCC_RISK.items()) + f" ELSE {K.DEFAULT_MCC_RISK} END"

TX = f"""
keyed AS (
  SELECT event_id, user_id, event_type, ts, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CAST(round(value * 100) AS BIGINT) AS cents, epoch_us(ts) AS us FROM events
), history AS (
  SELECT *, count(*) OVER past AS n_before, sum(cents) OVER past AS cents_before,
         CAST(count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) - 1 AS INTEGER) AS tx_count_24h,
         k IS NOT NULL AND row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) > 1 AS seen,
         lag(us) OVER byuser AS last_us, lag(k) OVER byuser AS last_k
  FROM keyed
  WINDOW past AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         byuser AS (PARTITION BY user_id ORDER BY ts, event_id)
), merchants AS (
  SELECT k AS mk, round(CAST(sum(cents) AS BIGINT) * 20 / 100.0::DOUBLE / count(*), 2) AS merchant_avg FROM keyed WHERE k IS NOT NULL GROUP BY k
), tx AS (
  SELECT event_id, user_id, k, cents * 20 / 100.0::DOUBLE AS amount, coalesce(k % 12 + 1, 0) AS installments, ts, us,
         CASE WHEN n_before > 0 THEN CAST(cents_before AS BIGINT) * 20 / 100.0::DOUBLE / n_before ELSE 0.0::DOUBLE END AS customer_avg,
         tx_count_24h, CASE WHEN seen THEN 0 ELSE 1 END AS unknown,
         {_MCC_LIST}[k % 12 + 1] AS mcc, coalesce(merchant_avg, 0.0::DOUBLE) AS merchant_avg, event_type IN ('click', 'view') AS is_online,
         event_type = 'purchase' AS card_present, coalesce(k * 15.0::DOUBLE, 0) AS km_from_home, last_us,
         coalesce(abs(k - last_k) * 12.0::DOUBLE, 0) AS km_from_current, event_type = 'error' AS fraud
  FROM history LEFT JOIN merchants ON k = mk
)"""

_F = [
    clamp("amount / 10000.0::DOUBLE"),
    clamp("installments / 12.0::DOUBLE"),
    f"CASE WHEN customer_avg * 10 > 0 THEN {clamp('amount / nullif(customer_avg * 10, 0)')} ELSE CAST(0 AS FLOAT) END",
    "hour(ts) / 23.0::DOUBLE",
    "(isodow(ts) - 1) / 6.0::DOUBLE",
    f"CASE WHEN last_us IS NULL THEN CAST(-1 AS FLOAT) ELSE {clamp('(us - last_us) / 6e7::DOUBLE / 1440.0::DOUBLE')} END",
    f"CASE WHEN last_us IS NULL THEN CAST(-1 AS FLOAT) ELSE {clamp('km_from_current / 1000.0::DOUBLE')} END",
    clamp("km_from_home / 1000.0::DOUBLE"),
    clamp("tx_count_24h / 20.0::DOUBLE"),
    "CAST(is_online AS INTEGER)",
    "CAST(card_present AS INTEGER)",
    "unknown",
    _RISK,
    clamp("merchant_avg / 10000.0::DOUBLE"),
]
_VECTOR = ", ".join(f"{code(x)} AS f{i:02d}" for i, x in enumerate(_F))

REFS = """
refs AS (
  SELECT vec_id AS ref_id, embedding AS vector, CAST(label < 4 AS INTEGER) AS fraud,
         list_transform(embedding, lambda x: CAST(greatest(-32768, least(32767, round(x * CAST(10000 AS FLOAT)))) AS BIGINT)) AS q16,
         list_transform(list_zip(embedding, range(len(embedding))), lambda z: CAST(greatest(0, least(255, CASE WHEN z[2] IN (5, 6)
           THEN round((z[1] + CAST(1 AS FLOAT)) * CAST(127.5 AS FLOAT)) ELSE round(z[1] * CAST(255 AS FLOAT)) END)) AS BIGINT)) AS q8
  FROM embeddings
), asks AS (SELECT ref_id AS qid, vector AS qv, q16 AS qv16, q8 AS qv8 FROM refs WHERE ref_id % 50 = 0)"""


def dist(a: str, b: str, metric: str = "i16") -> str:
    if metric == "float":
        return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))"
    weight = " * CASE WHEN z[3] IN (5, 6) THEN 4 ELSE 1 END" if metric == "i8" else ""
    return f"CAST(list_sum(list_transform(list_zip({a}, {b}, range({DIMS})), lambda z: (z[1] - z[2]) * (z[1] - z[2]){weight})) AS BIGINT)"


_COLS = {"i16": ("qv16", "q16"), "i8": ("qv8", "q8"), "float": ("qv", "vector")}


def exact(metric: str, name: str = "near") -> str:
    q, r = _COLS[metric]
    return f"""
{name} AS (
  SELECT * FROM (SELECT qid, ref_id, fraud, d, row_number() OVER (PARTITION BY qid ORDER BY d, ref_id) AS rk
                 FROM (SELECT qid, ref_id, fraud, {dist(q, r, metric)} AS d FROM asks JOIN refs ON ref_id <> qid)) WHERE rk <= 5
)"""


CENTROIDS = f"centroids AS (SELECT ref_id AS centroid_id, q16 AS c FROM refs WHERE ref_id < {BUCKETS})"
ASSIGNED = f"""
{CENTROIDS}, assigned AS (
  SELECT ref_id, q16, fraud, centroid_id AS bucket_id FROM (
    SELECT refs.*, centroid_id, row_number() OVER (PARTITION BY ref_id ORDER BY {dist('q16', 'c')}, centroid_id) AS rn FROM refs, centroids) WHERE rn = 1
)"""
COUNTS = f"""
counts AS (
  SELECT bucket_id, cnt, CAST(sum(cnt) OVER (ORDER BY bucket_id) - cnt AS BIGINT) AS "offset"
  FROM (SELECT b.range AS bucket_id, count(ref_id) AS cnt FROM range({BUCKETS}) b LEFT JOIN assigned ON bucket_id = b.range GROUP BY b.range)
)"""
PLACED = "placed AS (SELECT *, row_number() OVER (ORDER BY bucket_id, ref_id) - 1 AS pos FROM assigned)"
PROBES = f"""
probes AS (
  SELECT qid, qv16, centroid_id AS bucket_id, d, row_number() OVER (PARTITION BY qid ORDER BY d, centroid_id) AS rk
  FROM (SELECT qid, qv16, centroid_id, {dist('qv16', 'c')} AS d FROM asks, centroids)
), scans AS (
  SELECT qid, rk, ref_id, fraud, {dist('qv16', 'q16')} AS d FROM probes JOIN assigned USING (bucket_id) WHERE ref_id <> qid
), votes AS (
  SELECT qid, upto, CAST(coalesce(sum(fraud) FILTER (WHERE rn <= 5), 0) AS INTEGER) AS fc FROM (
    SELECT p.qid, p.rk AS upto, s.fraud, row_number() OVER (PARTITION BY p.qid, p.rk ORDER BY s.d, s.rk, s.ref_id) AS rn
    FROM probes p LEFT JOIN scans s ON s.qid = p.qid AND s.rk <= p.rk) GROUP BY qid, upto
)"""


def adaptive(low: int, high: int, name: str = "found") -> str:
    return f"""
{name} AS (
  SELECT v.qid, v.upto AS scanned, v.fc, v.fc < 3 AS approved FROM votes v JOIN (
    SELECT qid, coalesce(min(upto) FILTER (WHERE fc IN (0, 5)), max(upto)) AS stop FROM votes WHERE upto BETWEEN {low} AND {high} GROUP BY qid) s
  ON v.qid = s.qid AND v.upto = s.stop
)"""


EXPECTED = exact("i16") + ", expected AS (SELECT qid, CAST(sum(fraud) AS INTEGER) < 3 AS expected FROM near GROUP BY qid)"
IVF = f"WITH {REFS}, {ASSIGNED}"
SEARCH = f"{IVF}, {PROBES}"
_COUNTS = """count(*) AS n, count(*) FILTER (WHERE approved = expected AND NOT expected) AS tp, count(*) FILTER (WHERE approved = expected AND expected) AS tn,
       count(*) FILTER (WHERE approved <> expected AND NOT approved) AS fp, count(*) FILTER (WHERE approved <> expected AND approved) AS fn"""
_DET = "CASE WHEN (fp + fn) / n::DOUBLE > 0.15 THEN -3000.0::DOUBLE ELSE 1000 * log10(1 / greatest((fp + 3 * fn) / n::DOUBLE, 0.001::DOUBLE)) - 300 * log10(1 + (fp + 3 * fn)::DOUBLE) END"
_PROJECTED = "CASE WHEN (fp + 3 * fn) / n::DOUBLE <= 0 THEN 3000.0::DOUBLE ELSE 1000 * log10(1 / greatest((fp + 3 * fn) / n::DOUBLE, 0.001::DOUBLE)) - 300 * log10(1 + (fp + 3 * fn) / n::DOUBLE * 54100) END"
_P99 = "(SELECT value FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events) WHERE i = least(n - 1, CAST(floor(0.99 * n) AS BIGINT)))"
_DECISIONS = f"{SEARCH}, {adaptive(3, 10)}, {EXPECTED}, conf AS (SELECT {_COUNTS} FROM found JOIN expected USING (qid))"
_RESPONSES = "[" + ", ".join(f"'{r}'" for r in K.RESPONSES) + "]"


def _tx(columns: str) -> str:
    return f"WITH {TX} SELECT event_id, {columns} FROM tx"


def _digest(column: str) -> str:
    zipped = f"list_transform(list_zip({column}, range(1, {DIMS + 1})), lambda z: z[1] * z[2])"
    return f"WITH {REFS} SELECT ref_id, CAST(list_sum({column}) AS BIGINT) AS total, CAST(list_sum(list_transform({column}, lambda x: x * x)) AS BIGINT) AS squares, CAST(list_sum({zipped}) AS BIGINT) AS placed FROM refs"


def _next(metric: str) -> str:
    column = _COLS[metric][1]
    d = dist(f"a.{column}", f"b.{column}", metric)
    return f"WITH {REFS} SELECT a.ref_id, {'round(' + d + ', 6)' if metric == 'float' else d} AS d FROM refs a JOIN refs b ON b.ref_id = a.ref_id + 1"


def _nearest(metric: str) -> str:
    return f"WITH {REFS}, {exact(metric)} SELECT qid, CAST(rk AS INTEGER) AS rk, ref_id, {'round(d, 6)' if metric == 'float' else 'd'} AS d FROM near"


_DIMS14 = [f"f{i:02d}" for i in range(14)]
_D14 = " + ".join(f"(a.{f} - c.{f}) * (a.{f} - c.{f})" for f in _DIMS14)
_FIVE = "row_number() OVER (PARTITION BY qid, upto ORDER BY d, rk, ref_id) AS rn"
#: The whole path: features of all transactions, 16 centroids, one or two buckets a request, response.
SCORED = f"""
WITH {TX}, v AS (SELECT event_id, CAST(fraud AS INTEGER) AS fraud, {', '.join(f'CAST({code(x)} AS BIGINT) AS f{i:02d}' for i, x in enumerate(_F))} FROM tx),
near AS (
  SELECT qid, cid, row_number() OVER (PARTITION BY qid ORDER BY d, cid) AS rk
  FROM (SELECT a.event_id AS qid, c.event_id AS cid, {_D14} AS d FROM v a JOIN v c ON c.event_id < 16)
), pairs AS (
  SELECT p.qid, p.rk, c.event_id AS ref_id, c.fraud, {_D14} AS d
  FROM near p JOIN near b ON b.cid = p.cid AND b.rk = 1 JOIN v a ON a.event_id = p.qid JOIN v c ON c.event_id = b.qid WHERE p.rk <= 2
), five AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, rk ORDER BY d, ref_id) AS own FROM pairs) WHERE own <= 5
), votes AS (
  SELECT qid, upto, CAST(sum(fraud) AS INTEGER) AS fc FROM (
    SELECT *, {_FIVE} FROM (SELECT f.*, u.upto FROM five f JOIN (VALUES (1), (2)) u(upto) ON f.rk <= u.upto)) WHERE rn <= 5 GROUP BY qid, upto
), found AS (
  SELECT e.event_id AS qid, CASE WHEN coalesce(o.fc, 0) IN (0, 5) THEN 1 ELSE 2 END AS scanned, coalesce(CASE WHEN coalesce(o.fc, 0) IN (0, 5) THEN o.fc ELSE t.fc END, 0) AS fc
  FROM v e LEFT JOIN votes o ON o.qid = e.event_id AND o.upto = 1 LEFT JOIN votes t ON t.qid = e.event_id AND t.upto = 2
)
SELECT qid AS request_id, false AS fallback, CAST(scanned AS INTEGER) AS scanned, CAST(fc AS INTEGER) AS fc, fc < 3 AS approved, {_RESPONSES}[fc + 1] AS response FROM found"""


def _lloyd(steps: int) -> str:
    """Steps of k-means on the codes, written out one after the other; empty centroids take the next drawn rows."""
    sql = f"""WITH {REFS}, k0 AS (SELECT b.range AS cid, CASE WHEN b.range = {BUCKETS - 1} THEN list_transform(range({DIMS}), lambda x: CAST(30000 AS BIGINT)) ELSE q16 END AS c
        FROM range({BUCKETS}) b JOIN refs ON ref_id = CASE WHEN b.range < {BUCKETS - 2} THEN b.range ELSE 0 END)"""
    for i in range(steps + 1):
        sql += f""", a{i} AS (SELECT ref_id, q16, cid FROM (SELECT ref_id, q16, cid, row_number() OVER (PARTITION BY ref_id ORDER BY {dist('q16', 'c')}, cid) AS rn FROM refs, k{i}) WHERE rn = 1)"""
        if i < steps:
            sql += f""", m{i} AS (SELECT cid, list(CAST(floor(total / n::DOUBLE + 0.5) AS BIGINT) ORDER BY dim) AS c FROM (
              SELECT cid, dim, CAST(sum(q16[dim + 1]) AS BIGINT) AS total, count(*) AS n FROM a{i}, (SELECT range AS dim FROM range({DIMS})) GROUP BY cid, dim) GROUP BY cid),
            e{i} AS (SELECT cid, row_number() OVER (ORDER BY cid) AS turn FROM k{i} WHERE cid NOT IN (SELECT cid FROM m{i})),
            r{i} AS (SELECT q16, row_number() OVER (ORDER BY ((ref_id % 2147483647) * 1103515245 + {2 + i} * 40503) % 2147483647, ref_id) AS turn FROM refs),
            k{i + 1} AS (SELECT * FROM m{i} UNION ALL SELECT cid, q16 FROM e{i} JOIN r{i} USING (turn))"""
    return sql + f""" SELECT cid AS centroid_id, (SELECT count(*) FROM a{steps} WHERE a{steps}.cid = k{steps}.cid) AS cnt, CAST(list_sum(c) AS BIGINT) AS total,
        CAST(list_sum(list_transform(list_zip(c, range(1, {DIMS + 1})), lambda z: z[1] * z[2])) AS BIGINT) AS placed FROM k{steps}"""


_FALLBACK = "event_id % 17 NOT IN (2, 4, 12)"

ORACLES: dict[str, str] = {
    "feat_amount_ratio": _tx(f"{code(_F[0])} AS amount, {code(_F[2])} AS ratio, {code(_F[13])} AS merchant"),
    "feat_calendar": f"SELECT event_id, {code(_F[3])} AS hour, {code(_F[4])} AS weekday FROM events",
    "feat_since_last": _tx(f"{code(_F[5])} AS minutes, {code(_F[6])} AS km"),
    "feat_tx_count_24h": _tx(f"tx_count_24h, {code(_F[8])} AS code"),
    "feat_unknown_merchant": _tx(f"{code('unknown')} AS unknown"),
    "feat_mcc_risk": _tx(f"mcc, {code(_RISK)} AS risk"),
    "feat_vector14": _tx(_VECTOR),
    "json_payload_roundtrip": _tx(_VECTOR),
    "json_fallback": f"""SELECT event_id, {_FALLBACK} AS fallback,
        CASE event_id % 17 WHEN 2 THEN 0 WHEN 4 THEN 5000 WHEN 12 THEN 0 END AS amount, CASE WHEN event_id % 17 IN (2, 4, 12) THEN 0 END AS weekday,
        CASE WHEN {_FALLBACK} THEN '{K.RESPONSES[0]}' ELSE '{K.RESPONSES[3]}' END AS response FROM events""",
    "iso8601_offset": """SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN CAST(hour(ts) AS INTEGER) END AS hour,
        CASE WHEN event_id % 11 <> 0 THEN CAST(isodow(ts) - 1 AS INTEGER) END AS weekday, CASE WHEN event_id % 11 <> 0 THEN epoch_us(ts) END AS micros FROM events""",
    "quantize_i16": _digest("q16"),
    "quantize_i8": _digest("q8"),
    "dist_i16": _next("i16"),
    "dist_i8_weighted": _next("i8"),
    "dist_float": _next("float"),
    "knn_exact_i16": _nearest("i16"),
    "knn_exact_i8": _nearest("i8"),
    "knn_exact_float": _nearest("float"),
    "knn_exact_blocks": _nearest("i16"),
    "knn_vote": f"""WITH {REFS}, {exact('i16')}, v AS (SELECT qid, CAST(sum(fraud) AS INTEGER) AS fc FROM near GROUP BY qid)
        SELECT qid, fc, round(fc / 5.0::DOUBLE, 1) AS score, fc < 3 AS approved, fc AS back FROM v""",
    "ivf_assign": f"{IVF} SELECT ref_id, bucket_id FROM assigned",
    "ivf_bucket_stats": f"""{IVF}, {COUNTS} SELECT count(*) AS k, CAST(sum(cnt) AS BIGINT) AS n, min(cnt) AS min_cnt, max(cnt) AS max_cnt,
        count(*) FILTER (WHERE cnt = 0) AS empty, CAST(sum(cnt) // count(*) AS BIGINT) AS avg_cnt FROM counts""",
    "ivf_offsets": f"{IVF}, {COUNTS} SELECT * FROM counts",
    "ivf_permutation": f"{IVF}, {PLACED} SELECT ref_id, bucket_id, pos FROM placed",
    "label_bitset": f"{IVF}, {PLACED} SELECT pos // 8 AS byte_no, bit_or(CAST(fraud << CAST(pos % 8 AS INTEGER) AS INTEGER)) AS bits FROM placed GROUP BY 1",
    "label_roundtrip": "SELECT vec_id AS ref_id, CAST(label < 4 AS TINYINT) AS fraud FROM embeddings",
    "ivf_probe": f"{SEARCH} SELECT qid, CAST(rk AS INTEGER) AS rk, bucket_id, d FROM probes WHERE rk <= 8",
    "ivf_search": f"{SEARCH} SELECT qid, fc, fc < 3 AS approved FROM votes WHERE upto = 4",
    "ivf_search_blocks": f"{SEARCH} SELECT qid, fc, fc < 3 AS approved FROM votes WHERE upto = 4",
    "ivf_adaptive": f"{SEARCH}, {adaptive(3, 10)} SELECT qid, CAST(scanned AS INTEGER) AS scanned, fc, approved FROM found",
    "ivf_scanned": f"{SEARCH}, {adaptive(3, 10)} SELECT count(*) AS n, CAST(sum(scanned) AS BIGINT) AS scanned, round(avg(scanned), 6) AS avg_scanned FROM found",
    "kmeans_step": f"""{IVF}, {COUNTS}, dims AS (SELECT CAST(range AS INTEGER) AS dim FROM range({DIMS}))
        SELECT b.bucket_id AS centroid_id, dim, any_value(b.cnt) AS cnt, round(coalesce(sum(a.q16[dim + 1]), any_value(s.q16[dim + 1])) / CAST(greatest(any_value(b.cnt), 1) AS DOUBLE), 6) AS mean
        FROM counts b CROSS JOIN dims LEFT JOIN assigned a ON a.bucket_id = b.bucket_id LEFT JOIN refs s ON s.ref_id = b.bucket_id + {BUCKETS} GROUP BY b.bucket_id, dim""",
    "eval_confusion": f"""{_DECISIONS} SELECT n, tp, tn, fp, fn, fp + 3 * fn AS e, round((fp + fn) / n::DOUBLE, 6) AS fail_rate, round(100.0::DOUBLE * (tp + tn) / n, 6) AS accuracy FROM conf""",
    "eval_det_score": f"{_DECISIONS} SELECT n, round({_DET}, 6) AS det_score, round({_PROJECTED}, 6) AS det_projected FROM conf",
    "eval_percentiles": f"""SELECT (SELECT value FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events) WHERE i = n // 2) AS p50, {_P99} AS p99""",
    "eval_p99_score": f"""{_DECISIONS}, s AS (SELECT {_P99} AS p99, {_DET} AS det FROM conf), t AS (SELECT *, CASE WHEN p99 > 2000 THEN -3000.0::DOUBLE ELSE 1000 * log10(1000 / greatest(p99, 1.0::DOUBLE)) END AS p FROM s)
        SELECT p99, round(p, 6) AS p99_score, round(p + det, 6) AS final_score FROM t""",
    "sweep_nprobe": f"""{SEARCH}, {EXPECTED}, conf AS (SELECT CAST(upto AS INTEGER) AS nprobe, {_COUNTS} FROM (SELECT *, fc < 3 AS approved FROM votes) JOIN expected USING (qid) WHERE upto IN (1, 2, 4, 8, 20) GROUP BY 1)
        SELECT nprobe, n, fp, fn, fp + 3 * fn AS e, round({_DET}, 6) AS det_score FROM conf""",
    "sweep_adaptive": f"""{SEARCH}, {EXPECTED}, {', '.join(adaptive(a, b, f'f{i}') for i, (a, b) in enumerate([(1, 5), (3, 10), (5, 20)]))},
        every AS ({' UNION ALL '.join(f'SELECT {a} AS nlow, {b} AS nhigh, * FROM f{i}' for i, (a, b) in enumerate([(1, 5), (3, 10), (5, 20)]))}),
        conf AS (SELECT nlow, nhigh, {_COUNTS}, round(avg(scanned), 6) AS avg_scanned FROM every JOIN expected USING (qid) GROUP BY nlow, nhigh)
        SELECT nlow, nhigh, n, fp, fn, fp + 3 * fn AS e, round({_DET}, 6) AS det_score, avg_scanned FROM conf""",
    "diag_methods": f"""{SEARCH}, {EXPECTED}, {exact('float', 'nf')}, {exact('i8', 'n8')},
        every AS (SELECT 'exact_float' AS method, qid, sum(fraud) < 3 AS approved FROM nf GROUP BY qid UNION ALL SELECT 'exact_i8', qid, sum(fraud) < 3 FROM n8 GROUP BY qid
                  UNION ALL SELECT 'ivf_i16', qid, fc < 3 FROM votes WHERE upto = 8),
        conf AS (SELECT method, {_COUNTS} FROM every JOIN expected USING (qid) GROUP BY method)
        SELECT method, n, fp, fn, fp + 3 * fn AS e, round({_PROJECTED}, 6) AS det_projected FROM conf""",
    "response_body": f"{SEARCH}, {adaptive(3, 10)} SELECT qid, {_RESPONSES}[fc + 1] AS body FROM found",
    "index_roundtrip": f"{IVF}, {PLACED} SELECT ref_id, CAST(bucket_id // 32 AS INTEGER) AS part, bucket_id, pos, CAST(fraud AS TINYINT) AS fraud, CAST(list_sum(q16) AS BIGINT) AS total FROM placed",
    "score_batch": SCORED,
    "score_stream": SCORED,
    "kmeans_lloyd": _lloyd(3),
    "reference_scan": f"WITH {REFS} SELECT row_number() OVER (ORDER BY ref_id) - 1 AS ref_id, CAST(fraud AS TINYINT) AS fraud, CAST(list_sum(q16) AS BIGINT) AS total FROM refs",
    "round_robin": "SELECT event_id, CAST((row_number() OVER (ORDER BY event_id) - 1) % 2 AS INTEGER) AS instance FROM events",
    "test_set_scan": f"WITH {TX} SELECT row_number() OVER (ORDER BY event_id) - 1 AS entry, NOT fraud AS expected_approved, coalesce('MERC-' || lpad(CAST(k AS VARCHAR), 3, '0'), '') AS merchant, installments FROM tx",
}
