import hashlib
import re

from pyspark.sql import functions as F

from tessel.llm import exact_dedup
from tests.llm.helpers import AWKWARD, DOC_SCHEMA, documents, with_clashes

COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0d]", "", r[1] or "") for r in rows]
    out = []
    for r, n in zip(rows, norm, strict=True):
        group = [x for x, m in zip(rows, norm, strict=True) if m == n]
        keep = min(group, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))[0]
        out.append((r[0], keep, len(group), r[0] == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in df.select(*COLUMNS).collect()], key=str)


def test_awkward_rows(spark):
    assert got(exact_dedup.exact_dedup(with_clashes(documents(spark)))) == brute(AWKWARD)


def test_colliding_hashes_are_told_apart(spark):
    rows = [(i, f"text number {i % 17}" + " " * (i % 3), "en", "a", 1, "x") for i in range(200)]
    weak = lambda text: F.unhex(F.substring(F.md5(text.cast("binary")), 1, 1))
    assert got(exact_dedup.exact_dedup(documents(spark, rows), content_hash=weak)) == brute(rows)


def test_hot_and_other_groups(spark, monkeypatch):
    rows = [(i, "a hot text" if i % 3 == 0 else f"text number {i % 70}" + " " * (i % 4), "en", "a", 1, "x") for i in range(300)]
    monkeypatch.setattr(exact_dedup, "HOT", 4)
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", 0)
    assert got(exact_dedup.exact_dedup(documents(spark, rows))) == brute(rows)
    # No group is hot here.
    assert got(exact_dedup.exact_dedup(documents(spark, rows[1:3] * 3 + rows[4:6] * 3 + rows[7:9] * 3))) == brute(rows[1:3] * 3 + rows[4:6] * 3 + rows[7:9] * 3)


def test_empty_table(spark):
    assert got(exact_dedup.exact_dedup(documents(spark, []))) == []
    assert exact_dedup.keep_first(documents(spark, [])).count() == 0


def test_keep_first_leaves_one_of_each(spark):
    kept = exact_dedup.keep_first(with_clashes(documents(spark)))
    assert "keep_id" in kept.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([3, 6, 7, 8, 9, 10, None, None], key=str)
    assert kept.where("doc_id = 3").count() == 1


def test_schema_is_the_documents(spark):
    assert exact_dedup.keep_first(documents(spark)).schema.simpleString() == documents(spark).schema.simpleString()
    assert DOC_SCHEMA
