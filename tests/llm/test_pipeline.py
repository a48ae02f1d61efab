from collections import Counter

import corpus_pipeline as P
from tests.llm.helpers import documents, with_clashes
from tests.llm.test_jaccard_join import shingles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_effect(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before = docs.collect()
    for name, stage in P.STAGES:
        out = P.written(stage(spark, docs, sf), "test")
        rows = out.collect()
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            assert {tuple(r) for r in rows} <= {tuple(r) for r in before}
        if name == "quality_classifier":
            kept = {r.doc_id for r in rows}
            clean = [i for i, x in labels.items() if x.quality == 1 and x.toxic == 0]
            assert sum(i in kept for i in clean) >= 0.98 * len(clean)
            assert sum(i in kept for i, x in labels.items() if x.quality == 0) <= 0.1 * sum(x.quality == 0 for x in labels.values())
        if name == "exact_dedup":
            squeeze = lambda r: "".join((r.text or "").split())
            assert len({squeeze(r) for r in rows}) == len(rows) == len({squeeze(r) for r in before})
        if name == "near_dedup":
            sets = [shingles(r.text) for r in rows]
            by = Counter(x for s in sets for x in s)
            few = [{x for x in s if by[x] > 1} for s in sets]
            assert not any(a and b and len(a & b) >= 0.8 * len(sets[i] | sets[j]) for i, a in enumerate(few) for j, b in enumerate(few[:i]) if a & b)
        if name == "mixing":
            assert max(Counter(r.doc_id for r in rows).values()) <= 3
        if name == "packing":
            assert {r.doc_id for r in rows} == {r.doc_id for r in before}
            copies = Counter(r.doc_id for r in before)
            assert all(n == copies[i] for i, n in Counter(r.doc_id for r in rows if r.piece == 0).items())
        docs, before = out, rows


def test_awkward_rows_go_through(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (with_clashes(documents(spark)), documents(spark, [])):
        for name, stage in P.STAGES:
            out = P.written(stage(spark, docs, str(tmp_path)), "test")
            if name != "packing":
                assert out.columns == docs.columns
            docs = out


def test_run_writes_what_the_stages_give(spark, sf_small):
    assert P.run(spark, sf_small).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
