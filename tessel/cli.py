"""Command line: ``python -m tessel.cli selftest | build | validate | diag``."""

from __future__ import annotations

import sys

from tessel.config import Settings, number
from tessel.functions import constants as K


def options(args: list[str]) -> tuple[list[str], dict[str, str]]:
    """(plain arguments, values by ``--name``)."""
    plain, named, i = [], {}, 0
    while i < len(args):
        if args[i].startswith("--"):
            named[args[i][2:]] = args[i + 1] if i + 1 < len(args) else ""
            i += 2
        else:
            plain.append(args[i])
            i += 1
    return plain, named


def selftest(spark) -> int:
    from tessel.plans.golden import differences

    wrong = differences(spark)
    for name, dim, got, want in wrong:
        print(f"{name}[{dim}]: {got}, expected {want}")
    print("failed" if wrong else "passed")
    return int(bool(wrong))


def build(spark, source: str, path: str, k: int = 2048, iters: int = 12, sample: int = 200_000, seed: int = 1) -> None:
    from tessel.functions.vectors import quantize_vector_i16
    from tessel.operators import ivf, kmeans
    from tessel.sources import index_store, payload

    refs = payload.read_references(spark, source)
    refs = refs.withColumn("q16", quantize_vector_i16(refs["vector"])).persist()
    centroids, _ = kmeans.train(refs, k, iters, sample, seed)
    table = kmeans.centroid_table(spark, centroids)
    assigned = ivf.assign(refs, table.select("centroid_id", "c"), K.DIMS)
    index_store.write(path, ivf.permutation(assigned), table, K.DIMS, k)
    ivf.bucket_stats(ivf.bucket_counts(assigned, k)).show()


def _decided(spark, index: str, tests: str, limit: int | None):
    from tessel.functions.vectors import quantize_vector_i16
    from tessel.sources import index_store, payload

    vectors, centroids = index_store.load(spark, index)
    entries = payload.with_features(payload.read_test_set(spark, tests, limit).withColumnRenamed("entry", "request_id"))
    asks = entries.where("not fallback").selectExpr("-request_id - 1 as qid", "vector as qv", "expected_approved as expected")
    return vectors.persist(), centroids, asks.withColumn("qv16", quantize_vector_i16(asks["qv"])).persist()


def validate(spark, index: str, tests: str, nprobes: list[int], pairs: list[tuple[int, int]], limit: int | None = None) -> None:
    """Accuracy for fixed numbers of probes and for adaptive (nlow, nhigh) pairs."""
    from tessel.operators import evaluate, ivf

    vectors, centroids, asks = _decided(spark, index, tests, limit)
    if nprobes:
        got = ivf.sweep(asks, vectors, centroids, K.DIMS, nprobes).join(asks.select("qid", "expected"), "qid")
        evaluate.with_scores(evaluate.confusion(got, ("nprobe",))).orderBy("nprobe").show()
    for low, high in pairs:
        got = ivf.adaptive(asks, vectors, centroids, K.DIMS, low, high).join(asks.select("qid", "expected"), "qid").persist()
        evaluate.with_scores(evaluate.confusion(got)).crossJoin(got.selectExpr("avg(scanned) as avg_scanned")).show()


def diag(spark, source: str, index: str, tests: str, sample: int = 5000, nprobe: int = 8) -> None:
    """Exact float, exact 8-bit and index search on the same requests."""
    from pyspark.sql import functions as F

    from tessel.functions.vectors import quantize_vector_i8
    from tessel.operators import evaluate, ivf, knn
    from tessel.sources import payload

    vectors, centroids, asks = _decided(spark, index, tests, sample)
    asks = asks.withColumn("qv8", quantize_vector_i8(asks["qv"]))
    refs = payload.read_references(spark, source)
    refs = refs.withColumn("q8", quantize_vector_i8(refs["vector"])).persist()
    found = [knn.vote(knn.exact(asks, refs, K.DIMS, m), asks).select("qid", "approved", F.lit(name).alias("method")) for m, name in (("float", "exact_float"), ("i8", "exact_i8"))]
    found.append(ivf.search(asks, vectors, centroids, K.DIMS, nprobe).select("qid", "approved", F.lit("ivf_i16").alias("method")))
    rows = found[0].unionByName(found[1]).unionByName(found[2]).join(asks.select("qid", "expected"), "qid")
    evaluate.confusion(rows, ("method",)).select("*", evaluate.weighted_error().alias("e"), evaluate.det_score_projected().alias("det_projected")).show()


def main(args: list[str]) -> int:
    from tessel.session import session

    plain, named = options(args)
    command, rest = (plain[0], plain[1:]) if plain else ("", [])
    arity = {"selftest": 0, "build": 2, "validate": 1, "diag": 3}
    if command not in arity or len(rest) < arity[command]:
        print("selftest | build REFERENCES INDEX | validate TESTS [--index I] [--limit N] [--nprobe 4,8,16,32] [--adaptive 8,128,...] | diag REFERENCES INDEX TESTS")
        return 2
    spark, settings = session("tessel-cli"), Settings.from_environment()
    if command == "selftest":
        return selftest(spark)
    if command == "build":
        build(spark, rest[0], rest[1], number(named.get("k"), 2048), number(named.get("iters"), 12), number(named.get("sample"), 200_000), number(named.get("seed"), 1))
    elif command == "validate":
        nprobes = [number(x, 8) for x in named.get("nprobe", "4,8,16,32").split(",") if x]
        bounds = [number(x, 8) for x in named.get("adaptive", f"{settings.nlow},{settings.nhigh}").split(",") if x]
        limit = number(named["limit"], 0) if "limit" in named else None
        validate(spark, named.get("index", settings.index_path), rest[0], nprobes, list(zip(bounds[::2], bounds[1::2], strict=False)), limit)
    else:
        diag(spark, *rest[:3], number(named.get("sample"), 5000), number(named.get("nprobe"), 8))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
