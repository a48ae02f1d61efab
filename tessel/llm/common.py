"""What the operators share: written intermediate tables, checked broadcasts, salted ranks."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Largest table, in bytes, that is broadcast. Beyond it the same join is a shuffled one.
BROADCAST_BYTES = 32 << 20

#: The white space of the contracts, ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\x0c\r"

#: Rows of an Arrow batch of texts at most, which bounds the memory of a Python worker beside its JVM.
BATCH_ROWS = 1000

_scratch: dict[str, str] = {}


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to :data:`BATCH_ROWS` rows if they are larger; no result hangs on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``; a temporary one only on a local master."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "local" not in _scratch:
        _scratch["local"] = tempfile.mkdtemp(prefix="tessel-")
    return "file://" + _scratch["local"]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: lineage ends here, executors may go."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    root = f"{shared_dir(spark)}/tessel-{app}"
    if root not in _scratch.values():
        _scratch[app] = root
        atexit.register(_release_quietly, spark)
    path = f"{root}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _release_quietly(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may be gone when the interpreter ends
        release(spark)


def release(spark: SparkSession) -> None:
    """Delete the tables that :func:`written` has made for this application."""
    root = _scratch.pop(spark.sparkContext.applicationId, None) if spark.sparkContext._jsc else None
    if root:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows fit :data:`BROADCAST_BYTES`; else as it is."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def without(docs: DataFrame, dropped: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose key isn't in ``dropped`` (one column, same name). Null keys stay."""
    return docs.join(small(dropped, dropped.count(), 24), key, "left_anti")


def stripped(text: Column) -> Column:
    """``text`` (null: empty) without the contracts' white space."""
    out = F.coalesce(text, F.lit(""))
    for space in SPACES:
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def salted_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, salts: int = 64) -> DataFrame:
    """Add ``out``, a rank from 0 within ``keys``; no task sorts more than about 1/salts of a key's rows.

    Rows are dealt by a hash of ``order`` into sub-groups; ranks count on from the sizes of the
    sub-groups before. The order is a fixed pseudo-random one, the same in each run. ``df`` is read
    twice, so it should be a written table.
    """
    keys, order = list(keys), list(order)
    salt = F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int")
    dealt = df.withColumn("_salt", salt)
    sizes = dealt.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*keys, "_salt").orderBy(F.xxhash64(F.lit(1), *order), *order)
    ranked = dealt.withColumn("_row", F.row_number().over(within) - 1)
    same = [ranked[k].eqNullSafe(sizes[k]) for k in keys] + [ranked["_salt"] == sizes["_salt"]]
    joined = ranked.join(sizes, [*same], "inner")
    return joined.select(*[ranked[c] for c in df.columns], (ranked["_row"] + sizes["_base"]).alias(out))
