"""The engine's inputs from the star-schema tables: labelled vectors and a stream of transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.functions.vectors import quantize_vector_i16, quantize_vector_i8

#: Merchant categories by key, two of them without a risk of their own.
MCCS = ["5411", "5812", "5912", "5944", "7801", "7802", "7995", "4511", "5311", "5999", "0000", None]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_id, vector, q16, q8, fraud) of all ``embeddings``; labels below 4 stand for fraud."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ref_id"), F.col("embedding").alias("vector"), (F.col("label") < 4).cast("tinyint").alias("fraud"))
    return rows.select("ref_id", "vector", quantize_vector_i16(F.col("vector")).alias("q16"), quantize_vector_i8(F.col("vector")).alias("q8"), "fraud")


def search_queries(refs: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by 50."""
    return refs.where("ref_id % 50 = 0").select(F.col("ref_id").alias("qid"), F.col("vector").alias("qv"), F.col("q16").alias("qv16"), F.col("q8").alias("qv8"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per row of ``events``; running windows by user.

    ``known_merchants`` holds each merchant of all the user's earlier events once, in order of their names, so a
    row grows with the merchants and not with the history; ``seen_before`` says whether the event's own is among
    them, for which no list is made. An event without a merchant (``props`` null or without
    ``k``) has the defaults of a request that leaves it out: no id, no category, zeros. Money is whole hundredths inside windows, so sums don't hang on the order of the rows.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts"), k.alias("k"), F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = user.rowsBetween(Window.unboundedPreceding, -1)
    day = Window.partitionBy("user_id").orderBy("us").rangeBetween(-86_400_000_000, 0)
    events = events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    n, total = F.count(F.lit(1)).over(before), F.sum("cents").over(before)
    events = events.select(
        "*",
        F.when(n > 0, total * 20 / 100.0 / n).otherwise(F.lit(0.0)).alias("customer_avg"),
        (F.count(F.lit(1)).over(day) - 1).cast("int").alias("tx_count_24h"),
        F.array_sort(F.collect_set(F.concat(F.lit("MERC-"), F.lpad(F.col("k").cast("string"), 3, "0"))).over(before)).alias("known_merchants"),
        (F.col("k").isNotNull() & (F.row_number().over(Window.partitionBy("user_id", "k").orderBy("ts", "event_id")) > 1)).alias("seen_before"),
        F.lag("ts").over(user).alias("last_ts"),
        F.lag("k").over(user).alias("last_k"),
    )
    merchants = events.groupBy(F.col("k").alias("mk")).agg(F.round(F.sum("cents") * 20 / 100.0 / F.count(F.lit(1)), 2).alias("merchant_avg"))
    mcc = F.element_at(F.array(*map(F.lit, MCCS)), F.col("k") % len(MCCS) + 1)
    merchant = F.concat(F.lit("MERC-"), F.lpad(F.col("k").cast("string"), 3, "0"))
    return events.join(merchants, F.col("k") == F.col("mk"), "left").select(
        "event_id",
        "user_id",
        "k",
        (F.col("cents") * 20 / 100.0).alias("amount"),
        F.coalesce((F.col("k") % 12 + 1).cast("int"), F.lit(0)).alias("installments"),
        F.col("ts").cast("timestamp").alias("requested_at"),
        "customer_avg",
        "tx_count_24h",
        "known_merchants",
        "seen_before",
        F.coalesce(merchant, F.lit("")).alias("merchant_id"),
        mcc.alias("mcc"),
        F.coalesce("merchant_avg", F.lit(0.0)).alias("merchant_avg"),
        F.col("event_type").isin("click", "view").alias("is_online"),
        (F.col("event_type") == "purchase").alias("card_present"),
        F.coalesce(F.col("k") * 15.0, F.lit(0.0)).alias("km_from_home"),
        F.col("last_ts").cast("timestamp").alias("last_at"),
        F.coalesce(F.abs(F.col("k") - F.col("last_k")) * 12.0, F.lit(0.0)).alias("km_from_current"),
        (F.col("event_type") == "error").alias("fraud"),
    )


def payload_body(zone_hours=0):
    """The JSON request of a transaction; instants are written with an offset of ``zone_hours``."""
    hours = F.lit(zone_hours) if isinstance(zone_hours, int) else zone_hours
    zone = F.concat(F.when(hours < 0, "-").otherwise("+"), F.lpad(F.abs(hours).cast("string"), 2, "0"), F.lit(":00"))
    written = lambda t: F.concat(F.date_format(F.timestamp_micros(F.unix_micros(t) + hours.cast("bigint") * 3_600_000_000), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), zone)
    return F.to_json(
        F.struct(
            F.col("event_id").cast("string").alias("id"),
            F.struct("amount", "installments", written(F.col("requested_at")).alias("requested_at")).alias("transaction"),
            F.struct(F.col("customer_avg").alias("avg_amount"), "tx_count_24h", "known_merchants").alias("customer"),
            F.struct(F.col("merchant_id").alias("id"), "mcc", F.col("merchant_avg").alias("avg_amount")).alias("merchant"),
            F.struct("is_online", "card_present", "km_from_home").alias("terminal"),
            F.when(F.col("last_at").isNotNull(), F.struct(written(F.col("last_at")).alias("timestamp"), "km_from_current")).alias("last_transaction"),
        )
    )
