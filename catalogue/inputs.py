"""The test tables in the roles of transactions, identity rows, logs and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators.ordering import RowOrder, Splits, baseline_cut, hash_levels, id_levels
from tidegauge.operators.sampling import row_hash
from tidegauge.settings import BASELINE_FRACTION, SEED

LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
EMBEDDING_SIZE = 64
EMBEDDING_FEATURES = [f"e{i}" for i in range(EMBEDDING_SIZE)]

TRANSACTION_FEATURES = [
    "TransactionAmt",
    "amt_log",
    "amt_cents",
    "hour",
    "card1_freq",
    "C1",
    "C13",
    "has_identity",
    "id_01",
    "id_02",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as card transactions; some fields are missing on some orders."""
    level = F.substring("o_orderpriority", 1, 1).cast("bigint")
    second = F.pmod(F.floor(F.col("o_totalprice") * 100), F.lit(86400))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("TransactionID"),
        (F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("bigint") * 86400 + second).alias(
            "TransactionDT"
        ),
        F.col("o_totalprice").alias("TransactionAmt"),
        F.col("o_custkey").alias("card1"),
        F.when(F.col("o_orderstatus") != "P", F.expr("o_custkey div 10")).alias("card2"),
        F.when(F.col("o_orderpriority") != "5-LOW", level * 100).alias("addr1"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("P_emaildomain"),
        F.col("o_orderstatus").alias("ProductCD"),
        F.expr("o_custkey div 50").cast("double").alias("D1"),
        level.cast("double").alias("C1"),
        F.floor(F.col("o_totalprice") / 50000).cast("double").alias("C13"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("isFraud"),
    )


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as identity rows."""
    return (
        table(spark, sf_dir, "customer")
        .select(
            F.col("c_custkey").alias("card1"),
            F.col("c_acctbal").alias("id-01"),
            F.col("c_nationkey").cast("double").alias("id-02"),
        )
    )


def transaction_order() -> RowOrder:
    return RowOrder((F.floor(F.col("TransactionDT") / 86400), F.col("TransactionDT"), *id_levels("TransactionID")))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with a row digest and a stand-in prediction."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    digest = row_hash(SEED, *LINE_KEY, cents, F.unix_date(F.to_date("l_shipdate")))
    price = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        *LINE_KEY,
        "l_shipdate",
        "l_returnflag",
        "l_linestatus",
        *LINE_FEATURES,
        digest.alias("h"),
        (price / (price + 1000 * F.col("l_quantity"))).alias("pred"),
    )


def line_order() -> RowOrder:
    # The whole digest implies its first characters.
    return RowOrder.by_date("l_shipdate", hash_levels("h"), deciding=(0, 2))


def line_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The first 40% of the lines, and the rest with a price shift and missing discounts."""
    rows = lines(spark, sf_dir)
    splits = Splits.find(rows, line_order(), baseline_cut(BASELINE_FRACTION))
    live = rows.where(splits.from_(0)).withColumns(
        {
            "l_extendedprice": F.col("l_extendedprice") * 1.3,
            "l_discount": F.when(F.col("l_linenumber") > 4, F.col("l_discount")),
        }
    )
    return rows.where(splits.before(0)), live


def drifting_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose price grows with the year and whose tax goes missing when it is high in late years."""
    rows = lines(spark, sf_dir)
    year = F.year("l_shipdate")
    return rows.withColumns(
        {
            "l_extendedprice": F.col("l_extendedprice") * (1 + 0.05 * (year - 1995)),
            "l_tax": F.when((year < 2000) | (F.col("l_tax") < 0.04), F.col("l_tax")),
            "pred": F.col("pred") / (1 + 0.1 * (year - 1995)),
            "label": (F.col("l_returnflag") == "R").cast("int"),
        }
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scoring requests, some of them broken."""
    level = F.substring("o_orderpriority", 1, 1).cast("int")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("TransactionID"),
        (F.col("o_totalprice") * 0.25 - 1000).alias("TransactionAmt"),
        F.when(F.col("o_orderstatus") != "P", level).alias("ProductCD"),
        (F.col("o_custkey") - 10).alias("card1"),
        (level - 1).alias("card4"),
        (F.pmod(F.floor(F.col("o_totalprice")), F.lit(100000)) / 4000.0).alias("hour"),
        F.pmod(F.floor(F.col("o_totalprice")), F.lit(70)).cast("double").alias("C1"),
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a prediction log: ts, event_id, pred and one feature, k."""
    return log_fields(table(spark, sf_dir, "events"))


def log_fields(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("value") / 500).alias("pred"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        "event_type",
        "value",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as many numeric features and a stand-in prediction."""
    wide = table(spark, sf_dir, "embeddings").select(
        "vec_id", *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(EMBEDDING_FEATURES)]
    )
    return wide.withColumn("pred", 1 / (1 + F.col("e0") * F.col("e0") + F.col("e1") * F.col("e1")))
