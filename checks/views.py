"""The retail tables as views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelane.config import PricingConfig
from pricelane.operators.forest import Forest
from pricelane.operators.models import RetentionModels
from pricelane.schema import CATEGORY_FEATURES, ITEM_FEATURES

CFG = PricingConfig(pscore_mod_lv5={"milk": 700})
UPDAY = "1998-01-15"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Receipt lines that one task adds up.
LINES_PER_TASK = 100_000


def parts(spark: SparkSession, folder: str) -> int:
    """Into how many parts receipt lines are dealt; the files know their number of lines."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, folder, "lineitem").count() // LINES_PER_TASK))


#: Items of the second view: three categories of eight, two groups.
MANY = 24


def _receipt_columns(*more: str, count: int = 5) -> list:
    jan = F.col("l_partkey") % count
    day = F.col("l_shipdate").cast("date")
    units = 1 + F.col("l_quantity").cast("int") % 8
    steps = F.floor(F.datediff(day, F.lit("1995-01-01").cast("date")) / (150 + 25 * jan))
    paid = F.when((F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "R"), 0).otherwise(1)
    return [
        day.alias("salesday"),
        (F.col("l_suppkey") % 2).cast("int").alias("store_cd"),
        *more,
        jan.alias("jan"),
        units.cast("double").alias("salescnt"),
        (paid * units * (100 + 10 * jan + 10 * steps)).cast("double").alias("salesamount"),
        F.concat(F.lit("item "), jan.cast("string")).alias("name"),
        F.lit("lv3").alias("lv3_nm"),
        (F.lit("lv4") if count == 5 else F.concat(F.lit("group "), F.floor(jan / 16).cast("string"))).alias("lv4_nm"),
        (F.when(jan < 3, "milk").otherwise("tea") if count == 5 else
         F.concat(F.lit("class "), F.floor(jan / 8).cast("string"))).alias("lv5_nm"),
    ]


def receipts(spark: SparkSession, folder: str, count: int = 5) -> DataFrame:
    """Receipt lines without the member, for everything that is about shelves."""
    return table(spark, folder, "lineitem").select(*_receipt_columns(count=count))


def pos(spark: SparkSession, folder: str, count: int = 5) -> DataFrame:
    """Receipt lines with the member; every fiftieth customer is unknown."""
    member = F.when(F.col("o_custkey") % 50 != 0, F.col("o_custkey")).alias("uid")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return (table(spark, folder, "lineitem")
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(*_receipt_columns(member, count=count)))


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Item master: cost price, cap of the increase, pack content and series of the five items."""
    jan = F.col("jan")
    return (table(spark, folder, "part").select((F.col("p_partkey") % 5).alias("jan")).distinct()
            .select("jan", F.concat(F.lit("item "), jan.cast("string")).alias("name"),
                    (60 + 5 * jan).cast("double").alias("oprice"),
                    F.when(jan < 3, 20).otherwise(30).alias("max_dprice"),
                    (250 + 300 * jan).cast("double").alias("det_val"),
                    F.lit("A").alias("series")))


def packs(spark, folder):
    return items(spark, folder).select("jan", "det_val")


def series(spark, folder):
    return items(spark, folder).select("jan", "series")


def item_master(spark, folder):
    return items(spark, folder).select("jan", "name", "oprice", "max_dprice")


def dropped(spark, folder):
    return items(spark, folder).where("jan = 4").select("jan")


def star(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fact, category and product tables; one category and one brand are missing in the dimensions."""
    part = table(spark, folder, "part")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    fact = (table(spark, folder, "lineitem")
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.col("l_shipdate").cast("date").alias("SALES_DATE"),
                    F.col("l_suppkey").alias("STORE_CODE"),
                    F.col("o_custkey").alias("MEMBER_CODE"),
                    F.lpad(F.col("l_partkey").cast("string"), 20, "0").alias("JAN_CODE"),
                    F.col("l_quantity").alias("SALES_NUMBER"),
                    (F.col("l_extendedprice") - 5000).alias("SALES_AMOUNT"),
                    (F.col("l_partkey") % 20).alias("CATEGORY_KEY"),
                    F.col("l_partkey").alias("PRODUCT_CODE"),
                    (20 + F.col("o_custkey") % 60).alias("AGE"),
                    (F.col("o_custkey") % 2).alias("GENDER_FLG")))
    key = F.col("p_partkey") % 20
    category = (part.select(key.alias("CATEGORY_KEY")).distinct().where("CATEGORY_KEY <> 19")
                .select("CATEGORY_KEY",
                        F.concat(F.lit("area "), (F.col("CATEGORY_KEY") % 2).cast("string"))
                        .alias("CATEGORY1_NAME"),
                        F.concat(F.lit("group "), (F.col("CATEGORY_KEY") % 4).cast("string"))
                        .alias("CATEGORY2_NAME"),
                        F.concat(F.lit("class "), F.col("CATEGORY_KEY").cast("string"))
                        .alias("CATEGORY3_NAME")))
    product = (part.where("p_partkey % 50 <> 7")
               .select(F.col("p_partkey").alias("PRODUCT_CODE"), F.col("p_name").alias("PRODUCT_NAME")))
    return fact, category, product


def store(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(F.col("s_name").alias("STORE_NAME"),
                                                   F.col("s_suppkey").alias("STORE_CODE"))


def _dealt(spark: SparkSession, folder: str, lines: DataFrame) -> DataFrame:
    """Receipt lines by store and member, in parts that a task can gather in memory. What is grouped later by
    these and other columns stays where it is."""
    return lines.repartition(parts(spark, folder), "store_cd", "uid")


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Deterministic probabilities for every member who bought an item."""
    keys = ["store_cd", "lv4_nm", "lv5_nm", "jan", "uid"]
    bought = (_dealt(spark, folder, pos(spark, folder).where("uid IS NOT NULL AND salesamount > 0"))
              .groupBy(*keys).agg(F.sum("salesamount").alias("sample_amt_jan")))
    wear = 0.01 * (F.col("uid") % 7)
    slope = 0.00025 * ((2 * F.col("jan") + F.col("store_cd")) % 5)
    drift = F.when(F.col("uid") % 11 == 0, 0.001).otherwise(-0.001)
    return (bought
            .withColumn("pprice", (150 + 5 * F.col("jan")).cast("double"))
            .withColumn("dp", F.explode(F.array(*(F.lit(dp) for dp in CFG.grid))))
            .withColumn("prob_lv5", 0.95 - wear - slope * F.col("dp") * F.col("dp"))
            .withColumn("prob_jan", 0.80 - wear + drift * F.col("dp")))


def predictions_many(spark: SparkSession, folder: str) -> DataFrame:
    """The same for 24 items, of which each two have equal sales and prices and so equal profits."""
    keys = ["store_cd", "lv4_nm", "lv5_nm", "jan", "uid"]
    bought = (_dealt(spark, folder, pos(spark, folder, MANY // 2).where("uid IS NOT NULL AND salesamount > 0"))
              .groupBy("store_cd", "jan", "uid").agg(F.sum("salesamount").alias("sample_amt_jan"))
              .withColumn("half", F.col("jan"))
              .withColumn("jan", F.explode(F.array(F.col("half"), F.col("half") + MANY // 2)))
              .withColumn("lv4_nm", F.concat(F.lit("group "), (F.col("half") % 2).cast("string")))
              .withColumn("lv5_nm", F.concat(F.lit("class "), (F.col("half") % 4).cast("string"))))
    slope = 0.00025 * ((2 * F.col("half") + F.col("store_cd")) % 5)
    wear = 0.01 * (F.col("uid") % 7)
    return (bought
            .withColumn("pprice", (150 + 5 * F.col("half")).cast("double"))
            .withColumn("dp", F.explode(F.array(*(F.lit(dp) for dp in CFG.grid))))
            .withColumn("prob_lv5", 0.95 - wear - slope * F.col("dp") * F.col("dp"))
            .withColumn("prob_jan", 0.80 - wear - 0.001 * F.col("dp"))
            .select(*keys, "sample_amt_jan", "pprice", "dp", "prob_lv5", "prob_jan"))


def items_many(spark: SparkSession, folder: str) -> DataFrame:
    """Masters of the 24 items: every fifth has no series, every seventh no known pack content."""
    jan = F.col("jan")
    half = jan % (MANY // 2)
    return (table(spark, folder, "part").select((F.col("p_partkey") % MANY).alias("jan")).distinct()
            .select("jan", F.concat(F.lit("item "), half.cast("string")).alias("name"),
                    (60 + 5 * half).cast("double").alias("oprice"),
                    F.when(half % 3 == 0, 20.0).otherwise(30.0).alias("max_dprice"),
                    F.when(jan % 7 != 0, (250 + 50 * jan).cast("double")).alias("det_val"),
                    F.when(jan % 5 != 0, F.concat(F.lit("S"), (jan % 2).cast("string"))).alias("series")))


# -- forests by rule, the same on both engines -----------------------------------------------------

#: Splits and leaves of a tree are numbered like a heap: 1 to SPLITS - 1, then as many leaves.
TREES, SPLITS = 7, 16


def rule_nodes(spark: SparkSession, ranges: list[tuple[float, float]], seed: int = 0) -> DataFrame:
    """A node table whose thresholds lie in the ranges of the inputs, by a rule of tree, node and seed."""
    tree, node = F.col("tree"), F.col("node")
    leaf = node >= SPLITS
    place = (5 * tree + 3 * node + seed) % len(ranges)
    low, span = (F.lit([float(r[i] if i == 0 else r[1] - r[0]) for r in ranges])[F.col("place")] for i in (0, 1))
    part = ((37 * tree + 11 * node + 17 * seed) % 97 + 1) / F.lit(98.0)
    return (spark.range(TREES).select(F.col("id").cast("int").alias("tree"))
            .withColumn("node", F.explode(F.sequence(F.lit(1), F.lit(2 * SPLITS - 1))))
            .withColumn("place", place.cast("int"))
            .select("tree", "node", F.when(leaf, -1).otherwise(F.col("place")).alias("feature"),
                    F.when(~leaf, low + span * part).alias("threshold"), F.when(~leaf, 2 * node).alias("low"),
                    F.when(~leaf, 2 * node + 1).alias("high"),
                    F.when(leaf, ((13 * tree + 29 * node + 7 * seed) % 129) / F.lit(128.0)).alias("share")))


#: Ranges of the model inputs that the rule draws thresholds from; the others lie between 0 and 1.
RANGES = {"dprice": (0, 30), "dprice_pct": (0, 0.25), "pprice": (100, 300), "aprice": (100, 300), "f_lv5": (0, 12),
          "m_lv5": (0, 9000), "pscore_item": (-0.5, 0.5), "pscore_ucate": (-0.5, 0.5), "kani_score": (0, 0.5),
          "kani_score_dis025": (0, 0.25)}


def rule_models(spark: SparkSession, seed: int) -> RetentionModels:
    """A pair of forests by rule over the inputs of the two models."""
    made = [Forest.of(rule_nodes(spark, [RANGES.get(c, (0, 1)) for c in inputs], seed + i), inputs)
            for i, inputs in enumerate((ITEM_FEATURES, CATEGORY_FEATURES))]
    return RetentionModels(*made)


FOREST_INPUTS = ["l_quantity", "l_extendedprice", "l_discount", "part", "line"]


def forest_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with five inputs, of which one has gaps."""
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        (F.col("l_partkey") % 50).cast("double").alias("part"),
        F.when(F.col("l_linenumber") != 3, F.col("l_linenumber").cast("double")).alias("line"))


PREDICTION_KEYS = ["store_cd", "lv4_nm", "lv5_nm", "jan", "uid", "sample_amt_jan", "pprice"]
