"""Cleaning of receipt lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelane.config import PricingConfig
from pricelane.functions.scalars import ratio
from pricelane.schema import NO_CATEGORY


def with_categories(pos: DataFrame) -> DataFrame:
    """Sales of an unknown category get one of their own; a NULL key would drop out of every join."""
    return pos.fillna(NO_CATEGORY, ["lv4_nm", "lv5_nm"])


def positive_sales(pos: DataFrame) -> DataFrame:
    return pos.where((F.col("salesamount") > 0) & (F.col("salescnt") > 0))


def price_rows(pos: DataFrame) -> DataFrame:
    """Positive sales with the unit price rounded to two places."""
    price = F.round(ratio(F.col("salesamount"), F.col("salescnt")), 2)
    return (with_categories(positive_sales(pos))
            .select("salesday", "store_cd", "lv4_nm", "lv5_nm", "jan", "salescnt", "salesamount",
                    price.alias("price")))


def member_sales(pos: DataFrame, guest_uid=None) -> DataFrame:
    """Sales with an amount and a known member; `guest_uid` is the code used for guests, if any."""
    known = F.col("uid").isNotNull()
    if guest_uid is not None:
        known = known & (F.col("uid") != F.lit(guest_uid))
    return pos.where((F.col("salesamount") > 0) & known)


def clip_noise(pos: DataFrame, cfg: PricingConfig, price: str = "floor") -> DataFrame:
    """Clip the units of a line and value them at the unit price of the line before clipping.

    The unit price is rounded down ("floor"), truncated ("truncate") or left as it is ("exact").
    """
    exact = ratio(F.col("salesamount"), F.col("salescnt"))
    unit = {"floor": F.floor(exact).cast("double"),
            "truncate": exact.cast("long").cast("double"),
            "exact": exact}
    if price not in unit:
        raise ValueError(f"unknown price form {price!r}")
    units = F.when(F.col("salescnt") > cfg.noise_max_cnt, F.lit(float(cfg.noise_max_cnt))) \
             .otherwise(F.col("salescnt"))
    return (pos.withColumn("price", unit[price])
            .withColumn("salescnt", units)
            .withColumn("salesamount", F.col("price") * F.col("salescnt")))


def member_days(pos: DataFrame, cfg: PricingConfig, guest_uid=None, parts: int | None = None,
                clustered: bool = False) -> DataFrame:
    """Cleaned member sales added up per store, item, member and day.

    Sampling and all features start from this table, so receipt lines are read and shuffled once. With `parts`
    they are dealt into so many parts before anything is added up: few lines share a day, so adding up each
    piece of the input first only holds it in memory, however large the pieces are. With `clustered` all lines of a
    member in a store go into one part, as `Workspace.keep_clustered` wants them.
    """
    lines = clip_noise(with_categories(member_sales(pos, guest_uid)), cfg) \
        .select("store_cd", "lv4_nm", "lv5_nm", "jan", "uid", "salesday", "salesamount", "salescnt")
    if parts is not None:
        lines = lines.repartition(parts, *(["store_cd", "uid"] if clustered else ["store_cd", "jan", "uid", "salesday"]))
    return (lines
            .groupBy("store_cd", "lv4_nm", "lv5_nm", "jan", "uid", "salesday")
            .agg(F.sum("salesamount").alias("salesamount"), F.sum("salescnt").alias("salescnt")))


def null_profile(df: DataFrame) -> DataFrame:
    """Rows, NULLs and share of NULLs of every column, in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"),
                    *(F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns))
    return (counts.unpivot("_rows", df.columns, "column", "null_count")
            .select("column", F.col("_rows").alias("total_rows"), "null_count",
                    ratio(F.col("null_count"), F.col("_rows"), 0.0).alias("null_ratio")))
