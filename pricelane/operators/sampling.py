"""Customers touched by a case and whether they kept buying."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelane.config import PricingConfig
from pricelane.functions.hot import sales_in_window, same
from pricelane.schema import CASE, CATEGORY, ITEM


def sample_customers(cases: DataFrame, days: DataFrame, cfg: PricingConfig,
                     label_scope: str | None = None, clustered: bool = False) -> DataFrame:
    """Members who bought the item in the `sample_len` days before the change, and for how much.

    `days` comes from `member_days`. With a `label_scope` two labels are added: did the member buy
    the item (`label_jan`) or its category (`label_lv5`) in the label window, which starts
    `interval_len` days after the change. Scope "case" looks at the window of the row's own case,
    "item" at the windows of all cases of the item or category. `clustered` days lie in buckets by store and
    member, where label scope "case" looks them up.
    """
    if label_scope not in (None, "case", "item"):
        raise ValueError(f"unknown label scope {label_scope!r}")
    label_first, label_last = cfg.interval_len, cfg.interval_len + cfg.label_len - 1
    last = label_last if label_scope else -1
    near = sales_in_window(cases, days.select(*ITEM, "uid", "salesday", "salesamount"), ITEM,
                           -cfg.sample_len, last, cfg, by="uid")
    before = F.col("salesday") < F.col("astart")
    after = F.col("salesday") >= F.date_add("astart", label_first)
    base = (near.groupBy(*CASE, "uid")
            .agg(F.sum(F.when(before, F.col("salesamount"))).alias("sample_amt_jan"),
                 F.count(F.when(before, 1)).alias("sampled"),
                 F.max(after).alias("label_jan")))
    if label_scope is None:
        return base.where("sampled > 0").drop("sampled", "label_jan")
    if label_scope == "item":
        base = base.withColumn(
            "label_jan", F.max("label_jan").over(Window.partitionBy(*ITEM, "uid")))
    base = base.where("sampled > 0").drop("sampled")
    if label_scope == "case" and clustered:
        return _category_label_where_it_lies(base, days, label_first, label_last)
    if label_scope == "case":
        return _category_label_of_case(base, days, label_first, label_last, cfg)
    return _category_label_of_any_case(base, cases, days, label_first, label_last)


def _category_label_of_case(base: DataFrame, days: DataFrame, first: int, last: int,
                            cfg: PricingConfig) -> DataFrame:
    # a member's cases of a category with one change day share their answer
    keys = [*CATEGORY, "uid"]
    asked = base.select(*keys, "astart").distinct()
    bought = days.select(*keys, "salesday").distinct().join(asked.select(*keys).distinct(), keys, "left_semi")
    buyers = (sales_in_window(asked, bought, keys, first, last, cfg)
              .select(*keys, "astart").distinct().withColumn("label_lv5", F.lit(True)))
    return (base.join(buyers, [*keys, "astart"], "left")
            .withColumn("label_lv5", F.coalesce("label_lv5", F.lit(False))))


def _category_label_where_it_lies(base: DataFrame, days: DataFrame, first: int, last: int) -> DataFrame:
    """The same from days in buckets by store and member: the keys of the join are those of the buckets."""
    bought = days.select("store_cd", "uid", "salesday", F.col("lv4_nm").alias("_lv4"), F.col("lv5_nm").alias("_lv5")).hint("merge")
    met = base.join(bought.withColumnsRenamed({"store_cd": "_store", "uid": "_uid"}), [
        F.col("store_cd") == F.col("_store"), F.col("uid") == F.col("_uid"),
        F.col("salesday").between(F.date_add("astart", first), F.date_add("astart", last)),
        same(F.col("lv5_nm"), F.col("_lv5")), same(F.col("lv4_nm"), F.col("_lv4"))], "left")
    return met.groupBy(*base.columns).agg(F.max(F.col("salesday").isNotNull()).alias("label_lv5"))


def _category_label_of_any_case(base: DataFrame, cases: DataFrame, days: DataFrame,
                                first: int, last: int) -> DataFrame:
    label_days = (cases.select(*CATEGORY, "astart").distinct()
                  .select(*CATEGORY, F.explode(F.sequence(
                      F.date_add("astart", first), F.date_add("astart", last))).alias("salesday"))
                  .distinct())
    buyers = (days.select(*CATEGORY, "uid", "salesday").distinct()
              .join(label_days, [*CATEGORY, "salesday"], "left_semi")
              .select(*CATEGORY, "uid").distinct()
              .withColumn("label_lv5", F.lit(True)))
    return (base.join(buyers, [*CATEGORY, "uid"], "left")
            .withColumn("label_lv5", F.coalesce("label_lv5", F.lit(False))))
