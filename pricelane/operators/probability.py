"""Predicted probabilities over the price grid.

A prediction is one row per customer and item with `grid`, an array of (dp, prob_jan, prob_lv5) with
one entry per price step. Corrections work inside a row and need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelane.config import PricingConfig

PROBS = ("prob_jan", "prob_lv5")


def _entry(dp: Column, prob_jan: Column, prob_lv5: Column) -> Column:
    return F.struct(dp.cast("int").alias("dp"), prob_jan.cast("double").alias("prob_jan"),
                    prob_lv5.cast("double").alias("prob_lv5"))


def price_grid(base: DataFrame, cfg: PricingConfig) -> DataFrame:
    """Every row once per price step, with the step added to the new price."""
    return (base.withColumn("dp", F.explode(F.array(*(F.lit(dp) for dp in cfg.grid))))
            .withColumn("aprice", F.col("aprice") + F.col("dp")))


def grid_from_long(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, dp, prob_jan, prob_lv5) gathered to one row per key."""
    entry = _entry(F.col("dp"), F.col("prob_jan"), F.col("prob_lv5"))
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("grid"))


def grid_to_long(df: DataFrame) -> DataFrame:
    return df.select(*(c for c in df.columns if c != "grid"), F.inline("grid"))


def grid_from_wide(df: DataFrame, cfg: PricingConfig) -> DataFrame:
    """Columns prob_jan_{dp} and prob_lv5_{dp} as one array."""
    wide = {f"{p}_{dp}" for p in PROBS for dp in cfg.grid}
    entries = [_entry(F.lit(dp), F.col(f"prob_jan_{dp}"), F.col(f"prob_lv5_{dp}"))
               for dp in cfg.grid]
    return df.select(*(c for c in df.columns if c not in wide), F.array(*entries).alias("grid"))


def grid_to_wide(df: DataFrame, cfg: PricingConfig) -> DataFrame:
    """One column per probability and price step; NULL for a step the row lacks."""
    def step(dp):
        return F.try_element_at(F.filter("grid", lambda e: e["dp"] == dp), F.lit(1))
    return df.select(*(c for c in df.columns if c != "grid"),
                     *(step(dp)[p].alias(f"{p}_{dp}") for dp in cfg.grid for p in PROBS))


def clamp_prob(df: DataFrame) -> DataFrame:
    """Every probability moved into [0, 1]; NULL stays NULL."""
    def clamp(p):
        return F.when(p.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))
    return df.withColumn("grid", F.transform(
        "grid", lambda e: _entry(e["dp"], clamp(e["prob_jan"]), clamp(e["prob_lv5"]))))


def monotone_prob(df: DataFrame, cfg: PricingConfig) -> DataFrame:
    """Probabilities that fall by a fixed step from one price to the next and never below 0.

    The category first; then the item, which also stays below the category at the same price. NULL
    values are skipped in each minimum.
    """
    def lowered(value, *bounds):
        lowest = F.least(value, *bounds)
        return F.when(lowest.isNotNull(), F.greatest(lowest, F.lit(0.0)))

    def step(done, entry):
        last = F.try_element_at(done, F.lit(-1))
        lv5 = lowered(entry["prob_lv5"], last["prob_lv5"] - cfg.fix_same_type_lv5)
        jan = lowered(entry["prob_jan"], lv5 - cfg.fix_same_dprice,
                      last["prob_jan"] - cfg.fix_same_type_jan)
        return F.concat(done, F.array(_entry(entry["dp"], jan, lv5)))

    empty = F.array().cast("array<struct<dp:int,prob_jan:double,prob_lv5:double>>")
    return df.withColumn("grid", F.aggregate(F.sort_array("grid"), empty, step))
