"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelane.config import PricingConfig

#: Rows of a kept table that one task sorts or groups.
ROWS_PER_TASK = 250_000


def parts(df: DataFrame) -> int:
    """Into how many parts `df` is dealt so that a task has at most some `ROWS_PER_TASK` rows.

    Spark merges shuffle partitions, and decides about broadcasts, by compressed sizes, which for customer days
    and samples are a small part of what they take in memory; a stated number of parts is left alone. `df` is
    counted, which of a table that was written only reads the footers of its files.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_TASK))


def same(a: Column, b: Column) -> Column:
    """Equality that Spark takes for a condition and not for a key of the join: rows that lie together by some
    of their columns are compared where they lie, and not shuffled by all of them."""
    return (a <= b) & (a >= b)


def hot_keys(df: DataFrame, keys: list[str], cfg: PricingConfig) -> DataFrame:
    """Keys with more than `hot_share` of the rows and the number of slices each is cut into.

    At most 1 / hot_share keys can pass, so the result may be broadcast at any data size.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total")).scalar()
    limit = F.greatest(F.lit(float(cfg.hot_rows)), total * F.lit(cfg.hot_share))
    return counts.where(F.col("_n") > limit).select(
        *keys, F.ceil(F.col("_n") / limit).cast("int").alias("_slices"))


def join_split(big: DataFrame, small: DataFrame, keys: list[str], by: Column,
               cfg: PricingConfig) -> DataFrame:
    """Inner join in which the rows of a hot key of `big` are spread by `by` over slices.

    Only the rows of `small` with a hot key are repeated, once per slice. They find their key in a map of the
    hot ones: a join would hide from the optimizer how small `small` is, and one that can be broadcast (a table
    that was written, such as the cases of a run) spares `big` its shuffle. The map holds hashes of keys; a
    key that shares its hash with a hot one is repeated for slices in which nothing meets it.
    """
    hot = hot_keys(big, keys, cfg)
    digest = F.xxhash64(*(F.col(k).cast(big.schema[k].dataType) for k in keys))
    listed = hot.groupBy(digest.alias("_digest")).agg(F.max("_slices").alias("_slices")) \
        .agg(F.str_to_map(F.listagg(F.concat_ws(":", "_digest", "_slices"), F.lit(",")), F.lit(","), F.lit(":"))).scalar()
    spread = (big.join(F.broadcast(hot), keys, "left")
              .withColumn("_slice", F.pmod(F.xxhash64(by), F.coalesce("_slices", F.lit(1))).cast("int"))
              .drop("_slices"))
    slices = F.coalesce(F.try_element_at(listed, digest.cast("string")).cast("int"), F.lit(1))
    repeated = small.withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    return repeated.join(spread, [*keys, "_slice"]).drop("_slice")


def sales_in_window(cases: DataFrame, sales: DataFrame, keys: list[str], first: int, last: int,
                    cfg: PricingConfig, by: str | None = None, parts: int | None = None) -> DataFrame:
    """Rows of `sales` on a day in [astart + first, astart + last] of a case with equal keys.

    Time is cut into slots as long as the window: a case reaches at most two slots and a sale lies
    in exactly one, so the slot is part of the equi-join key and only near rows are compared.
    With `by`, keys with very many sales are spread by that column. With `parts` both sides are dealt into so
    many parts by key and slot and neither is broadcast: for cases that grow with the sales.
    """
    width = last - first + 1

    def slot(day: Column) -> Column:
        return F.floor(F.unix_date(day) / F.lit(width))

    start, end = F.date_add("astart", first), F.date_add("astart", last)
    slots = F.sequence(slot(start), slot(end))
    left = cases.withColumn("_slot", F.explode(slots))
    right = sales.withColumn("_slot", slot(F.col("salesday")))
    keyed = [*keys, "_slot"]
    if parts is not None:
        joined = left.repartition(parts, *keyed).hint("merge").join(right.repartition(parts, *keyed), keyed)
    elif by is None:
        joined = left.join(right, keyed)
    else:
        joined = join_split(right, left, keyed, F.col(by), cfg)
    return joined.where(F.col("salesday").between(start, end)).drop("_slot")
