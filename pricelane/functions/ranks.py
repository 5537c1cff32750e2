"""Relative ranks that need no sort of all rows in one task.

A rank only depends on how many rows have a smaller value. So rows are first counted per value, the
counts are added up inside value buckets, the (few) bucket totals are added up in value order, and
the result is joined back by value. All measures of a table go through these steps together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS_PER_OCTAVE = 256
# further out than the bucket of any finite double
NULL_BUCKET = 1 << 20


def value_bucket(value: Column) -> Column:
    """A coarse bucket that never decreases when the value grows."""
    return (F.signum(value)
            * F.floor(F.log2(F.abs(value) + 1) * BUCKETS_PER_OCTAVE)).cast("int")


def _preceding(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def _sort_key(column: str, descending: bool) -> Column:
    value = F.col(column).cast("double")
    return -value if descending else value


def rows_before(rows: DataFrame, group: list[str]) -> DataFrame:
    """Per (group, _null, _value): `_before`, the rows of the group with an earlier value, and `_total`,
    from rows (group, _bucket, _null, _value) whose buckets are in the order of the values."""
    counts = rows.groupBy(*group, "_bucket", "_null", "_value").agg(F.count(F.lit(1)).alias("_n")) \
        .repartition(*group, "_bucket")
    inside = F.sum("_n").over(_preceding(Window.partitionBy(*group, "_bucket").orderBy("_value")))
    # one row per bucket, a bounded number for all finite doubles
    of_group = Window.partitionBy(*group)
    lower = F.sum("_size").over(_preceding(of_group.orderBy("_bucket")))
    totals = (counts.groupBy(*group, "_bucket").agg(F.sum("_n").alias("_size"))
              .select(*group, "_bucket", F.coalesce(lower, F.lit(0)).alias("_lower"),
                      F.sum("_size").over(of_group).alias("_total")))
    return (counts.withColumn("_inside", F.coalesce(inside, F.lit(0)))
            .join(totals, [*group, "_bucket"])
            .select(*group, "_null", "_value",
                    (F.col("_inside") + F.col("_lower")).alias("_before"), "_total"))


def with_inside(counts: DataFrame, value: str, amount: str) -> DataFrame:
    """Add `_bucket`, of the `value`, and `_inside`: the sum of `amount` over smaller values of the bucket. Values are
    distinct."""
    inside = F.sum(amount).over(_preceding(Window.partitionBy("_bucket").orderBy(value)))
    return (counts.withColumn("_bucket", value_bucket(F.col(value)))
            .withColumn("_inside", F.coalesce(inside, F.lit(0))))


def with_lower(buckets: DataFrame, amount: str) -> DataFrame:
    """Add `_lower`: the sum of `amount` over the buckets below; one row per bucket, a bounded number for all
    finite doubles."""
    lower = F.sum(amount).over(_preceding(Window.partitionBy(F.lit(0)).orderBy("_bucket")))
    return buckets.withColumn("_lower", F.coalesce(lower, F.lit(0)))


def _stacked(df: DataFrame, scores: dict[str, tuple[str, bool]]) -> DataFrame:
    values = F.array(*(_sort_key(column, descending) for column, descending in scores.values()))
    return (df.select("*", F.posexplode(values).alias("_measure", "_key"))
            .withColumn("_null", F.col("_key").isNull())
            .withColumn("_value", F.coalesce("_key", F.lit(0.0)) + 0.0).drop("_key"))


def _ranks(stacked: DataFrame, by: list[str], scores: dict[str, tuple[str, bool]]) -> DataFrame:
    null_buckets = F.lit([NULL_BUCKET if descending else -NULL_BUCKET for _, descending in scores.values()])
    bucket = F.when(F.col("_null"), null_buckets[F.col("_measure")]).otherwise(value_bucket(F.col("_value")))
    group = [*by, "_measure"]
    return rows_before(stacked.select(*group, bucket.alias("_bucket"), "_null", "_value"), group)


def _score(form: str) -> Column:
    if form == "percent":
        return F.when(F.col("_total") > 1, F.col("_before") / (F.col("_total") - 1)).otherwise(0.0)
    return (F.col("_before") + 1) / F.col("_total")


#: Ranks that are looked up in a broadcast table: some 100 bytes each.
RANKS_IN_MEMORY = 500_000


def with_looked_up_scores(df: DataFrame, by: list[str], scores: dict[str, tuple[str, bool]], form: str,
                          keys: list[str], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The same as with_rank_scores for a `df` that was written, whose rows stay where they are.

    There are as many ranks as values in a group. They are written by `keep` and counted; with too many for
    memory, rows are shuffled to meet them as in with_rank_scores.
    """
    ranks = keep(_ranks(_stacked(df.select(*by, *(c for c, _ in scores.values())), scores), by, scores)
                 .select(*by, "_measure", "_null", "_value", _score(form).alias("_score")))
    if ranks.count() > RANKS_IN_MEMORY:
        values = [c for c, _ in scores.values()]
        scored = with_rank_scores(df.select(*keys, *values), by, scores, form, keys).drop(*values)
        return df.join(scored.hint("merge"), keys, "left")
    out = df
    for i, (name, (column, descending)) in enumerate(scores.items()):
        found = ranks.where(F.col("_measure") == i).select(*by, "_null", "_value", F.col("_score").alias(name))
        key = _sort_key(column, descending)
        out = (out.withColumn("_null", key.isNull()).withColumn("_value", F.coalesce(key, F.lit(0.0)) + 0.0)
               .join(F.broadcast(found), [*by, "_null", "_value"], "left").drop("_null", "_value"))
    return out.select(*df.columns, *scores)


def with_rank_scores(df: DataFrame, by: list[str], scores: dict[str, tuple[str, bool]],
                     form: str = "percent", keys: list[str] | None = None) -> DataFrame:
    """Add one relative rank per entry of `scores` (new column -> (value column, descending)).

    form "percent": (rank - 1) / (rows - 1), 0 for a single row; "share": rank / rows. NULL comes first in
    ascending and last in descending order. `keys`: columns that identify a row, if there are any; without
    them whole rows are compared and repeated ones are kept.

    All values are stacked into one table of (measure, value), which is counted, added up and joined once,
    however many ranks are asked for; each row then gathers its ranks.
    """
    if form not in ("percent", "share"):
        raise ValueError(f"unknown form {form!r}")
    stacked = _stacked(df, scores)
    met = stacked.join(_ranks(stacked, by, scores), [*by, "_measure", "_null", "_value"])
    score = _score(form)
    gathered = [F.max(F.when(F.col("_measure") == i, score)).alias(name) for i, name in enumerate(scores)]
    if keys:
        rest = [F.first(c).alias(c) for c in df.columns if c not in keys]
        return met.groupBy(*keys).agg(*rest, *gathered).select(*df.columns, *scores)
    return (met.groupBy(*df.columns).agg(*gathered, F.count_if(F.col("_measure") == 0).cast("int").alias("_copies"))
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).drop("_copies", "_copy"))
