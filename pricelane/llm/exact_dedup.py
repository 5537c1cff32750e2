"""Exact duplicates by a tree merge of sorted digest runs.

Every input partition starts as one run at its own place. Places are numbers with `levels` digits to
the base `fan_in`. In round j the places exchange: an entry moves to the place whose j-th digit is the
j-th digit of its digest, so each place receives a slice of the runs of `fan_in` places, merges them
in digest order and keeps one entry per text: the row that stays, and the number of rows. After the
last round an entry's place follows from its digest alone, and every text has one entry. Copies shrink
at every level, so a text that a third of the rows share is never gathered in one task, and no place
ever holds more than its share of the digests.

Texts meet by SHA-256, verified at every level by length and a second, independent hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pricelane.llm.text import ascii_lower
from pricelane.llm.work import written

KEY = ["digest", "bytes", "proof"]


def digests(docs: DataFrame) -> DataFrame:
    """One narrow row per row of `docs`, written once: doc_id, row (a number of its own), digest,
    bytes and proof of the normalised text, and raw, a hash of the text as it is."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(F.col("doc_id"), text.alias("raw"), ascii_lower(text).alias("norm")).select(
        "doc_id", F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.octet_length("norm").alias("bytes"), F.xxhash64("norm", F.lit(7)).alias("proof"),
        F.xxhash64("raw").alias("raw"))
    return written(narrow, "digests")


def merge(rows: DataFrame, keep: str = "max", fan_in: int = 16) -> DataFrame:
    """digest, bytes, proof, winner (doc_id, row, raw), group_size: one row per text of `digests`.

    keep: "max" or "min", the doc_id that stays. Rows without a doc_id lose against rows with one;
    of rows that agree in text and doc_id one stays.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    levels = 1
    while fan_in ** levels < parts:
        levels += 1
    best = F.max if keep == "max" else F.min
    order = F.col("doc_id") if keep == "max" else -F.col("doc_id")
    entry = F.struct(order.alias("order"), "row", "doc_id", "raw")
    # without a doc_id `order` is null, which is below every value
    runs = rows.select(*KEY, entry.alias("winner"), F.lit(1).cast("long").alias("group_size"),
                       F.pmod(F.spark_partition_id(), F.lit(fan_in ** levels)).cast("long")
                       .alias("place"))
    best = F.max
    target = F.pmod("proof", F.lit(fan_in ** levels))
    for level in range(levels):
        unit = fan_in ** level
        digit = lambda c: F.floor(c / unit) % fan_in
        runs = (runs.withColumn("place", F.col("place") + (digit(target) - digit(F.col("place"))) * unit)
                .repartition(parts, "place").sortWithinPartitions("place", *KEY)
                .groupBy("place", *KEY)
                .agg(best("winner").alias("winner"), F.sum("group_size").alias("group_size")))
    return runs.select(*KEY, "winner", "group_size")


def exact_duplicates(docs: DataFrame, keep: str = "max") -> DataFrame:
    """One row per row of `docs` (doc_id, text; other columns are ignored): doc_id, keep_id (of the
    row that stays), group_size, kept, text_sha256 (of the text in lower-case A-Z; null is empty).

    An empty table gives no rows. Rows without a doc_id form groups like others; keep_id is null only
    if no row of the group has one. Exactly one row of every group is kept, also of repeated rows.
    """
    rows = digests(docs)
    winners = merge(rows, keep).select(
        *(F.col(c).alias(f"w_{c}") for c in KEY), "group_size",
        F.col("winner.doc_id").alias("keep_id"), F.col("winner.row").alias("keep_row"))
    same = [F.col(c) == F.col(f"w_{c}") for c in KEY]
    return rows.join(winners, same).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def without_duplicates(docs: DataFrame, keep: str = "max") -> DataFrame:
    """The rows of `docs` that stay, with all their columns. Of rows that agree in doc_id and text one
    stays, whatever their other columns hold."""
    winners = merge(digests(docs), keep).select(F.col("winner.doc_id").alias("w_id"),
                                                F.col("winner.raw").alias("w_raw"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names).withColumns({
        "own_id": F.col(names[docs.columns.index("doc_id")]),
        "own_raw": F.xxhash64(F.coalesce(F.col(names[docs.columns.index("text")]), F.lit("")))})
    met = own.join(winners, F.col("own_id").eqNullSafe(F.col("w_id")) & (F.col("own_raw") == F.col("w_raw")),
                   "left_semi")
    # the join has put equal keys side by side, in order
    first = Window.partitionBy("own_id", "own_raw").orderBy("own_id", "own_raw")
    return met.withColumn("place", F.row_number().over(first)).filter("place = 1") \
        .select(*names).toDF(*docs.columns)
