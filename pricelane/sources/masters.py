"""Master files in CSV."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelane.schema import DROP_LIST, ITEM_MASTER, PACK_MASTER, SERIES_MASTER
from pricelane.sources.tables import Workspace, session_workspace


class Parsed(NamedTuple):
    rows: DataFrame
    rejects: DataFrame


def _parsed(text: DataFrame, schema: T.StructType) -> tuple[list[Column], Column]:
    """The columns of `schema` from text columns of the same names, and why a row is rejected, if it is."""
    def value(field):
        return F.trim(F.col(field.name)) if field.name in text.columns else F.lit(None).cast("string")

    reasons = [F.when(F.coalesce(value(f), F.lit("")) == "", F.lit("no jan") if f.name == "jan" else None)
               .when(value(f).try_cast(f.dataType).isNull(), f"unreadable {f.name}") for f in schema]
    typed = [F.nullif(value(f), F.lit("")).try_cast(f.dataType).alias(f.name) for f in schema]
    return typed, F.coalesce(*reasons)


def parse_master(text: DataFrame, schema: T.StructType) -> Parsed:
    """Rows of text columns in the types of `schema`, and the rejected rows as they are with a `reason`.

    Columns are found by name; absent ones are NULL. A row is rejected if a value that is not blank
    cannot be read, or if it has no item code.
    """
    typed, reason = _parsed(text, schema)
    return Parsed(text.where(reason.isNull()).select(*typed),
                  text.withColumn("reason", reason).where("reason IS NOT NULL"))


def _read(spark: SparkSession, path: str, schema: T.StructType, max_rejected: float,
          optional: bool = False, work: Workspace | None = None) -> DataFrame:
    """The readable rows, kept in `work` (by default the workspace of the session).

    The file is read once: all its rows are written to `work` with the reason why a row is rejected, if it
    is, and counted there. Fails when more than the share `max_rejected` of all rows is rejected, and says
    why; an optional file may be missing.
    """
    try:
        text = spark.read.csv(path, header=True, encoding="UTF-8")
    except AnalysisException as error:
        if optional and error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise
    # a byte order mark stays glued to the first header name
    text = text.withColumnsRenamed({c: c.lstrip("\ufeff").strip() for c in text.columns})
    if not text.columns:
        return spark.createDataFrame([], schema)
    typed, reason = _parsed(text, schema)
    kept = (work or session_workspace(spark)).keep(text.select(*typed, reason.alias("_reason")), "master")
    found = kept.agg(F.count(F.lit(1)).alias("rows"), F.count("_reason").alias("rejected"), F.min("_reason").alias("why")).first()
    if found.rejected and found.rejected > max_rejected * found.rows:
        raise ValueError(f"{path}: {found.rejected} rows are rejected, for example for: {found.why}")
    return kept.where("_reason IS NULL").drop("_reason")


def read_pack_master(spark: SparkSession, path: str, max_rejected: float = 0.0,
                     work: Workspace | None = None) -> DataFrame:
    return _read(spark, path, PACK_MASTER, max_rejected, work=work)


def read_series_master(spark: SparkSession, path: str, max_rejected: float = 0.0,
                       work: Workspace | None = None) -> DataFrame:
    return _read(spark, path, SERIES_MASTER, max_rejected, optional=True, work=work)


def read_item_master(spark: SparkSession, path: str, max_rejected: float = 0.0,
                     work: Workspace | None = None) -> DataFrame:
    return _read(spark, path, ITEM_MASTER, max_rejected, work=work)


def read_drop_list(spark: SparkSession, path: str, max_rejected: float = 0.0,
                   work: Workspace | None = None) -> DataFrame:
    return _read(spark, path, DROP_LIST, max_rejected, work=work)
