import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[4]").appName("pricelane-tests")
               .config("spark.sql.shuffle.partitions", "2")
               .config("spark.default.parallelism", "2")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.enabled", "false")
               .config("spark.sql.maxMetadataStringLength", "2000")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return session


def day(offset: int, start: str = "2020-01-01") -> dt.date:
    return dt.date.fromisoformat(start) + dt.timedelta(days=offset)


POS_SCHEMA = ("salesday date, store_cd int, uid bigint, jan bigint, salescnt double, "
              "salesamount double, name string, lv3_nm string, lv4_nm string, lv5_nm string")


def sale(offset, jan=1, uid=1, amount=100.0, count=1.0, store=1, lv5="milk"):
    return (day(offset), store, uid, jan, count, amount, f"item {jan}", "lv3", "lv4", lv5)


def pos_frame(spark, rows):
    return spark.createDataFrame(rows, POS_SCHEMA)


def rows(df, *order):
    """All rows as dicts, sorted by the given columns."""
    found = [row.asDict(recursive=True) for row in df.collect()]
    return sorted(found, key=lambda row: tuple(str(row[c]) for c in order)) if order else found
