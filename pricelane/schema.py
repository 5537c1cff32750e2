"""Schemas and key lists shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# One row per receipt line of a member or guest.
POS = T.StructType([
    T.StructField("salesday", T.DateType()),
    T.StructField("store_cd", T.IntegerType()),
    T.StructField("uid", T.LongType()),
    T.StructField("jan", T.LongType()),
    T.StructField("salescnt", T.DoubleType()),
    T.StructField("salesamount", T.DoubleType()),
    T.StructField("name", T.StringType()),
    T.StructField("lv3_nm", T.StringType()),
    T.StructField("lv4_nm", T.StringType()),
    T.StructField("lv5_nm", T.StringType()),
])

PACK_MASTER = T.StructType([
    T.StructField("jan", T.LongType()),
    T.StructField("det_val", T.DoubleType()),
])

SERIES_MASTER = T.StructType([
    T.StructField("jan", T.LongType()),
    T.StructField("series", T.StringType()),
])

ITEM_MASTER = T.StructType([
    T.StructField("jan", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("oprice", T.DoubleType()),
    T.StructField("max_dprice", T.DoubleType()),
])

DROP_LIST = T.StructType([T.StructField("jan", T.LongType())])

#: The category of sales whose category is not known, so that keys are never NULL.
NO_CATEGORY = "(none)"

# Column names, keys and the inputs of the two models.
CATEGORY = ["store_cd", "lv4_nm", "lv5_nm"]
ITEM = [*CATEGORY, "jan"]
CASE = [*ITEM, "pprice", "aprice", "astart"]
PREDICTION_KEY = [*ITEM, "astart", "pprice", "uid", "sample_amt_jan"]

ITEM_FEATURES = [
    "dprice", "dprice_pct", "rscore", "fscore", "mscore", "rfm_score", "rfm_score2",
    "jan_loy_m", "jan_loy_f", "jan_loy",
    "pscore_item", "pscore_ucate", "pscore_ucate_dis050",
    "kani_score", "kani_score_dis025",
]
CATEGORY_FEATURES = [
    "pprice", "aprice", "dprice", "dprice_pct",
    "unitp_cate", "pscore_ucate", "unitp_uid", "pscore_ucate_dis050",
    "f_lv5", "m_lv5", "jan_loy_m", "jan_loy_f", "jan_loy",
    "kani_score", "kani_score_dis025",
]
