"""The point-of-sale star: receipt lines with their category and product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelane.functions.predicates import all_of, item_codes, matches, stores


def scan_pos(fact: DataFrame, category: DataFrame, product: DataFrame, *,
             salesday=None, storecd=None, uid=None, jan=None, lv3_nm=None, lv4_nm=None,
             lv5_nm=None, name=None, age=None, sex=None, limit: int | None = None,
             dim_join: str = "inner", single_precision: bool = False) -> DataFrame:
    """Lines with a positive amount in the canonical layout (`schema.POS`).

    Lines whose item or store code is no number are left out; `rejected_lines` returns them. With
    `single_precision` amounts and units are rounded to 32-bit floats, which not all whole amounts
    above 16,777,216 survive.

    A day or (first, last), a store or several, a member, an item code or a list of them, category
    and product names, age and gender narrow the scan. `dim_join="left"` keeps lines whose category
    or product is unknown. `limit` returns the first lines by day and store, which is the only case
    that sorts.
    """
    if dim_join not in ("inner", "left"):
        raise ValueError(f"unknown join type {dim_join!r}")
    number = (lambda c: F.col(c).cast("float").cast("double")) if single_precision else \
        (lambda c: F.col(c).cast("double"))
    lines = fact.where(all_of(
        F.col("SALES_AMOUNT") > 0,
        ~_unreadable(),
        matches(F.col("SALES_DATE"), salesday),
        stores(F.col("STORE_CODE"), storecd),
        matches(F.col("MEMBER_CODE"), uid),
        item_codes(F.col("JAN_CODE"), jan),
        matches(F.col("AGE"), age) if age is not None else None,
        matches(F.col("GENDER_FLG"), sex) if sex is not None else None))
    joined = (lines
              .join(category.select("CATEGORY_KEY", "CATEGORY1_NAME", "CATEGORY2_NAME",
                                    "CATEGORY3_NAME"), "CATEGORY_KEY", dim_join)
              .join(product.select("PRODUCT_CODE", "PRODUCT_NAME"), "PRODUCT_CODE", dim_join)
              .where(all_of(matches(F.col("CATEGORY1_NAME"), lv3_nm),
                            matches(F.col("CATEGORY2_NAME"), lv4_nm),
                            matches(F.col("CATEGORY3_NAME"), lv5_nm),
                            matches(F.col("PRODUCT_NAME"), name))))
    out = joined.select(
        F.to_date("SALES_DATE").alias("salesday"),
        F.col("STORE_CODE").try_cast("int").alias("store_cd"),
        F.col("MEMBER_CODE").alias("uid"),
        F.col("JAN_CODE").try_cast("bigint").alias("jan"),
        number("SALES_NUMBER").alias("salescnt"),
        number("SALES_AMOUNT").alias("salesamount"),
        F.col("PRODUCT_NAME").alias("name"),
        F.col("CATEGORY1_NAME").alias("lv3_nm"),
        F.col("CATEGORY2_NAME").alias("lv4_nm"),
        F.col("CATEGORY3_NAME").alias("lv5_nm"))
    if limit is None:
        return out
    # the remaining columns only make the choice among equal days and stores repeatable
    return out.orderBy("salesday", "store_cd", "jan", "uid", "salescnt", "salesamount").limit(limit)


def _unreadable() -> Column:
    """A code is there but no number. A missing code is left as NULL."""
    bad = [F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull()
           for c, kind in (("JAN_CODE", "bigint"), ("STORE_CODE", "int"))]
    return bad[0] | bad[1]


def rejected_lines(fact: DataFrame) -> DataFrame:
    """Lines that `scan_pos` leaves out because their item or store code cannot be read."""
    return fact.where(_unreadable())


def store_list(store: DataFrame) -> DataFrame:
    return store.select("STORE_NAME", "STORE_CODE").distinct()


def store_codes(store: DataFrame, names: DataFrame) -> DataFrame:
    """Stores whose name is among the requested ones (`names` has a STORE_NAME column)."""
    return store_list(store).join(names.select("STORE_NAME"), "STORE_NAME", "left_semi")


def drop_items(items: DataFrame, dropped: DataFrame) -> DataFrame:
    return items.join(dropped.select("jan"), "jan", "left_anti")
