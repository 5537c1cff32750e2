from collections import defaultdict

from cases import ODD, lowered, no_documents, odd_documents
from conftest import rows
from pyspark.sql import functions as F

from pricelane.llm import exact_dedup


def groups():
    found = defaultdict(list)
    for i, text in ODD:
        found[lowered(text)].append(i)
    return found


def test_odd_rows(spark):
    found = rows(exact_dedup.exact_duplicates(odd_documents(spark)))
    assert len(found) == len(ODD)
    by_text = defaultdict(list)
    for r in found:
        by_text[r["text_sha256"]].append(r)
    expected = {tuple(sorted(map(str, ids))): max((i for i in ids if i is not None), default=None)
                for ids in groups().values()}
    for group in by_text.values():
        assert sum(r["kept"] for r in group) == 1
        keep = expected[tuple(sorted(str(r["doc_id"]) for r in group))]
        assert {r["keep_id"] for r in group} == {keep} and {r["group_size"] for r in group} == {len(group)}
        assert next(r for r in group if r["kept"])["doc_id"] == keep


def test_smallest_stays(spark):
    found = rows(exact_dedup.exact_duplicates(odd_documents(spark), keep="min"), "doc_id")
    assert {r["keep_id"] for r in found if r["doc_id"] in (1, 2)} == {1}


def test_rows_that_stay(spark):
    docs = odd_documents(spark)
    kept = exact_dedup.without_duplicates(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(groups())
    assert exact_dedup.without_duplicates(no_documents(spark)).count() == 0
    assert exact_dedup.exact_duplicates(no_documents(spark)).count() == 0


def test_hot_text_over_many_places(spark):
    docs = spark.range(0, 5000, 1, 40).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Hot").otherwise(F.col("id").cast("string")).alias("text"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        found = rows(exact_dedup.exact_duplicates(docs).filter("group_size > 1"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found) == 1667 and {r["keep_id"] for r in found} == {4998}
    assert [r["doc_id"] for r in found if r["kept"]] == [4998]
