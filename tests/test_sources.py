import datetime as dt

import pytest
from conftest import day, pos_frame, rows, sale
from pyspark.sql import functions as F

from pricelane.functions.predicates import all_of, item_codes, padded_item_code, stores, where_clause
from pricelane.functions.scalars import day_text, offset_day, offset_day_text
from pricelane.operators.clean import null_profile
from pricelane.sources import masters, sinks, tables
from pricelane.sources.pos import drop_items, rejected_lines, scan_pos, store_codes, store_list

FACT = ("SALES_DATE date, STORE_CODE string, MEMBER_CODE bigint, JAN_CODE string, SALES_NUMBER int, "
        "SALES_AMOUNT int, CATEGORY_KEY int, PRODUCT_CODE int, AGE int, GENDER_FLG int")


@pytest.fixture(scope="module")
def star(spark):
    def line(d, store, member, jan, amount, category, product, age=30, sex=1):
        return (day(d), store, member, str(jan).zfill(20), 1, amount, category, product, age, sex)
    fact = spark.createDataFrame([
        line(0, "0001", 1, 11, 100, 1, 1), line(1, "0002", 2, 12, 200, 2, 1, sex=0),
        line(2, "0001", None, 11, 300, 1, 2, age=40), line(2, "0003", 1, 13, 0, 1, 1),
        line(3, "0003", 3, 13, 400, 9, 1), line(4, "0003", 3, 13, 500, 1, 9)], FACT)
    category = spark.createDataFrame(
        [(1, "dairy", "milk", "fresh"), (2, "dairy", "milk", "long life")],
        "CATEGORY_KEY int, CATEGORY1_NAME string, CATEGORY2_NAME string, CATEGORY3_NAME string")
    product = spark.createDataFrame([(1, "one"), (2, "two")], "PRODUCT_CODE int, PRODUCT_NAME string")
    return fact, category, product


def amounts(star, **filters):
    return sorted(r["salesamount"] for r in rows(scan_pos(*star, **filters)))


@pytest.mark.parametrize("filters, expected", [
    ({}, [100, 200, 300]),
    ({"dim_join": "left"}, [100, 200, 300, 400, 500]),
    ({"salesday": "2020-01-02"}, [200]),
    ({"salesday": ("2020-01-02", "2020-01-03")}, [200, 300]),
    ({"salesday": (dt.date(2020, 1, 1), dt.date(2020, 1, 2))}, [100, 200]),
    ({"storecd": "0001"}, [100, 300]),
    ({"storecd": ["0001", "0002"]}, [100, 200, 300]),
    ({"storecd": ("0002",)}, [200]),
    ({"uid": 1}, [100]),
    ({"jan": 11}, [100, 300]),
    ({"jan": "12"}, [200]),
    ({"jan": [11, "12", 99]}, [100, 200, 300]),
    ({"lv3_nm": "dairy", "lv4_nm": "milk", "lv5_nm": "fresh"}, [100, 300]),
    ({"name": "two"}, [300]),
    ({"age": 40}, [300]),
    ({"sex": 0}, [200]),
    ({"uid": 3, "dim_join": "left"}, [400, 500]),
    ({"limit": 2}, [100, 200]),
])
def test_scan(star, filters, expected):
    assert amounts(star, **filters) == expected


def test_scan_layout(star):
    found = scan_pos(*star, limit=1)
    assert dict(found.dtypes) == {
        "salesday": "date", "store_cd": "int", "uid": "bigint", "jan": "bigint", "salescnt": "double",
        "salesamount": "double", "name": "string", "lv3_nm": "string", "lv4_nm": "string",
        "lv5_nm": "string"}
    assert rows(found)[0]["store_cd"] == 1 and rows(found)[0]["jan"] == 11
    with pytest.raises(ValueError):
        scan_pos(*star, dim_join="full")


def test_predicates(spark):
    df = spark.createDataFrame([(1, "a", 1.5), (2, "b", 2.5), (3, "o'c", None)], "i int, s string, d double")
    ids = lambda **values: [r["i"] for r in rows(df.where(where_clause(values)), "i")]
    assert ids(i=None) == [1, 2, 3] and ids() == [1, 2, 3]
    assert ids(i=2) == [2] and ids(s="o'c") == [3] and ids(i=[1, 3]) == [1, 3]
    assert ids(d=(1.0, 2.0)) == [1] and ids(s=("a", "b"), i=2) == [2]
    assert padded_item_code(7) == "7".zfill(20)
    with pytest.raises(ValueError):
        padded_item_code("1" * 21)
    assert item_codes(F.col("s"), None) is None and stores(F.col("i"), None) is None
    assert df.where(all_of()).count() == 3


def test_dates(spark):
    assert offset_day("2024-02-28", 2) == "2024-03-01" and offset_day("2024-01-01", -1) == "2023-12-31"
    with pytest.raises(TypeError):
        offset_day(dt.date(2024, 1, 1), 1)
    df = spark.createDataFrame([("2024-02-28", 86_400 * 3, "x", 1.5e9)],
                               "day string, seconds bigint, text string, real double")
    found = df.select(offset_day_text(F.col("day"), 2).alias("a"), day_text(df, "seconds").alias("b"),
                      day_text(df, "text").alias("c"), day_text(df, "real").alias("d")).first()
    assert tuple(found) == ("2024-03-01", "1970-01-04", "x", "2017-07-14")


def test_stores_and_drop_list(spark):
    store = spark.createDataFrame([("north", 1), ("south", 2), ("north", 1)],
                                  "STORE_NAME string, STORE_CODE int")
    assert store_list(store).count() == 2
    names = spark.createDataFrame([("south",), ("west",)], "STORE_NAME string")
    assert [r["STORE_CODE"] for r in rows(store_codes(store, names))] == [2]
    items = spark.createDataFrame([(1,), (2,), (3,)], "jan bigint")
    dropped = spark.createDataFrame([(2,), (9,)], "jan bigint")
    assert [r["jan"] for r in rows(drop_items(items, dropped), "jan")] == [1, 3]
    assert drop_items(items, dropped.where("jan < 0")).count() == 3


def test_masters(spark, tmp_path):
    def file(name, text):
        path = tmp_path / name
        path.write_text(text, encoding="utf-8")
        return str(path)

    packs = masters.read_pack_master(spark, file("p.csv", "﻿jan,det_val,note\n4901,750,x\n4902,,y\n"))
    assert rows(packs, "jan") == [{"jan": 4901, "det_val": 750.0}, {"jan": 4902, "det_val": None}]
    items = masters.read_item_master(
        spark, file("i.csv", "name,jan,max_dprice,oprice\n牛乳,1,50,100.5\n"))
    assert rows(items) == [{"jan": 1, "name": "牛乳", "oprice": 100.5, "max_dprice": 50.0}]
    assert masters.read_drop_list(spark, file("d.csv", "jan\n")).count() == 0
    series = masters.read_series_master(spark, file("s.csv", "jan\n1\n"))
    assert rows(series) == [{"jan": 1, "series": None}]
    for path in (file("empty.csv", ""), str(tmp_path / "missing.csv")):
        found = masters.read_series_master(spark, path)
        assert found.columns == ["jan", "series"] and found.count() == 0
    bad = file("bad.csv", 'jan,det_val\n1,5\nX3,1\n"4,901",2\n2,much\n,7\n')
    for reader in (masters.read_pack_master, masters.read_drop_list):
        with pytest.raises(ValueError, match="rows are rejected"):
            reader(spark, bad)
    assert rows(masters.read_pack_master(spark, bad, max_rejected=0.9)) == [{"jan": 1, "det_val": 5.0}]
    rejects = masters.parse_master(spark.read.csv(bad, header=True), masters.PACK_MASTER).rejects
    assert sorted((str(r["jan"]), r["reason"]) for r in rows(rejects)) == [
        ("2", "unreadable det_val"), ("4,901", "unreadable jan"), ("None", "no jan"), ("X3", "unreadable jan")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        masters.read_item_master(spark, str(tmp_path / "missing.csv"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(7, 1, "a"), (12345, 2, "é")], "store_cd int, jan bigint, name string")
    out = tmp_path / "result"
    for _ in range(2):     # the second run replaces the first
        sinks.write_by_store(df, str(out))
    assert sorted(p.name for p in out.iterdir() if p.is_dir()) == ["store=0007", "store=12345"]
    text = next((out / "store=12345").glob("*.csv")).read_text(encoding="utf-8")
    assert text == "store_cd,jan,name\n12345,2,é\n"
    sinks.write_by_store(df, str(tmp_path / "parquet"), "parquet")
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 2
    two = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (1, 2, "b")], df.schema)
    sinks.write_by_store(two, str(tmp_path / "sorted"), order=("jan",))
    text = next((tmp_path / "sorted" / "store=0001").glob("*.csv")).read_text()
    assert text.split() == ["store_cd,jan,name", "1,1,a", "1,2,b", "1,3,c"]
    sinks.write_samples(pos_frame(spark, [sale(0)]).select("salesday", "jan"), str(tmp_path / "base"))
    assert spark.read.csv(str(tmp_path / "base"), header=True).first()["salesday"] == "2020-01-01"


def test_other_batches_stay(spark, tmp_path):
    schema = "store_cd int, jan bigint, name string, units double"
    out = str(tmp_path / "result")
    batches = [[(1, 1, "a", 0.1), (1, 2, None, 2.0), (2, 1, "b", 3.0)], [(3, 1, "c", 4.0)], [(2, 5, "again", 5.5)]]
    for batch in batches:
        assert sinks.write_batch(spark.createDataFrame(batch, schema), out) == sorted({r[0] for r in batch})
    df = spark.createDataFrame(batches[0], schema)
    found = rows(sinks.read_by_store(spark, out, df.schema).drop("store"), "store_cd", "jan")
    assert [tuple(r.values()) for r in found] == [*batches[0][:2], *batches[2], *batches[1]]
    listed = {r["store_cd"]: r["rows"] for r in rows(sinks.manifest(spark, out))}
    assert listed == {1: 2, 2: 1, 3: 1}
    assert sorted(r["store_cd"] for r in rows(sinks.finished_stores(spark, out, df.schema))) == [1, 2, 3]


def test_a_batch_that_was_cut_short_is_not_finished(spark, tmp_path):
    schema = "store_cd int, jan bigint"
    out = str(tmp_path / "result")
    empty = spark.createDataFrame([], schema)
    assert sinks.finished_stores(spark, out, empty.schema).count() == 0
    sinks.write_batch(spark.createDataFrame([(s, j) for s in (1, 2) for j in range(5)], schema), out)
    # new rows of a store and a new store, whose run ended before the manifest
    sinks.write_by_store(spark.createDataFrame([(2, 9), (3, 1)], schema), out)
    assert [r["store_cd"] for r in rows(sinks.finished_stores(spark, out, empty.schema))] == [1]
    rerun = spark.createDataFrame([(2, 9), (3, 1)], schema)
    sinks.write_batch(rerun.join(sinks.finished_stores(spark, out, empty.schema), "store_cd", "left_anti"), out)
    assert sorted(r["store_cd"] for r in rows(sinks.finished_stores(spark, out, empty.schema))) == [1, 2, 3]


def test_files_follow_each_other_in_reading_order(spark, tmp_path):
    made = [(s, f"g{i % 3}", f"c{i % 7}", i, i) for s in (1, 2) for i in range(400)]
    df = spark.createDataFrame(made, "store_cd int, lv4_nm string, lv5_nm string, rank int, jan int").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_by_store(df, str(tmp_path / "out"), "parquet", order=sinks.ITEM_ORDER)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert any(len(list((tmp_path / "out" / f"store=000{s}").glob("*.parquet"))) > 1 for s in (1, 2))
    found = rows(sinks.reading_places(sinks.read_by_store(spark, str(tmp_path / "out"), df.schema, "parquet"), df.columns))
    for store in (1, 2):
        own = sorted((r for r in found if r["store_cd"] == store), key=lambda r: r["place"])
        keys = [(r["lv4_nm"], r["lv5_nm"], r["rank"]) for r in own]
        assert len(keys) == 400 and keys == sorted(keys)


def test_a_master_file_is_read_once(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("jan,det_val\n1,5\n2,6\nX,7\n")
    kept = masters.read_pack_master(spark, str(path), max_rejected=0.5)
    path.unlink()  # rows and their check come from one read
    assert rows(kept, "jan") == [{"jan": 1, "det_val": 5.0}, {"jan": 2, "det_val": 6.0}]
    assert "FileScan csv" not in kept._jdf.queryExecution().executedPlan().toString()
    with tables.Workspace(spark, persist=True) as work:
        path.write_text("jan,det_val\n1,5\nX,7\n")
        with pytest.raises(ValueError, match="1 rows are rejected"):
            masters.read_pack_master(spark, str(path), max_rejected=0.4, work=work)
        assert masters.read_pack_master(spark, str(path), max_rejected=0.5, work=work).count() == 1


def test_clustered_tables(spark, tmp_path):
    df = spark.range(300).selectExpr("id % 7 AS a", "id % 11 AS b", "id AS c")
    with tables.Workspace(spark, str(tmp_path / "own")) as work:
        kept = work.keep_clustered(df, "days", ["a", "b"], 4)
        assert sorted(rows(kept), key=str) == sorted(rows(df), key=str)
        plan = kept.groupBy("a", "b", "c").count()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        names = [t.name for t in spark.catalog.listTables() if t.name.startswith("days_")]
        assert len(names) == 1
    assert not [t for t in spark.catalog.listTables() if t.name in names]


def test_flagged_rows(spark, tmp_path):
    df = spark.createDataFrame([("true", 1), ("False", 2), ("TRUE", 3), (None, 4)], "flag string, i int")
    assert [r["i"] for r in rows(sinks.flagged_rows(df, "flag"), "i")] == [1, 3]
    boolean = df.withColumn("flag", F.col("flag").cast("boolean"))
    assert sinks.flagged_rows(boolean, "flag").columns == ["i"]
    sinks.write_flagged(df, "flag", str(tmp_path / "flagged"))
    assert spark.read.csv(str(tmp_path / "flagged"), header=True).count() == 2


def test_null_profile(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (None, None)], "i int, s string")
    assert rows(null_profile(df), "column") == [
        {"column": "i", "total_rows": 3, "null_count": 1, "null_ratio": 1 / 3},
        {"column": "s", "total_rows": 3, "null_count": 2, "null_ratio": 2 / 3}]
    assert rows(null_profile(df.where("i > 9")))[0]["null_ratio"] == 0.0


def test_workspace(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    with tables.Workspace(spark) as work:
        kept = work.keep(df, "kept")
        assert kept.schema == df.schema and rows(kept) == rows(df)
        folder = spark.conf.get("spark.checkpoint.dir")
        assert kept.inputFiles()[0].replace("file://", "").startswith(folder)
    assert not list((tmp_path.parent).glob("**/kept-*"))
    with tables.Workspace(spark, str(tmp_path / "own")) as work:
        work.keep(df, "kept")
        assert list((tmp_path / "own").glob("pricelane/*/kept-1/*.parquet"))
    assert not list((tmp_path / "own").glob("pricelane/*/*"))
    with tables.Workspace(spark, persist=True) as work:
        assert work.keep(df, "kept").storageLevel.useMemory
    assert not df.storageLevel.useMemory


def test_codes_and_amounts_that_do_not_fit(star):
    fact, category, product = star
    odd = fact.limit(3).withColumn("JAN_CODE", F.lit("A17")).unionByName(
        fact.limit(1).withColumn("STORE_CODE", F.lit(None).cast(fact.schema["STORE_CODE"].dataType)))
    both = fact.unionByName(odd)
    assert scan_pos(both, category, product).count() == scan_pos(fact, category, product).count() + \
        scan_pos(fact.limit(1), category, product).count()
    assert rejected_lines(both).count() == odd.where("JAN_CODE = 'A17'").count()
    large = fact.withColumn("SALES_AMOUNT", F.lit(16_777_217))
    assert {r["salesamount"] for r in rows(scan_pos(large, category, product))} == {16_777_217.0}
    assert {r["salesamount"] for r in rows(scan_pos(large, category, product, single_precision=True))} == {16_777_216.0}


def test_tables_are_read_in_parts(spark, tmp_path):
    parts = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    with tables.Workspace(spark, str(tmp_path)) as work:
        for pieces in (1, 40):  # one large file, many small ones
            df = spark.range(20_000).select("id", F.xxhash64("id").alias("other")).repartition(pieces)
            kept = work.keep_in_parts(df, "rows", 1000)
            assert sorted(r["id"] for r in kept.collect()) == list(range(20_000)) and kept.dtypes == df.dtypes
            assert max(parts(kept)) <= 2000 and len(parts(kept)) <= 40
        assert work.keep_in_parts(df.limit(0), "none", 1000).count() == 0
    assert not list(tmp_path.glob("pricelane/*/*"))
    with tables.Workspace(spark, persist=True) as work:
        assert work.keep_in_parts(df, "rows", 1000).count() == 20_000
