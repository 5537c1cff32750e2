"""Shapes of physical plans that matter at scale."""

import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from checks import spark_queries, views
from checks.views import PREDICTION_KEYS
from pricelane.functions import hot
from pricelane.operators import cases, clean, features, probability, sampling
from pricelane.sources.pos import scan_pos
from pricelane.sources.tables import Workspace


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def single_task_windows(text: str) -> list[str]:
    """Windows whose specification starts with an ordering, that is, without partition columns."""
    return [line for line in text.splitlines()
            if re.search(r"windowspecdefinition\([^,()]+ (ASC|DESC)", line)]


LAZY = ["pos_scan", "price_periods", "cases_up", "cases_up_lead_first", "cases_zero",
        "case_master_up", "target_cases", "kani_top_sales", "price_grid", "prob_pivot", "clamp_prob",
        "monotone_prob", "simulate_long", "best_item_price", "series_price_cap",
        "best_customer_price", "oversample", "oversample_weights", "median_fill"]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_no_python_and_no_single_task_window(spark, name):
    text = plan(spark_queries.QUERIES[name](spark, SMALL))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
                     "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert operator not in text
    assert not single_task_windows(text)


def test_features_have_neither(spark):
    pos = views.pos(spark, SMALL)
    days = clean.member_days(pos, views.CFG)
    base = sampling.sample_customers(cases.case_master(pos, "up", views.CFG), days, views.CFG)
    text = plan(features.add_features(base, days, views.packs(spark, SMALL), views.CFG))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"):
        assert operator not in text
    assert not single_task_windows(text)


def test_global_ranks_sort_only_value_buckets_together(spark):
    days = clean.member_days(views.pos(spark, SMALL), views.CFG)
    base = sampling.sample_customers(
        cases.case_master(views.receipts(spark, SMALL), "up", views.CFG), days, views.CFG)
    text = plan(features.rfm_features(base, days, views.CFG, "global"))
    windows = [line for line in text.splitlines() if "Window [" in line]
    assert windows and all("percent_rank" not in line for line in windows)
    # one task only adds up value buckets or days; amounts are added up per bucket
    assert all("_bucket" in line for line in single_task_windows(text))
    assert any(re.search(r"windowspecdefinition\(_measure#\d+, _bucket#\d+, _value", line) for line in windows)


def test_scan_prunes_columns_and_pushes_filters(spark, tmp_path):
    fact, category, product = views.star(spark, SMALL)
    fact.write.parquet(str(tmp_path / "fact"))
    stored = spark.read.parquet(str(tmp_path / "fact"))
    df = scan_pos(stored, category, product, salesday=("1997-01-01", "1997-03-31"), storecd=[1, 2])
    text = plan(df.select("salesday", "store_cd", "salesamount"))
    scan = next(line for line in text.splitlines() if "FileScan" in line and "SALES_DATE" in line)
    assert "GreaterThanOrEqual(SALES_DATE,1997-01-01)" in scan and "In(STORE_CODE, [1,2])" in scan
    assert "MEMBER_CODE" not in scan.split("ReadSchema")[1]


def test_sampling_joins_on_the_time_slot(spark):
    days = clean.member_days(views.pos(spark, SMALL), views.CFG)
    base = sampling.sample_customers(
        cases.case_master(views.receipts(spark, SMALL), "up", views.CFG), days, views.CFG)
    joins = [line for line in plan(base).splitlines() if "_slot" in line and "Join [" in line]
    assert any("_slice" in line for line in joins)


@pytest.fixture
def stored(spark, tmp_path):
    """Customer days and a sample as tables."""
    clean.member_days(views.pos(spark, SMALL), views.CFG).write.parquet(str(tmp_path / "days"))
    days = spark.read.parquet(str(tmp_path / "days"))
    found = cases.case_master(views.receipts(spark, SMALL), "up", views.CFG)
    sampling.sample_customers(found, days, views.CFG).write.parquet(str(tmp_path / "base"))
    return spark.read.parquet(str(tmp_path / "base")), days


def scans(df, name: str) -> int:
    """Reads of the table `name` in the plan that has run."""
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    return sum("FileScan" in line and f"/{name}" in line for line in final.splitlines())


def test_all_features_read_the_days_a_few_times(spark, stored):
    base, days = stored
    with Workspace(spark) as work:
        df = features.add_features(base, days, views.packs(spark, SMALL), views.CFG, work=work)
        assert scans(df, "days") == 0 and work.tables == 2  # only the two kept tables come from the days
        final = df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
        exchanges = len(re.findall(r"(?<!Reused)(?<!Broadcast)Exchange (hash|range|single)", final))
        assert 0 < exchanges <= 30
    # the kept tables: who bought, and what they bought; what was sold
    members = features.case_buyers(features._cases_of(base), days, views.CFG)
    assert scans(features.member_baskets(members, days, views.CFG), "days") <= 2 + 1
    assert scans(features.item_days(days), "days") == 1


def test_all_ranks_of_a_scope_are_one_join(spark, stored):
    base, days = stored
    with Workspace(spark) as work:
        baskets = work.keep(features.member_baskets(base, days, views.CFG), "baskets")
        levels = plan(features.rfm_level_features(base, days, views.CFG, baskets=baskets))
        plain = plan(features.rfm_features(base, days, views.CFG, baskets=baskets))
    for text in (levels, plain):
        ranked = [line for line in text.splitlines() if "Join [" in line and "_measure" in line and "_value" in line]
        assert len(ranked) == 1
    # six ranks need no more shuffles than three, but for the second level of purchases
    count = lambda text: len(re.findall(r"Exchange (hash|range|single)", text))
    assert count(levels) <= count(plain) + 3


def test_clustered_days_are_not_shuffled(spark, stored):
    base, days = stored
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the windows were too many to send to all
    try:
        with Workspace(spark) as work:
            kept = work.keep_clustered(days, "days", ["store_cd", "uid"], 4)
            df = features.member_baskets(base, kept, views.CFG, clustered=True)
            text = plan(df)
            exchanges = [line for line in text.splitlines() if re.search(r"Exchange (hash|range|single)", line)]
            # the distinct windows are dealt like the days; days and baskets stay where they are
            assert 0 < len(exchanges) <= 2 and all("astart" in line or "uid" in line for line in exchanges)
            assert "SortMergeJoin" in text and "Bucketed: true" in text
            plain = features.member_baskets(base, days, views.CFG)
            assert sorted(map(str, df.select(*sorted(df.columns)).collect())) == \
                sorted(map(str, plain.select(*sorted(plain.columns)).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("most", [500_000, 0])
def test_samples_and_features_stay_where_their_members_lie(spark, stored, monkeypatch, most):
    """Of samples in buckets by store and member nothing but totals and ranks is shuffled, with the same results."""
    from pricelane.functions import ranks

    monkeypatch.setattr(ranks, "RANKS_IN_MEMORY", most)
    _, days = stored
    cut = spark_queries._cases(spark, SMALL)
    count = lambda df: len(re.findall(r"(?<!Reused)(?<!Broadcast)Exchange (hash|range|single)", final_plan(df)))
    with Workspace(spark) as work:
        kept = work.keep_clustered(days, "days", ["store_cd", "uid"], 4)
        sample = sampling.sample_customers(cut, kept, views.CFG, "case", True)
        plain = sampling.sample_customers(cut, days, views.CFG, "case")
        text = plan(sample)
        assert "salesamount" not in " ".join(x for x in text.splitlines() if re.search(r"Exchange (hash|range|single)", x))
        assert sorted(map(str, sample.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
        base = work.keep_clustered(sample, "base", ["store_cd", "uid"], 4)
        found = features.add_customer_features(base, kept, views.packs(spark, SMALL), views.CFG, work=work, clustered=4)
        found.collect()
        assert most == 0 or count(found) == 0  # before: every level of features shuffled the sample once
        wanted = features.add_customer_features(work.keep(plain, "base"), days, views.packs(spark, SMALL), views.CFG, work=work)
        assert sorted(found.dtypes) == sorted(wanted.dtypes) and found.count() == plain.count() > 0
        doubles = {c: F.round(c, 9) + 0.0 for c, kind in wanted.dtypes if kind == "double"}
        assert sorted(map(str, found.select(*wanted.columns).withColumns(doubles).collect())) == \
            sorted(map(str, wanted.withColumns(doubles).collect()))


def dealt(df):
    """Numbers of parts that rows are dealt into by a stated number, in the plan that ran."""
    df.collect()
    return [int(n) for n in re.findall(r"hashpartitioning\([^\n]*, (\d+)\), REPARTITION_BY_NUM", final_plan(df))]


def final_plan(df):
    return plan(df).split("+- == Initial Plan ==")[0]


@pytest.fixture
def few_rows(monkeypatch):
    """As if a task could hold few rows."""
    monkeypatch.setattr(hot, "ROWS_PER_TASK", 100)
    monkeypatch.setattr(views, "LINES_PER_TASK", 100)


def test_parts_grow_with_the_rows(spark, few_rows):
    assert [hot.parts(spark.range(n)) for n in (0, 1000, 1001)] == [spark.sparkContext.defaultParallelism, 10, 11]


def test_windows_and_baskets_are_not_broadcast(spark, stored, few_rows):
    """Windows grow with the members, so they meet the days in as many parts as there are rows for."""
    base, days = stored
    df = features.member_baskets(base, days, views.CFG)
    assert "BroadcastHashJoin" not in plan(df)
    assert dealt(df) and set(dealt(df)) == {hot.parts(days)}
    with Workspace(spark) as work:
        baskets = features._kept_baskets(work, df)
        packs = views.packs(spark, SMALL)
        for found in (features.rfm_features(base, days, views.CFG, baskets=baskets),
                      features.rfm_level_features(base, days, views.CFG, baskets=baskets),
                      features.loyalty_features(base, days, views.CFG, baskets=baskets),
                      features.price_sensitivity_features(base, days, packs, views.CFG, baskets=baskets)):
            joins = [line for line in plan(found).splitlines()
                     if re.search(r"(Hash|Merge)Join \[[^\]]*uid", line)]
            assert joins and all("SortMergeJoin" in line for line in joins)


def test_days_are_added_up_once(spark):
    """Dealt lines are added up where they are dealt to: no table per piece of the input, and the same days."""
    lines = views.pos(spark, SMALL)
    df, before = clean.member_days(lines, views.CFG, parts=7), clean.member_days(lines, views.CFG)
    assert dealt(df) == [7] and sorted(df.collect()) == sorted(before.collect())
    text = final_plan(df)
    assert text.index("HashAggregate(keys=[store_cd") < text.rindex("HashAggregate(keys=[store_cd") < text.index("REPARTITION_BY_NUM")


def test_grids_are_gathered_where_their_sales_are(spark, few_rows):
    for view, keys in ((views.predictions, PREDICTION_KEYS), (views.predictions_many, PREDICTION_KEYS)):
        df = probability.grid_from_long(view(spark, SMALL), keys)
        assert dealt(df) == [views.parts(spark, SMALL)]
        assert len(re.findall(r"(?<!Broadcast)Exchange hash", final_plan(df))) == 1
