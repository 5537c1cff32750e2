"""One query per operator over the driver's tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from checks import views
from checks.views import CFG, PREDICTION_KEYS, UPDAY
from pricelane.functions.medians import median_row
from pricelane.functions.predicates import where_clause
from pricelane.functions.scalars import day_text, offset_day_text
from pricelane.operators import cases, clean, features, forest, models, periods, probability, sampling, simulate
from pricelane.plans import pipelines
from pricelane.schema import CASE, CATEGORY_FEATURES, ITEM_FEATURES, ITEM_MASTER, PREDICTION_KEY
from pricelane.sources import pos as pos_source
from pricelane.sources import masters, sinks
from pricelane.sources.masters import parse_master
from pricelane.sources.pos import rejected_lines
from pricelane.sources.tables import session_workspace


_MADE: dict[tuple, object] = {}


def _once(spark, sf, name, build):
    """What `build` returns, made once per session and folder for all queries that need it."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _MADE:
        _MADE[key] = build()
    return _MADE[key]


def _kept(spark, sf, name, build) -> DataFrame:
    """A table that several queries start from, written once."""
    return _once(spark, sf, name, lambda: session_workspace(spark).keep(build(), name))


def _folder(spark) -> str:
    """A new folder for files that a query writes and reads back."""
    shared = session_workspace(spark).path
    if shared is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared}/files-{uuid4().hex}"


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    """Sums of fractions rounded, because engines add in another order. All other doubles come from
    whole numbers by the same operations and need no rounding."""
    return df.withColumns({c: F.round(c, places) + 0.0 for c in columns})


# -- scans -----------------------------------------------------------------------------------------

def pos_scan(spark, sf):
    return pos_source.scan_pos(*views.star(spark, sf))


def pos_scan_left(spark, sf):
    return pos_source.scan_pos(*views.star(spark, sf), dim_join="left")


def pos_filters(spark, sf):
    return pos_source.scan_pos(
        *views.star(spark, sf), salesday=("1996-01-01", "1999-12-31"), storecd=[1, 2, 3, 5, 8],
        lv3_nm="area 1")


def pos_item_filter(spark, sf):
    return pos_source.scan_pos(*views.star(spark, sf), jan=[5, "11", 13])


def pos_demographic_filter(spark, sf):
    return pos_source.scan_pos(*views.star(spark, sf), age=33, sex=1)


def pos_topk(spark, sf):
    return pos_source.scan_pos(*views.star(spark, sf), limit=100)


def predicate_builder(spark, sf):
    fact, _, _ = views.star(spark, sf)
    return fact.where(where_clause({
        "SALES_DATE": ("1997-01-01", "1998-12-31"), "STORE_CODE": [1, 4, 9], "MEMBER_CODE": None,
        "GENDER_FLG": 1})).select("SALES_DATE", "STORE_CODE", "MEMBER_CODE", "JAN_CODE")


def pos_member_filter(spark, sf):
    return pos_source.scan_pos(*views.star(spark, sf), uid=[7, 8, 10, 11])


def pos_names_filter(spark, sf):
    return pos_source.scan_pos(*views.star(spark, sf), lv4_nm="group 1", lv5_nm=["class 1", "class 5"])


def _damaged_fact(spark, sf):
    """The fact with item and store codes of which some are no numbers or too long."""
    fact, _, _ = views.star(spark, sf)
    line = F.col("PRODUCT_CODE")
    return fact.withColumns({
        "JAN_CODE": F.when(line % 11 == 0, F.concat(F.lit("A"), "JAN_CODE"))
        .when(line % 13 == 0, F.lit("98765432109876543210")).otherwise(F.col("JAN_CODE")),
        "STORE_CODE": F.when(line % 17 == 0, F.lit("north")).otherwise(F.col("STORE_CODE").cast("string"))})


def pos_scan_damaged(spark, sf):
    _, category, product = views.star(spark, sf)
    return pos_source.scan_pos(_damaged_fact(spark, sf), category, product)


def pos_scan_rejects(spark, sf):
    return rejected_lines(_damaged_fact(spark, sf)).groupBy("JAN_CODE", "STORE_CODE").agg(
        F.count(F.lit(1)).alias("lines"))


def _master_text(spark, sf):
    """An item master as text, with codes, prices and caps of which some cannot be read."""
    key = F.col("p_partkey")
    return views.table(spark, sf, "part").select(
        F.when(key % 7 == 0, F.concat(F.lit("X"), key)).when(key % 10 == 1, F.lit(" "))
        .otherwise(key.cast("string")).alias("jan"),
        F.col("p_name").alias("name"),
        F.when(key % 5 == 0, F.lit("12,5")).otherwise(F.lit(" 80.5 ")).alias("oprice"),
        F.when(key % 3 == 0, F.lit("50.0")).when(key % 3 == 1, F.lit("")).otherwise(F.lit("20")).alias("max_dprice"))


def item_master_rows(spark, sf):
    return parse_master(_master_text(spark, sf), ITEM_MASTER).rows


def item_master_rejects(spark, sf):
    return parse_master(_master_text(spark, sf), ITEM_MASTER).rejects


def _as_file(spark, text: DataFrame) -> str:
    path = _folder(spark)
    text.write.option("header", True).csv(path)
    return path


def pack_master_rows(spark, sf):
    """A pack master in CSV files, with codes and contents of which some cannot be read."""
    key = F.col("p_partkey")
    text = views.table(spark, sf, "part").select(
        F.when(key % 13 == 0, F.concat(F.lit("P"), key)).otherwise(key.cast("string")).alias("jan"), "p_brand",
        F.when(key % 4 == 0, F.lit("")).when(key % 9 == 0, F.lit("1 l")).otherwise((F.col("p_size") * 50).cast("string")).alias("det_val"))
    return masters.read_pack_master(spark, _as_file(spark, text), max_rejected=0.5)


def series_master_rows(spark, sf):
    key = F.col("p_partkey")
    text = views.table(spark, sf, "part").select(
        F.when(key % 6 != 0, F.col("p_brand")).alias("series"), F.when(key % 5 != 0, key.cast("string")).alias("jan"))
    return masters.read_series_master(spark, _as_file(spark, text), max_rejected=0.5)


def sink_by_store(spark, sf):
    """Two batches of stores written one after the other, the second with some stores of the first, as they
    are read back, with what the manifest says about each store."""
    sold = views.table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 12).cast("int").alias("store_cd"), (F.col("l_partkey") % 5).alias("jan"), "l_returnflag", "l_quantity")
    path, keys = _folder(spark), ["store_cd", "jan"]
    total = [F.sum("l_quantity").alias("units"), F.count(F.lit(1)).alias("lines")]
    first = sold.where("store_cd < 8").groupBy(*keys).agg(*total)
    second = sold.where("store_cd >= 6 AND l_returnflag = 'N'").groupBy(*keys).agg(*total)
    for batch in (first, second):
        sinks.write_batch(batch, path, order=("jan",))
    finished = sinks.finished_stores(spark, path, first.schema)
    listed = sinks.manifest(spark, path).join(finished, "store_cd", "left_semi").select("store_cd", "rows")
    return sinks.read_by_store(spark, path, first.schema).join(listed, "store_cd", "left")


def sample_dump(spark, sf):
    """The sample base written as CSV and read back."""
    base, path = _sample(spark, sf)[0], _folder(spark)
    sinks.write_samples(base, path)
    return sinks.read_samples(spark, path, base.schema)


def item_result_ordered(spark, sf):
    """Items of all stores in result files, with the place at which a reader finds them."""
    sold = views.table(spark, sf, "lineitem").groupBy(
        (F.col("l_suppkey") % 3).cast("int").alias("store_cd"), F.concat(F.lit("group "), F.col("l_partkey") % 4).alias("lv4_nm"),
        F.concat(F.lit("class "), F.col("l_partkey") % 20).alias("lv5_nm"), F.col("l_partkey").alias("jan")) \
        .agg(F.sum("l_quantity").alias("units"))
    ranked = sold.withColumn("rank", F.row_number().over(
        Window.partitionBy("store_cd", "lv4_nm", "lv5_nm").orderBy(F.desc("units"), "jan")))
    path = _folder(spark)
    sinks.write_by_store(ranked, path, "parquet", order=sinks.ITEM_ORDER)
    return sinks.reading_places(sinks.read_by_store(spark, path, ranked.schema, "parquet"), ranked.columns)


def store_list(spark, sf):
    return pos_source.store_list(views.store(spark, sf))


def store_lookup(spark, sf):
    names = views.table(spark, sf, "supplier").where("s_acctbal > 5000") \
        .select(F.col("s_name").alias("STORE_NAME"))
    return pos_source.store_codes(views.store(spark, sf), names)


def item_drop_anti(spark, sf):
    return pos_source.drop_items(views.item_master(spark, sf), views.dropped(spark, sf))


def flagged_rows(spark, sf):
    orders = views.table(spark, sf, "orders")
    flag = F.when(F.col("o_orderstatus") == "F", F.when(F.col("o_custkey") % 2 == 0, "True")
                  .otherwise("true")).otherwise("false")
    return sinks.flagged_rows(orders.select("o_orderkey", "o_custkey", flag.alias("flag")), "flag")


# -- cleaning --------------------------------------------------------------------------------------

def unit_price(spark, sf):
    return clean.price_rows(views.receipts(spark, sf))


def member_filter(spark, sf):
    return clean.member_sales(views.pos(spark, sf), guest_uid=1) \
        .groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.sum("salesamount").alias("amount"))


def noise_clip(spark, sf):
    return clean.clip_noise(clean.member_sales(views.pos(spark, sf)), CFG).select(
        "salesday", "store_cd", "uid", "jan", "price", "salescnt", "salesamount")


def noise_clip_exact(spark, sf):
    lines = views.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("salescnt"),
        F.col("l_extendedprice").alias("salesamount"))
    return clean.clip_noise(lines, CFG, "exact")


def member_days(spark, sf):
    return clean.member_days(views.pos(spark, sf), CFG)


def null_profile(spark, sf):
    return clean.null_profile(views.pos(spark, sf))


def date_offset(spark, sf):
    days = views.table(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return days.withColumn("shifted", offset_day_text(F.col("day"), -28))


def epoch_date(spark, sf):
    orders = views.table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_orderkey") * 86_399).alias("seconds"),
        F.col("o_orderstatus").alias("status"))
    return orders.select("o_orderkey", day_text(orders, "seconds").alias("day"),
                         day_text(orders, "status").alias("passed_through"))


# -- price runs and cases --------------------------------------------------------------------------

def day_price(spark, sf):
    return periods.day_price(clean.price_rows(views.receipts(spark, sf)))


def price_periods(spark, sf):
    return periods.price_periods(day_price(spark, sf))


def price_periods_many(spark, sf):
    """Runs over raw list prices, where a day holds many prices."""
    lines = views.table(spark, sf, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("salesday"),
        (F.col("l_suppkey") % 2).cast("int").alias("store_cd"), (F.col("l_partkey") % 5).alias("jan"),
        F.lit("lv4").alias("lv4_nm"), F.lit("lv5").alias("lv5_nm"),
        F.col("l_quantity").alias("salescnt"),
        (F.col("l_quantity") * (1 + F.floor(F.col("l_extendedprice") / 30_000))).alias("salesamount"))
    return periods.price_periods(periods.day_price(clean.price_rows(lines)))


def cases_up(spark, sf):
    return cases.cases_up(price_periods(spark, sf), CFG)


def cases_up_lead_first(spark, sf):
    return cases.cases_up(price_periods(spark, sf), CFG, lead_first=True)


def cases_zero(spark, sf):
    return cases.cases_zero(price_periods(spark, sf), CFG)


def cases_zero_single(spark, sf):
    return cases.cases_zero(price_periods(spark, sf), CFG, single=True)


def case_master_up(spark, sf, count=5):
    return cases.case_master(views.receipts(spark, sf, count), "up", CFG)


def case_master_zero(spark, sf):
    return cases.case_master(views.receipts(spark, sf), "zero", CFG)


def case_master_both(spark, sf):
    return cases.case_master(views.receipts(spark, sf), "both", CFG)


def case_master_period(spark, sf):
    return cases.case_master(views.receipts(spark, sf), "up", CFG, ("1997-01-01", "1999-12-31"))


def target_cases(spark, sf):
    kept = pos_source.drop_items(views.item_master(spark, sf),
                                 views.items(spark, sf).where("jan = 3"))
    return cases.target_cases(views.receipts(spark, sf), UPDAY, 10, CFG, kept)


# -- samples ---------------------------------------------------------------------------------------

def _days(spark, sf, count=5):
    """Customer days, kept because every step reads them."""
    return _kept(spark, sf, f"days-{count}", lambda: clean.member_days(views.pos(spark, sf, count), CFG, parts=views.parts(spark, sf)))


def _cases(spark, sf, count=5):
    """Cases of raised prices, kept because their size decides how sales are joined with them."""
    return _kept(spark, sf, f"cases-{count}", lambda: case_master_up(spark, sf, count))


def sample_customers(spark, sf):
    return sampling.sample_customers(_cases(spark, sf), _days(spark, sf), CFG)


def sample_customers_zero(spark, sf):
    return sampling.sample_customers(case_master_zero(spark, sf), _days(spark, sf), CFG)


def train_days(spark, sf):
    """The customer days that training on a period keeps."""
    return pipelines.training_days(views.pos(spark, sf), case_master_period(spark, sf), CFG, guest_uid=1)


def train_days_by_store(spark, sf):
    """The same with a range of days for each store, of cases that differ in time from store to store."""
    cases_ = case_master_period(spark, sf)
    late = cases_.where("store_cd = 0 OR astart > DATE '1998-06-01'")
    return pipelines.training_days(views.pos(spark, sf), late, CFG, guest_uid=1, by_store=True)


def labels_case(spark, sf):
    return sampling.sample_customers(_cases(spark, sf), _days(spark, sf), CFG, "case")


def labels_item(spark, sf):
    return sampling.sample_customers(_cases(spark, sf), _days(spark, sf), CFG, "item")


def label_ints(spark, sf):
    return models.label_ints(labels_case(spark, sf)).select(*CASE, "uid", "label_jan", "label_lv5")


# -- features --------------------------------------------------------------------------------------

KEY = [*CASE, "uid"]
RFM = ["r", "f", "m", "rscore", "fscore", "mscore", "rfm_score", "rfm_score2"]


def pack_size_category(spark, sf):
    sold = views.receipts(spark, sf).select("jan", "lv5_nm").distinct()
    return features.pack_size_category(sold.join(views.packs(spark, sf), "jan", "left"), CFG)


def pack_size_category_all(spark, sf):
    sold = views.receipts(spark, sf).select("jan", "lv5_nm").distinct()
    return features.pack_size_category(sold.join(views.packs(spark, sf), "jan", "left"), CFG,
                                       suffix_all=True)


def price_features(spark, sf):
    return features.price_features(case_master_up(spark, sf))


def _sample(spark, sf, scope="case", count=5) -> tuple[DataFrame, DataFrame]:
    """Sample base and customer days, both kept."""
    days = _days(spark, sf, count)
    base = _kept(spark, sf, f"sample-{count}",
                 lambda: sampling.sample_customers(_cases(spark, sf, count), days, CFG))
    return base, features.feature_days(base, days, CFG) if scope == "global" else days


def rfm_global(spark, sf):
    return features.rfm_features(*_sample(spark, sf, "global"), CFG, "global").select(*KEY, *RFM)


def rfm_case(spark, sf):
    return features.rfm_features(*_sample(spark, sf), CFG).select(*KEY, *RFM)


def rfm_rank_norm(spark, sf):
    return features.rfm_features(*_sample(spark, sf), CFG, form="share").select(*KEY, *RFM)


def rfm_levels(spark, sf):
    columns = [f"{c}_{level}" for level in ("jan", "lv5") for c in RFM]
    return features.rfm_level_features(*_sample(spark, sf), CFG).select(*KEY, *columns)


LOYALTY = ["m_lv5", "f_lv5", "m_jan", "f_jan", "jan_loy_m", "jan_loy_f", "jan_loy"]


def loyalty(spark, sf):
    return features.loyalty_features(*_sample(spark, sf), CFG).select(*KEY, *LOYALTY)


def loyalty_clustered(spark, sf):
    """The same from customer days in buckets by store and member."""
    base, days = _sample(spark, sf)
    kept = _once(spark, sf, "clustered", lambda: session_workspace(spark).keep_clustered(days, "loyalty_days", ["store_cd", "uid"], 8))
    baskets = features.member_baskets(base, kept, CFG, clustered=True)
    return features.loyalty_features(base, kept, CFG, baskets=baskets).select(*KEY, *LOYALTY)


def loyalty_global(spark, sf):
    return features.loyalty_features(*_sample(spark, sf, "global"), CFG, "global") \
        .select(*KEY, *LOYALTY)


PSCORE = ["plv5_nm", "unitp_item", "unitp_cate", "unitp_uid", "ndays", "pscore_item",
          "pscore_ucate", "pscore_ucate_dis050"]


def pscore(spark, sf):
    return features.price_sensitivity_features(
        *_sample(spark, sf), views.packs(spark, sf), CFG).select(*KEY, *PSCORE)


def pscore_global(spark, sf):
    return features.price_sensitivity_features(
        *_sample(spark, sf, "global"), views.packs(spark, sf), CFG, "global").select(*KEY, *PSCORE)


KANI = ["kani_score", "kani_score_dis025"]


def _kani(df):
    return rounded(df.select(*KEY, *KANI), 9, *KANI)


def kani_mean5(spark, sf):
    return _kani(features.cannibalisation_features(*_sample(spark, sf), CFG))


def kani_global(spark, sf):
    return _kani(features.cannibalisation_features(*_sample(spark, sf, "global"), CFG, "global"))


def kani_exp(spark, sf):
    return _kani(features.cannibalisation_features(*_sample(spark, sf), CFG, mean="exponential"))


def kani_mean5_many(spark, sf):
    return _kani(features.cannibalisation_features(*_sample(spark, sf, "case", views.MANY), CFG))


def kani_exp_many(spark, sf):
    return _kani(features.cannibalisation_features(*_sample(spark, sf, "case", views.MANY), CFG, mean="exponential"))


def kani_global_many(spark, sf):
    return _kani(features.cannibalisation_features(*_sample(spark, sf, "global", views.MANY), CFG, "global"))


def kani_top_sales(spark, sf):
    lines = clean.clip_noise(clean.member_sales(views.pos(spark, sf)), CFG, "exact")
    return rounded(features.top_sales_mean(lines), 6, "kani_score")


FEATURES = list(dict.fromkeys([*ITEM_FEATURES, *CATEGORY_FEATURES]))
FEATURE_COLUMNS = [*KEY, *(c for c in FEATURES if c not in KEY)]


def features_all(spark, sf):
    base, days = _sample(spark, sf)
    return rounded(features.add_features(base, days, views.packs(spark, sf), CFG)
                   .select(*FEATURE_COLUMNS), 9, *KANI)


def features_all_global(spark, sf):
    base, days = _sample(spark, sf)
    return rounded(features.add_features(base, days, views.packs(spark, sf), CFG, "global")
                   .select(*FEATURE_COLUMNS), 9, *KANI)


# -- models ----------------------------------------------------------------------------------------

def oversample(spark, sf):
    lines = views.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate",
        (10.0 * F.floor(F.sqrt("l_quantity"))).alias("dprice"))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    return models.oversample(lines, [10, 30, 50, 70], 3, keys).groupBy(*keys, "dprice").agg(
        F.count(F.lit(1)).alias("copies"))


def oversample_weights(spark, sf):
    """The same balance as weights: one row per line."""
    lines = views.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        (10.0 * F.floor(F.sqrt("l_quantity"))).alias("dprice"))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    return models.weigh(lines, [10, 30, 50, 70], 3, keys).groupBy(*keys, "dprice").agg(
        F.sum("weight").alias("copies"))


def _gappy_lines(spark, sf):
    return views.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("quantity"),
        F.when(F.col("l_linenumber") != 5, F.col("l_extendedprice")).alias("price"))


def median_fill(spark, sf):
    """Medians found and filled in by one lazy plan."""
    lines = _gappy_lines(spark, sf).drop("l_linenumber")
    return models.fill_medians(lines, median_row(lines, ["quantity", "price"]))


def median_fill_exact(spark, sf):
    lines = _gappy_lines(spark, sf)
    return models.fill_medians(lines, models.medians(lines, ["quantity", "price"]))


def forest_score(spark, sf):
    """A forest whose thresholds follow a rule over the ranges of the inputs, scored by its node table."""
    lines = views.forest_rows(spark, sf)
    ends = lines.agg(*(f(c) for c in views.FOREST_INPUTS for f in (F.min, F.max))).first()
    nodes = views.rule_nodes(spark, list(zip(ends[::2], ends[1::2])))
    made = forest.Forest.of(nodes, views.FOREST_INPUTS, {"line": 2.5})
    both = forest.forest_score(forest.forest_score(lines, made, "prob"), made, "class", hard=True)
    return rounded(both.select("l_orderkey", "l_linenumber", "prob", "class"), 9, "prob")


def _model_rows(spark, sf):
    """Lines under the names of the model inputs, some of which have gaps, and two labels."""
    inputs = list(dict.fromkeys([*ITEM_FEATURES, *CATEGORY_FEATURES]))
    values = {c: F.when((F.col("l_linenumber") + i) % 7 != 0, (F.col("l_quantity") * (i + 1) + F.col("l_partkey")) % (10 + i)
                        + F.col("l_discount")) for i, c in enumerate(inputs)}
    labels = {"label_jan": (F.col("l_quantity") > 25).cast("int"), "label_lv5": (F.col("l_partkey") % 3 == 0).cast("int")}
    return views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *(v.alias(c) for c, v in (values | labels).items()))


def model_manifest(spark, sf):
    """What is written beside a saved pair of models: inputs in order, the medians that stand for missing
    values, and the number of trees."""
    small = {"numTrees": 2, "maxDepth": 2, "seed": 1}
    fitted = models.fit_models(_model_rows(spark, sf), models.FitOptions(small, small, impute=True))
    path = _folder(spark)
    fitted.save(path)
    models.RetentionModels.load(path)
    return models.saved_manifest(spark, path)


def forest_agreement(spark, sf):
    """Per price step the predictions of trained models, and how many their node tables score otherwise."""
    trained = _trained(spark, sf)
    keys = [*CASE, "uid"]
    tables = []
    for pair in (trained.zero, trained.up):
        path = _folder(spark)
        pair.save(path)
        tables.append(models.RetentionModels.load_forests(path))
    both = [probability.grid_to_long(models.predict(trained.features_up, *m, CFG, keys))
            for m in ((trained.zero, trained.up), tables)]
    met = both[0].join(both[1].withColumnsRenamed({p: f"{p}_nodes" for p in probability.PROBS}), [*keys, "dp"])
    apart = F.greatest(*(F.abs(F.col(p) - F.col(f"{p}_nodes")) for p in probability.PROBS)) > 1e-9
    return met.groupBy("dp").agg(F.count(F.lit(1)).alias("predictions"), F.count_if(apart).alias("apart"))


def model_eval_fixed(spark, sf):
    """The measures of deterministic scores with many ties, on the rows that are held out."""
    lines = views.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", ((F.col("l_quantity") + F.col("l_partkey") % 10 < 40)).cast("int").alias("label"),
        (1 - F.floor("l_quantity") / 64).alias("prob"))
    return models.evaluate(lines.where(models.held_out(["l_orderkey", "l_linenumber"])), "label", "prob", 0.6)


def _trained(spark, sf) -> pipelines.Training:
    """Models that several queries use, trained once."""
    seeded = models.FitOptions({"seed": 1}, {"seed": 1})
    return _once(spark, sf, "trained", lambda: pipelines.train(
        views.pos(spark, sf), views.packs(spark, sf), CFG, options_zero=seeded, options_up=seeded,
        work=session_workspace(spark), parts=views.parts(spark, sf)))


def model_predict(spark, sf):
    trained = _trained(spark, sf)
    return probability.grid_to_long(models.predict(
        trained.features_up, trained.zero, trained.up, CFG, PREDICTION_KEY))


def model_eval(spark, sf):
    trained = _trained(spark, sf)
    keys = [*PREDICTION_KEY, "label_jan"]
    unseen = models.held_out([*CASE, "uid"])
    fitted = models.fit_models(trained.features_up.where(~unseen), models.FitOptions({"seed": 1}, {"seed": 1}))
    scored = probability.grid_to_wide(models.predict(
        trained.features_up.where(unseen), trained.zero, fitted, CFG, keys), CFG)
    return models.evaluate(scored, "label_jan", "prob_jan_10")


def _batch(spark, sf, zero, up) -> pipelines.Recommendation:
    pos = views.pos(spark, sf)
    return pipelines.batch_predict(
        pos, pos.select("store_cd").distinct(), views.item_master(spark, sf),
        views.dropped(spark, sf), views.packs(spark, sf), UPDAY, zero, up, CFG, work=session_workspace(spark))


def batch_predict(spark, sf):
    """The whole prediction for all stores, by forests that follow a rule."""
    return _batch(spark, sf, views.rule_models(spark, 0), views.rule_models(spark, 2)).customers


def batch_predict_grid(spark, sf):
    """The probabilities on the price grid of the same prediction."""
    found = _batch(spark, sf, views.rule_models(spark, 0), views.rule_models(spark, 2)).predictions
    return rounded(probability.grid_to_long(found), 9, *probability.PROBS)


def batch_predict_trained(spark, sf):
    trained = _trained(spark, sf)
    return _batch(spark, sf, trained.zero, trained.up).customers


# -- prices ----------------------------------------------------------------------------------------

def _grid(spark, sf):
    return probability.grid_from_long(views.predictions(spark, sf), PREDICTION_KEYS)


def _simulated(spark, sf):
    return simulate.simulate(_grid(spark, sf), views.item_master(spark, sf), CFG)


def batch_recommend(spark, sf):
    """All steps after the models, for all stores, from deterministic probabilities that fall outside
    [0, 1] and rise with the price here and there."""
    spread = views.predictions(spark, sf).withColumns({p: 1.5 * F.col(p) - 0.25 for p in probability.PROBS})
    kept = pos_source.drop_items(views.item_master(spark, sf), views.dropped(spark, sf))
    grid = probability.grid_from_long(spread.join(kept.select("jan"), "jan", "left_semi"), PREDICTION_KEYS)
    return pipelines.recommend(grid, kept, CFG, work=session_workspace(spark)).customers


def simulate_repeated_items(spark, sf):
    """An item master that holds every item three times, once with an unknown cost price."""
    items = views.item_master(spark, sf)
    more = items.withColumns({"oprice": F.col("oprice") + 9, "name": F.concat("name", F.lit(" old"))})
    gaps = items.withColumns({"oprice": F.lit(None).cast("double"), "name": F.lit(" first")})
    return simulate.simulate(_grid(spark, sf), items.unionByName(more).unionByName(gaps), CFG)


def price_grid(spark, sf):
    return probability.price_grid(case_master_up(spark, sf), CFG)


def prob_pivot(spark, sf):
    return probability.grid_to_wide(_grid(spark, sf), CFG)


def clamp_prob(spark, sf):
    spread = views.predictions(spark, sf).withColumns(
        {p: 3 * F.col(p) - 1.5 for p in probability.PROBS})
    grid = probability.grid_from_long(spread, PREDICTION_KEYS)
    return probability.grid_to_long(probability.clamp_prob(grid))


def monotone_prob(spark, sf):
    lowered = probability.grid_to_long(probability.monotone_prob(_grid(spark, sf), CFG))
    return rounded(lowered, 6, *probability.PROBS)


def simulate_long(spark, sf):
    return _simulated(spark, sf)


TOTALS = ["prof_ch", "amt_ch", "prob5_ch", "prof_chr", "amt_chr"]


def best_item_price(spark, sf):
    return rounded(simulate.best_item_price(_simulated(spark, sf), CFG), 6, *TOTALS)


def item_rank_avg(spark, sf):
    best = simulate.most_profitable(simulate.valid_item_prices(_simulated(spark, sf), CFG))
    running = simulate.rank_items(best, "running").withColumnRenamed("rank", "rank_running")
    return simulate.rank_items(running, "average").select(
        "store_cd", "jan", "rec_price", "rank_running", "rank")


def series_price_cap(spark, sf):
    return rounded(simulate.best_item_price(_simulated(spark, sf), CFG, views.series(spark, sf)),
                   6, *TOTALS)


def _simulated_many(spark, sf):
    grid = probability.grid_from_long(views.predictions_many(spark, sf), PREDICTION_KEYS)
    return simulate.simulate(grid, views.items_many(spark, sf).select("jan", "name", "oprice", "max_dprice"), CFG)


def item_rank_ties(spark, sf):
    # sums of fractions differ in their last digits, which would break the ties
    valid = simulate.valid_item_prices(_simulated_many(spark, sf), CFG)
    best = simulate.most_profitable(rounded(valid, 4, "prof_ch"))
    running = simulate.rank_items(best, "running").withColumnRenamed("rank", "rank_running")
    lowest = simulate.rank_items(running, "lowest").withColumnRenamed("rank", "rank_lowest")
    return simulate.rank_items(lowest, "average").select(
        "store_cd", "jan", "rec_price", "rank_running", "rank_lowest", "rank")


def series_price_cap_many(spark, sf):
    best = simulate.best_item_price(_simulated_many(spark, sf), CFG, views.items_many(spark, sf))
    return rounded(best, 6, *TOTALS).drop("rank")


def best_customer_price(spark, sf):
    simulated = _simulated(spark, sf)
    return simulate.best_customer_price(simulated, simulate.best_item_price(simulated, CFG))


QUERIES = {f.__name__: f for f in (
    pos_scan, pos_scan_left, pos_scan_damaged, pos_scan_rejects, pos_member_filter, pos_names_filter,
    item_master_rows, item_master_rejects, pack_master_rows, series_master_rows, sink_by_store, sample_dump,
    item_result_ordered, pos_filters, pos_item_filter, pos_demographic_filter, pos_topk,
    predicate_builder, store_list, store_lookup, item_drop_anti, flagged_rows,
    unit_price, member_filter, noise_clip, noise_clip_exact, member_days, null_profile,
    date_offset, epoch_date,
    day_price, price_periods, price_periods_many, cases_up, cases_up_lead_first, cases_zero,
    cases_zero_single, case_master_up, case_master_zero, case_master_both, case_master_period, target_cases,
    sample_customers, sample_customers_zero, train_days, train_days_by_store, labels_case, labels_item,
    label_ints,
    pack_size_category, pack_size_category_all, price_features,
    rfm_global, rfm_case, rfm_rank_norm, rfm_levels, loyalty, loyalty_clustered, loyalty_global, pscore, pscore_global,
    kani_mean5, kani_global, kani_exp, kani_mean5_many, kani_exp_many,
    kani_global_many, kani_top_sales, features_all, features_all_global,
    oversample, oversample_weights, median_fill, median_fill_exact, forest_score, model_manifest, forest_agreement,
    model_eval_fixed, model_predict, model_eval, batch_predict, batch_predict_grid, batch_predict_trained,
    price_grid, prob_pivot, clamp_prob, monotone_prob, simulate_long, simulate_repeated_items,
    batch_recommend, best_item_price,
    item_rank_avg, item_rank_ties, series_price_cap, series_price_cap_many, best_customer_price)}
