import random

import pytest
from conftest import rows

from pricelane import PricingConfig
from pricelane.operators import probability, simulate

CFG = PricingConfig()
KEYS = ["store_cd", "lv4_nm", "lv5_nm", "jan", "uid", "sample_amt_jan", "pprice"]
LONG = ("store_cd int, lv4_nm string, lv5_nm string, jan bigint, uid bigint, sample_amt_jan double, "
        "pprice double, dp int, prob_jan double, prob_lv5 double")
ITEMS = "jan bigint, name string, oprice double, max_dprice int"


def predictions(spark, *customers):
    """(jan, uid, amount, {dp: (prob_jan, prob_lv5)}) or the same with a store in front."""
    long = []
    for c in customers:
        store, (jan, uid, amount, grid) = (c[0], c[1:]) if len(c) == 5 else (1, c)
        long += [(store, "lv4", "milk", jan, uid, amount, 100.0, dp, *p) for dp, p in grid.items()]
    return probability.grid_from_long(spark.createDataFrame(long, LONG), KEYS)


def items(spark, *values):
    return spark.createDataFrame([(v[0], f"item {v[0]}", *map(float, v[1:2]), v[2]) for v in values],
                                 ITEMS)


def flat(jan, lv5):
    return {dp: (jan, lv5) for dp in (0, 10, 20, 30)}


def lowered_by_hand(grid, c0, c5, cj):
    low = lambda *v: max(0.0, min(x for x in v if x is not None)) if any(
        x is not None for x in v) else None
    minus = lambda v, c: None if v is None else v - c
    out, last = {}, (None, None)
    for dp in sorted(grid):
        jan, lv5 = grid[dp]
        lv5 = low(lv5, minus(last[1], c5))
        last = (low(jan, minus(lv5, c0), minus(last[0], cj)), lv5)
        out[dp] = last
    return out


def test_monotone_equals_a_plain_loop(spark):
    rng = random.Random(5)
    value = lambda: rng.choice([None, rng.random(), rng.random(), 0.001, 1.0])
    grids = {u: {dp: (value(), value()) for dp in (0, 10, 20, 30)} for u in range(60)}
    df = predictions(spark, *((1, u, 100.0, grid) for u, grid in grids.items()))
    for r in rows(probability.monotone_prob(df, CFG)):
        expected = lowered_by_hand(grids[r["uid"]], 0.0, 0.008, 0.028)
        for e in r["grid"]:
            assert (e["prob_jan"], e["prob_lv5"]) == pytest.approx(expected[e["dp"]])


def test_clamp(spark):
    df = predictions(spark, (1, 1, 1.0, {0: (-0.1, 1.2), 10: (None, 0.4)}))
    found = rows(probability.clamp_prob(df))[0]["grid"]
    assert found == [{"dp": 0, "prob_jan": 0.0, "prob_lv5": 1.0},
                     {"dp": 10, "prob_jan": None, "prob_lv5": 0.4}]


def test_wide_and_back(spark):
    df = predictions(spark, (1, 1, 1.0, {0: (0.1, 0.2), 10: (0.3, 0.4), 20: (0.5, 0.6)}))
    wide = probability.grid_to_wide(df, CFG)
    first = rows(wide)[0]
    assert (first["prob_jan_10"], first["prob_lv5_20"], first["prob_jan_30"]) == (0.3, 0.6, None)
    again = rows(probability.grid_from_wide(wide, CFG))[0]["grid"]
    assert [e["prob_lv5"] for e in again] == [0.2, 0.4, 0.6, None]
    assert probability.grid_to_long(df).count() == 3


def test_simulation_by_hand(spark):
    df = predictions(spark, (1, 1, 250.0, {0: (0.9, 0.8), 10: (0.7, 0.6), 20: (0.5, 0.5),
                                           30: (0.4, 0.3)}))
    found = rows(simulate.simulate(df, items(spark, (1, 60, 20)), CFG), "dp")
    assert [r["rec_price"] for r in found] == [110.0, 120.0, 130.0]
    first = found[0]      # 2 units, margin 40
    assert first["prof_pre"] == 80.0 and first["max_price"] == 120.0
    assert first["prof_ch"] == pytest.approx((0.7 * 10 - 0.4 * 40) * 2 + 0.2 * 40 * 2)
    assert first["amt_ch"] == pytest.approx((0.7 * 10 - 0.4 * 100) * 2 + 0.2 * 100 * 2)
    assert first["prob5_ch"] == pytest.approx(-0.2)
    assert first["amt_chr"] == pytest.approx(first["amt_ch"] / 250)


def test_no_margin_means_no_ratio(spark):
    df = predictions(spark, (1, 1, 250.0, flat(0.5, 0.9)))
    simulated = simulate.simulate(df, items(spark, (1, 100, 50)), CFG)
    assert {r["prof_chr"] for r in rows(simulated)} == {0.0}
    best = rows(simulate.best_item_price(simulated, CFG))[0]
    assert (best["rec_price"], best["prof_chr"]) == (130.0, None)


def test_filters_and_cap(spark):
    df = predictions(spark, (1, 1, 500.0, flat(0.5, 0.9)), (2, 1, 500.0, flat(0.0, 0.9)),
                     (3, 1, 500.0, flat(0.5, 0.9)))
    master = items(spark, (1, 60, 20), (2, 60, 30))       # item 3 has no master row
    best = rows(simulate.best_item_price(simulate.simulate(df, master, CFG), CFG))
    assert [(r["jan"], r["rec_price"], r["rank"]) for r in best] == [(1, 120.0, 1)]


def test_tied_prices_take_the_lower(spark):
    grid = {0: (0.5, 0.9), 10: (0.4, 0.9), 20: (0.2, 0.9), 30: (0.1, 0.9)}
    simulated = simulate.simulate(predictions(spark, (1, 1, 500.0, grid)),
                                  items(spark, (1, 60, 30)), CFG)
    best = simulate.best_item_price(simulated, CFG)
    assert rows(best)[0]["rec_price"] == 110.0
    assert rows(simulate.best_customer_price(simulated, best))[0]["id_rec_price"] == 110.0


def test_customer_prices(spark):
    # customer 2 leaves at any increase; customer 3 takes the highest price, above the item's cap
    df = predictions(spark, (1, 1, 5000.0, flat(0.5, 0.9)),
                     (1, 2, 100.0, {0: (0.9, 0.9), 10: (0.0, 0.0), 20: (0.0, 0.0), 30: (0.0, 0.0)}),
                     (1, 3, 100.0, flat(1.0, 1.0)))
    simulated = simulate.simulate(df, items(spark, (1, 60, 20)), CFG)
    best = simulate.best_item_price(simulated, CFG)
    found = {r["id"]: r for r in rows(simulate.best_customer_price(simulated, best))}
    assert {r["rec_price"] for r in found.values()} == {120.0}
    assert (found[2]["id_rec_price"], found[2]["disc_price"]) == (100.0, 20.0)
    assert (found[3]["id_rec_price"], found[3]["disc_price"]) == (130.0, 0.0)


def test_stores_do_not_mix(spark):
    df = predictions(spark, (1, 1, 1, 500.0, flat(0.5, 0.9)), (2, 1, 1, 500.0, flat(0.4, 0.9)))
    best = rows(simulate.best_item_price(
        simulate.simulate(df, items(spark, (1, 60, 30)), CFG), CFG), "store_cd")
    assert [(r["store_cd"], r["rank"]) for r in best] == [(1, 1), (2, 1)]


VALID = ("store_cd int, lv4_nm string, lv5_nm string, jan bigint, rec_price double, prof_ch double")


def test_rank_with_ties(spark):
    df = spark.createDataFrame([(1, "a", "b", j, 1.0, p) for j, p in
                                [(1, 9.0), (2, 5.0), (3, 5.0), (4, 1.0)]], VALID)
    rank = lambda ties: [r["rank"] for r in rows(simulate.rank_items(df, ties), "jan")]
    assert rank("lowest") == [1, 2, 2, 4]
    assert rank("average") == [1.0, 2.5, 2.5, 4.0]
    assert rank("running") == [1.0, 3.0, 3.0, 5.5]    # 3 rows up to the tie, 4 up to the last
    with pytest.raises(ValueError):
        simulate.rank_items(df, "dense")


def test_series_cap_by_hand(spark):
    valid = spark.createDataFrame(
        [(1, "a", "b", j, float(p), float(100 * j + p)) for j, prices in {
            1: [10], 2: [10, 20], 3: [10, 20, 30], 4: [30, 40], 5: [20, 50], 6: [60], 7: [70]
        }.items() for p in prices], VALID)
    best = simulate.most_profitable(valid)
    assert [r["rec_price"] for r in rows(best, "jan")] == [10, 20, 30, 40, 50, 60, 70]
    series = spark.createDataFrame([(j, "A") for j in range(1, 6)] + [(6, None)],
                                   "jan bigint, series string")
    capped = rows(simulate.series_price_cap(best, valid, series, CFG), "jan")
    # two lowest prices: 10 and 20; 3 and 5 move to 20, 4 has neither; 6 and 7 have no series
    assert [(r["jan"], r["rec_price"]) for r in capped] == [(1, 10), (2, 20), (3, 20), (5, 20),
                                                            (6, 60), (7, 70)]
    loose = PricingConfig(max_price_cnt=5)
    assert rows(simulate.series_price_cap(best, valid, series, loose), "jan") == rows(best, "jan")


def test_empty(spark):
    df = predictions(spark, (1, 1, 500.0, flat(0.5, 0.9))).where("jan < 0")
    simulated = simulate.simulate(probability.monotone_prob(probability.clamp_prob(df), CFG),
                                  items(spark, (1, 60, 20)), CFG)
    best = simulate.best_item_price(simulated, CFG)
    assert best.count() == 0 and simulate.best_customer_price(simulated, best).count() == 0


def test_a_repeated_item_counts_once_and_lower_prices_stay(spark):
    cfg = PricingConfig(dprice_range=(-10, 10))
    grid = [{"dp": dp, "prob_jan": 0.8, "prob_lv5": 0.9} for dp in (-10, 0, 10)]
    kind = ("store_cd int, lv4_nm string, lv5_nm string, jan bigint, uid bigint, sample_amt_jan double, "
            "pprice double, grid array<struct<dp:int,prob_jan:double,prob_lv5:double>>")
    table = spark.createDataFrame([(1, "a", "b", 7, 1, 500.0, 100.0, grid)], kind)
    master = "jan bigint, name string, oprice double, max_dprice double"
    once = spark.createDataFrame([(7, "x", 60.0, 20.0)], master)
    more = spark.createDataFrame([(7, "y", 50.0, 20.0), (7, "x", 60.0, 20.0), (7, "a", None, 20.0)], master)
    found = rows(simulate.simulate(table, once, cfg), "dp")
    assert [r["dp"] for r in found] == [-10, 10] and found == rows(simulate.simulate(table, more, cfg), "dp")


def test_the_series_cap_simulates_customers_once(spark):
    simulated = simulate.simulate(predictions(spark, *((j, u, 500.0, flat(0.9, 0.9)) for j in (1, 2, 3) for u in (1, 2))),
                                  items(spark, (1, 60, 30), (2, 60, 20), (3, 60, 10)), CFG)
    series = spark.createDataFrame([(j, "A") for j in (1, 2, 3)], "jan bigint, series string")
    capped = simulate.best_item_price(simulated, CFG, series)
    assert "inline" not in capped._jdf.queryExecution().optimizedPlan().toString()
    valid = simulate.valid_item_prices(simulated, CFG)
    plain = simulate.rank_items(simulate.series_price_cap(simulate.most_profitable(valid), valid, series, CFG))
    assert capped.count() > 0 and rows(capped, "jan") == rows(plain, "jan")
