"""Training and prediction for all stores in one pass."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelane.config import PricingConfig
from pricelane.functions.scalars import offset_day
from pricelane.operators.cases import cases_on_shelves, padded_period, target_cases
from pricelane.operators.clean import member_days, price_rows
from pricelane.operators.features import add_customer_features, price_features
from pricelane.operators.models import (FitOptions, RetentionModels, fit_models, label_ints,
                                        predict)
from pricelane.operators.periods import shelf_days
from pricelane.operators.probability import clamp_prob, monotone_prob
from pricelane.operators.sampling import sample_customers
from pricelane.operators.simulate import best_customer_price, best_item_price, simulate
from pricelane.schema import CASE, PREDICTION_KEY
from pricelane.sources.pos import drop_items
from pricelane.sources.sinks import write_samples
from pricelane.sources.tables import Workspace


@dataclass(frozen=True)
class Training:
    zero: RetentionModels
    up: RetentionModels
    features_zero: DataFrame
    features_up: DataFrame
    work: Workspace


def training_days(pos: DataFrame, cases: DataFrame, cfg: PricingConfig, guest_uid=None,
                  by_store: bool = False, parts: int | None = None, clustered: bool = False) -> DataFrame:
    """The customer days that samples, labels and features of `cases` look at: stores with a case, from
    the feature window of the first change to the label window of the last.

    The two days are read from the cases, so they reach the scan as literals and prune its partitions.
    With `by_store` each store has its own first and last change. The days that a store needs are listed
    (at most the days of the history per store) and sales look themselves up in that list, so a fact
    partitioned by store and day reads only the partitions that are listed. `parts`, `clustered`: see member_days.
    """
    before, after = -max(cfg.feature_len, cfg.sample_len), cfg.interval_len + cfg.label_len - 1
    first, last = cases.agg(F.min("astart"), F.max("astart")).first()
    near = F.lit(False)
    if first is not None:
        day = lambda of, shift: F.date_add(F.lit(of).cast("date"), shift)
        near = F.col("salesday").between(day(first, before), day(last, after))
    if not by_store:
        stores = cases.select("store_cd").distinct()
        return member_days(pos.where(near).join(stores, "store_cd", "left_semi"), cfg, guest_uid, parts, clustered)
    return member_days(pos.where(near).join(store_days(cases, before, after), ["store_cd", "salesday"], "left_semi"),
                       cfg, guest_uid, parts, clustered)


def store_days(cases: DataFrame, before: int, after: int) -> DataFrame:
    """store_cd, salesday: the days from `before` days after a store's first change to `after` days after its
    last (both may be negative)."""
    bounds = cases.groupBy("store_cd").agg(F.date_add(F.min("astart"), before).alias("first"),
                                           F.date_add(F.max("astart"), after).alias("last"))
    # the condition says nothing new, but marks the list as a filter for partition pruning
    return bounds.where("first <= last").select("store_cd", F.explode(F.sequence("first", "last")).alias("salesday"))


def train(pos: DataFrame, packs: DataFrame, cfg: PricingConfig,
          period: tuple[str, str] | None = None, stores: DataFrame | None = None,
          scope: str = "case", label_scope: str = "case",
          options_zero: FitOptions = FitOptions(), options_up: FitOptions = FitOptions(),
          model_paths: tuple[str, str] | None = None,
          sample_paths: tuple[str, str] | None = None, guest_uid=None,
          work: Workspace | None = None, buckets: int | None = None, parts: int | None = None) -> Training:
    """Cases, samples, labels, features and both pairs of models (unchanged and raised prices).

    Receipt lines are read twice: for the prices on the shelves and for what customers bought around
    the cases. These two tables, cases, samples and features are kept in `work`, because every later
    step reads them several times; clear it when the results are no longer needed. When labels and
    features only look at a row's own case, both kinds of cases go through the steps together; otherwise
    each kind on its own. `guest_uid` is the member code of guests, if there is one. With `buckets` the
    customer days, samples and baskets are kept in so many buckets by store and member, which later joins do not
    shuffle. With `parts` receipt lines are dealt into so many parts before they are added up (see member_days); in a
    `work` with a folder these are the buckets, unless `buckets` says otherwise.
    """
    work = work or Workspace(pos.sparkSession)
    buckets = buckets or (parts if work.path is not None else None)
    member = ["store_cd", "uid"]
    if stores is not None:
        pos = pos.join(stores.select("store_cd").distinct(), "store_cd", "left_semi")
    shelves = work.keep(shelf_days(price_rows(
        pos if period is None else padded_period(pos, period, cfg))), "shelves")
    cases = {kind: work.keep(cases_on_shelves(shelves, kind, cfg), f"cases-{kind}") for kind in ("zero", "up")}
    cases["both"] = cases["zero"].unionByName(cases["up"])
    together = scope == "case" and label_scope == "case"
    days = training_days(pos, cases["both"], cfg, guest_uid, by_store=together, parts=buckets or parts, clustered=bool(buckets))
    days = work.keep_clustered(days, "member_days", member, buckets) if buckets else work.keep(days, "days")
    samples, features = [], []
    for kind in ("both",) if together else ("zero", "up"):
        base = sample_customers(cases[kind], days, cfg, label_scope, bool(buckets))
        samples.append(work.keep_clustered(base, f"base_{kind}", member, buckets) if buckets else work.keep(base, f"base-{kind}"))
        known = price_features(add_customer_features(samples[-1], days, packs, cfg, scope, work, buckets))
        features.append(work.keep(label_ints(known), f"features-{kind}"))
    if together:
        same = F.col("aprice") == F.col("pprice")
        samples = [samples[0].where(same), samples[0].where(~same)]
        features = [features[0].where(same), features[0].where(~same)]
    if sample_paths is not None:
        for base, path in zip(samples, sample_paths):
            write_samples(base, path)
    keys = [*CASE, "uid"]
    with ThreadPoolExecutor(2) as pool:
        zero, up = pool.map(lambda fit: fit_models(*fit, keys), zip(features, (options_zero, options_up)))
    if model_paths is not None:
        zero.save(model_paths[0])
        up.save(model_paths[1])
    return Training(zero, up, features[0], features[1], work)


@dataclass(frozen=True)
class Recommendation:
    predictions: DataFrame
    items: DataFrame
    customers: DataFrame
    work: Workspace


def predict_prices(pos: DataFrame, items: DataFrame, dropped: DataFrame, packs: DataFrame,
                   upday: str, zero: RetentionModels, up: RetentionModels, cfg: PricingConfig,
                   stores: DataFrame | None = None, scope: str = "case",
                   series: DataFrame | None = None, monotone: bool = False,
                   hard: bool = False, guest_uid=None, work: Workspace | None = None,
                   parts: int | None = None) -> Recommendation:
    """Recommended prices per item and per customer for a change on `upday`, in all stores given."""
    work = work or Workspace(pos.sparkSession)
    if stores is not None:
        pos = pos.join(stores.select("store_cd").distinct(), "store_cd", "left_semi")
    items = drop_items(items, dropped)
    cases = work.keep(target_cases(pos, upday, 0, cfg, items), "cases")
    first = offset_day(upday, -max(cfg.feature_len, cfg.sample_len))
    recent = pos.where(F.col("salesday").between(F.lit(first).cast("date"),
                                                 F.lit(upday).cast("date")))
    days = work.keep(member_days(recent, cfg, guest_uid, parts), "days")
    base = work.keep(sample_customers(cases, days, cfg), "base")
    features = add_customer_features(base, days, packs, cfg, scope, work)
    return recommend(predict(features, zero, up, cfg, PREDICTION_KEY, hard), items, cfg, series, monotone, work)


def recommend(grid: DataFrame, items: DataFrame, cfg: PricingConfig, series: DataFrame | None = None,
              monotone: bool = False, work: Workspace | None = None) -> Recommendation:
    """Prices from probabilities on the price grid: clamped, simulated and compared."""
    work = work or Workspace(grid.sparkSession)
    grid = clamp_prob(grid)
    if monotone:
        grid = monotone_prob(grid, cfg)
    predictions = work.keep(grid, "predictions")
    simulated = simulate(predictions, items, cfg)
    best = work.keep(best_item_price(simulated, cfg, series, work=work), "items")
    return Recommendation(predictions, best, best_customer_price(simulated, best), work)


def batch_predict(pos: DataFrame, stores: DataFrame, *args, **kwargs) -> Recommendation:
    """`predict_prices` for a table of stores; no loop, the results carry the store."""
    return predict_prices(pos, *args, stores=stores, **kwargs)
