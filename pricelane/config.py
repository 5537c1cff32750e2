"""Parameters of the analysis, checked when the object is built."""

from __future__ import annotations

from dataclasses import dataclass, field

# Pack-content limit per category name; a larger pack gets its own sub-category.
PACK_SPLIT = {
    "乳飲料": 750,
    "飲料": 750,
    "果汁飲料": 750,
    "牛乳": 750,
    "豆乳": 750,
    "乳酸菌": 510,
    "発酵乳": 750,
    "コーヒー・紅茶・茶": 750,
    "健康飲料": 750,
    "子供飲料": 500,
}


@dataclass(frozen=True)
class PricingConfig:
    # price increases that are scored, next to 0
    dprice_range: tuple[int, ...] = (10, 20, 30)

    # days of one price required before / from the change on
    thd_plen: int = 75
    thd_alen: int = 45
    # longest gap in days between the two price runs of a change
    max_gap: int = 3
    # unchanged runs: days skipped at the start, days between two cases, spare days required
    zero_skip: int = 7
    zero_step: int = 42
    zero_slack: int = 6

    # windows around the change day, in days
    interval_len: int = 7
    feature_len: int = 63
    sample_len: int = 28
    label_len: int = 28

    # units per line above this are clipped
    noise_max_cnt: int = 6

    # price sensitivity
    pscore_modify_ndays: int = 6
    pscore_mod_lv5: dict = field(default_factory=lambda: dict(PACK_SPLIT))
    pscore_multipkg_thd: int = 1200
    pscore_ignore_plv5: tuple[str, ...] = ()

    # steps by which probabilities must fall as the price rises
    fix_same_dprice: float = 0.0
    fix_same_type_lv5: float = 0.008
    fix_same_type_jan: float = 0.028

    # limits for a recommended price
    simu_thd_retainr: float = -0.9
    simu_thd_amtchanger: float = -0.9
    max_price_cnt: int = 2

    # A key is split over several tasks once it holds more than this share of all rows
    # (so at most 1 / hot_share keys are ever split) and at least hot_rows rows.
    hot_share: float = 1 / 4096
    hot_rows: int = 1_000_000
    # items of one category in one member's history that one task pairs up
    basket_slice: int = 2_000

    def __post_init__(self):
        if self.thd_plen <= max(self.feature_len, self.sample_len):
            raise ValueError("thd_plen must exceed feature_len and sample_len")
        if self.thd_alen <= self.interval_len + self.label_len:
            raise ValueError("thd_alen must exceed interval_len + label_len")
        if 0 in self.dprice_range or list(self.dprice_range) != sorted(set(self.dprice_range)):
            raise ValueError("dprice_range must be ascending, distinct and without 0")

    @property
    def grid(self) -> list[int]:
        return [0, *self.dprice_range]
