"""Engine parameters.

Fixed values that must equal the reference's for the same results are kept
together below, in their natural order.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# --- fixed values (reference conventions) -----------------------------------
REFERENCE_CPI_BASE_YEAR = 2024
REFERENCE_BASE_INDEX_YEAR = 1992
LOW_SAMPLE_THRESHOLD = 50
MACRO_SHOCK_YEARS = (1995, 2008, 2020, 2022)
FAMILY_SALE_TYPES = ("-", "Familiehandel")
ROLLING_VOLATILITY_WINDOWS = (4, 8)
BOND_ELASTICITY_LAGS = (0, 1, 2)
ROLLING_WINDOW_YEARS = 3
MIN_OBS_PER_WINDOW = 20
CV_MIN_TRAIN_END_YEAR = 2013
CV_MAX_TRAIN_END_YEAR = 2021
HOLDOUT_START_YEAR = 2023
DRAWDOWN_ENTER = -0.02
DRAWDOWN_EXIT = -0.01
OUTLIER_PRICE_QUANTILES = (0.005, 0.995)
MIN_ELASTICITY_OBS = 10
CORRELATION_GATE = 0.90
LEAK_R2_CEILING = 0.95
# Columns that must never reach a model (they are the target or derived from it).
# The reference's list, in its order, plus region_price_mean (global over all
FORBIDDEN_FEATURES = (
    "purchase_price",
    "price_per_sqm",
    "price_zscore",
    "price_category",
    "price_per_sqm_x_region",
    "sqm_x_region",
    "is_premium",
    "price_deviation_from_median",
    "region_target_encoded",
    "regional_price_mean",
    "regional_price_median",
    "regional_price_std",
    "regional_price_cv",
    "regional_price_rank",
    "regional_transaction_count",
    "regional_liquidity_score",
    "regional_p90",
    "regional_median",
    "region_price_mean",
)
CRISIS_YEARS = (2008, 2009, 2020, 2021)
MARKET_PHASES = (
    ("growth_90s", 0, 2000),
    ("boom_2000s", 2001, 2007),
    ("crisis_post2008", 2008, 2012),
    ("recovery_2010s", 2013, 2019),
    ("covid_era", 2020, 2024),
)
TARGET_ENCODING_MIN_SAMPLES = 100
RARE_CATEGORY_THRESHOLD = 0.01
MAX_CATEGORIES_ONEHOT = 10
MAX_SELECTED_FEATURES = 30
FEATURE_SELECTION_SAMPLE = 50000
VARIANCE_THRESHOLD = 0.001
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class EngineConfig:
    cpi_base_year: int = REFERENCE_CPI_BASE_YEAR
    base_index_year: int = REFERENCE_BASE_INDEX_YEAR
    low_sample_threshold: int = LOW_SAMPLE_THRESHOLD
    macro_shock_years: tuple[int, ...] = MACRO_SHOCK_YEARS
    family_sale_types: tuple[str, ...] = FAMILY_SALE_TYPES
    volatility_windows: tuple[int, ...] = ROLLING_VOLATILITY_WINDOWS
    elasticity_lags: tuple[int, ...] = BOND_ELASTICITY_LAGS
    rolling_window_years: int = ROLLING_WINDOW_YEARS
    min_obs_per_window: int = MIN_OBS_PER_WINDOW
    cv_min_train_end: int = CV_MIN_TRAIN_END_YEAR
    cv_max_train_end: int = CV_MAX_TRAIN_END_YEAR
    holdout_start_year: int = HOLDOUT_START_YEAR
    split_last_train_year: int = 2017
    drawdown_enter: float = DRAWDOWN_ENTER
    drawdown_exit: float = DRAWDOWN_EXIT
    outlier_quantiles: tuple[float, float] = OUTLIER_PRICE_QUANTILES
    exclude_flags: tuple[str, ...] = ("is_family_sale", "is_unclassified_sale")
    reference_year_for_age: int = 2024
    # "exact" (see functions.quantile) or "approx" (percentile_approx sketch).
    quantile_mode: str = "exact"
    extra: dict = field(default_factory=dict)

    def with_(self, **kw) -> "EngineConfig":
        return replace(self, **kw)


# Parameters for the driver's TPC-H-shaped data (orders 1995-01 .. 2001-08),
DRIVER_CONFIG = EngineConfig(
    cpi_base_year=2001,
    base_index_year=1995,
    split_last_train_year=1998,
    cv_min_train_end=1997,
    cv_max_train_end=1999,
    holdout_start_year=2001,
)
