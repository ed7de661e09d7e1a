"""Parameters, with the values that fit daily panels and those of the weekly test panel."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Defaults are for daily data of decades; `WEEKLY` scales windows and filters to the test panel."""

    min_coverage: float = 0.80
    min_overlap: float = 0.50
    recycled_overlap: float = 0.05
    listing_tolerance_days: int = 5
    snapshot_months: int = 6
    is_years: int = 3
    oos_years: int = 1
    min_is_rows: int = 500
    min_oos_rows: int = 100
    first_year: int = 2014
    last_year: int = 2026
    min_adv: float = 2e7
    min_fold_names: int = 5
    entry: float = 2.0
    exit_: float = 0.5
    stop: float = 4.0
    cost_bps: float = 5.0
    alpha: float = 0.05
    half_life_min: float = 2.0
    half_life_max: float = 30.0
    beta_min: float = 1 / 3
    beta_max: float = 3.0
    min_obs: int = 500
    z_window: int = 60
    regime_window: int = 500
    regime_step: int = 21
    regime_history_days: int = 420
    p_max: float = 0.50
    beta_drift_max: float = 0.50
    regime_half_life_max: float = 60.0
    stale_max: int = 120
    mean_band: float = 0.5
    n_factors: int = 15
    pca_window: int = 252
    pca_step: int = 5
    reg_window: int = 60
    beta_step: int = 1
    min_names: int = 50
    factor_min_adv: float = 1e7
    half_life_days: float = 30.0
    periods_per_year: int = 252
    s_open: float = 1.25
    s_close_long: float = -0.50
    s_close_short: float = 0.75
    s_max: float | None = None
    no_trade_band: float = 0.0
    opt_cost_bps: float = 2.0
    risk_aversion: float = 5e4
    mu_refit: int = 63
    mu_warmup: int = 252
    mu_min_count: int = 400
    mu_shrink: float = 0.5
    quantile: float = 0.15


DAILY = Params()
WEEKLY = Params(
    min_is_rows=100, min_oos_rows=30, first_year=1995, last_year=2001, min_adv=0.0, min_obs=100, half_life_min=0.1, beta_min=0.02, z_window=26, regime_window=52, regime_step=8,
    regime_history_days=420, stale_max=26, n_factors=3, pca_window=52, reg_window=26, min_names=10, factor_min_adv=0.0, mu_refit=13, mu_warmup=26,
    mu_min_count=20, periods_per_year=52, half_life_days=60.0,
)
MONTHLY = Params(
    min_is_rows=30, min_oos_rows=8, first_year=1995, last_year=2001, min_adv=0.0, min_obs=24, half_life_min=0.0, beta_min=0.0, periods_per_year=12,
)
