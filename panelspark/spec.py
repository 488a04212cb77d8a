"""What a panel is called, and the settings the operators default to."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class PanelSpec:
    """Column names of a panel: one row an (entity, period); period is a month-end date."""

    entity: str = "entity"
    period: str = "eom"
    target: str = "target"

    @property
    def keys(self) -> list[str]:
        return [self.entity, self.period]


@dataclass(frozen=True)
class Settings:
    """Defaults; the values that the reference's results depend on are kept as they are there."""

    seed: int = 42
    min_price: float = 5.0
    size_quantile: float = 0.20
    short_size_pct: float = 0.40
    short_volume_pct: float = 0.30
    missing_share: float = 0.20
    # sequences
    seq_len: int = 11
    seq_min_valid: int = 6
    gru_hidden: int = 64
    gru_lr: float = 1e-3
    gru_batch: int = 2048
    gru_epochs: int = 100
    gru_patience: int = 5
    gru_clip: float = 1.0
    gru_decay: tuple = (0.0, 1e-4, 1e-3)
    # pairwise ranker
    rank_depths: tuple = (3, 4, 5)
    rank_trees: int = 2000
    rank_every: int = 50
    rank_step: float = 0.03
    rank_rows: float = 0.7
    rank_columns: float = 0.5
    rank_leaf_weight: float = 200.0
    rank_lambda: float = 10.0
    ridge_alphas: tuple = (0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0)
    # text
    chunk_tokens: int = 512
    max_chunks: int = 8
    # filter
    noise_floor: float = 0.05
    beta_shrink: float = 0.33
    # books
    per_side: int = 250
    gross: float = 2.0
    net_band: float = 0.20
    beta_tol: float = 0.02
    beta_step: float = 0.01
    sector_band: float = 0.10
    size_band: float = 0.05
    band_step: float = 0.05
    max_weight: float = 0.015
    lambda_tc: tuple = (0.0, 0.1, 0.25, 0.5)
    lambda_beta: tuple = (0.0, 10.0, 100.0, 1000.0)
    lambda_risk: tuple = (0.0, 100.0)
    lambda_factor: tuple = (0.0, 300.0, 1000.0, 3000.0, 10000.0)
    short_size_grid: tuple = (0.30, 0.40, 0.50)
    beta_check_t: float = 1.96
    # v2
    v2_cost: float = 0.0012
    v2_vol: float = 0.08
    v2_max_weight: float = 0.005
    v2_beta_tol: float = 0.02
    v2_ic_floor: float = 0.01
    # v3
    v3_smooth: tuple = (1.0, 0.5)
    v3_tail: float = 0.10
    max_names: int = 500
    # v4
    v4_gross: tuple = (1.0, 1.5, 2.0)
    v4_windows: tuple = (24, 36)
    v4_risk: tuple = (1.0, 10.0, 100.0, 1000.0)
    v4_turnover: tuple = (0.0, 0.05, 0.20)
    v4_fee: float = 0.001
    v4_beta_limit: float = 0.05
    v4_size_balance: float = 0.05
    v4_long_share: tuple = (0.40, 0.60)
    v4_min_names: int = 100
    # risk
    risk_window: int = 60
    risk_min_months: int = 24
    spec_window: int = 36
    spec_min: int = 6
    # clustered importance
    cfi_cuts: tuple = (0.65, 0.75, 0.85)
    cfi_shares: tuple = (0.25, 0.50, 0.75)
    cfi_repeats: int = 3
    cfi_min_pairs: int = 100
    cfi_min_months: int = 12
    # metrics
    premium: float = 0.04
    nw_lags: int = 3
    extra: dict = field(default_factory=dict, hash=False)

    def but(self, **changes) -> Settings:
        return replace(self, **changes)
