"""Parameters of a discovery run."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    sources: tuple[str, ...] = ()
    min_observations: int = 120
    min_variance: float = 1e-10
    max_nan_ratio: float = 0.20
    stationarity_alpha: float = 0.05
    max_differences: int = 2
    neighbors: int = 7
    permutations: int = 200
    direction_permutations: int = 100
    significance: float = 0.05
    max_lag: int = 12
    prescreen: float = 0.0
    prescreen_lags: tuple[int, ...] = (0, 1, 3, 6, 12)
    fdr_alpha: float = 0.05
    train_ratio: float = 0.7
    min_r2: float = 0.02
    seed: int = 42
    #: Shares of dependence, significance, out-of-sample gain and their product in a score.
    weights: tuple[float, float, float, float] = field(default=(0.25, 0.25, 0.35, 0.15))
