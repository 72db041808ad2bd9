"""Settings of the linkage."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

CORRELATIONS = ("pearson", "spearman")


def _check_method(method: str) -> None:
    if method not in CORRELATIONS:
        raise ValueError(f"corr_method must be one of {CORRELATIONS}, not {method!r}")


@dataclass(frozen=True)
class Tolerances:
    """Windows of the band join and weights of the confidence.

    ``mz_da`` widens the ppm window where it is the larger one.  ``min_intensity_corr=-1``
    switches the correlation filter off.
    """

    mz_ppm: float = 10.0
    mz_da: float | None = None
    rt_seconds: float = 30.0
    min_intensity_corr: float = 0.7
    corr_method: str = "pearson"
    confidence_weights: dict = field(default_factory=lambda: {"mz": 0.35, "rt": 0.30, "intensity": 0.35})

    def __post_init__(self):
        total = sum(self.confidence_weights.values())
        if abs(total - 1.0) > 1e-6:
            raise ValueError(f"confidence_weights must sum to 1.0, not {total}")
        _check_method(self.corr_method)


@dataclass(frozen=True)
class StatTestParams:
    """Permutation test, bootstrap and false-discovery control.

    ``tie_slack``: a permuted correlation counts as reaching the observed one if it is at
    most this much smaller, so that rounding does not decide ties.  ``flag_constant`` adds
    the note ``constant_intensity`` to pairs with a constant side.
    """

    n_permutations: int = 1000
    n_bootstrap: int = 500
    fdr_alpha: float = 0.05
    corr_method: str = "pearson"
    auto_log_transform: bool = True
    random_seed: int = 42
    run_stats: bool = True
    tie_slack: float = 1e-12
    flag_constant: bool = False

    def __post_init__(self):
        _check_method(self.corr_method)
        if not 0 < self.fdr_alpha < 1:
            raise ValueError("fdr_alpha must lie between 0 and 1")
        if self.n_permutations < 100:
            warnings.warn("fewer than 100 permutations give coarse p-values", stacklevel=3)
