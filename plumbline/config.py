"""Settings a user passes and the cut-offs the operators share."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Thresholds:
    # Cut-offs every operator must agree on.
    onehot_max: int = 15
    ordinal_max: int = 50
    class_profile_max: int = 50
    large_rows: int = 50_000
    medium_rows: int = 5_000
    small_rows: int = 500
    limitation_small_rows: int = 2_000
    leakage: float = 0.95
    correlation: float = 0.95
    missing_drop: float = 0.90
    quasi_constant: float = 0.99
    high_cardinality: int = 15
    outlier_listed: float = 0.05
    outlier_significant: float = 0.10
    skewed: float = 1.0
    imbalance: float = 0.10
    imbalance_severe: float = 0.05
    profile_sample: int = 10_000
    coerce_share: float = 0.8
    clip_low: float = 0.01
    clip_high: float = 0.99
    rare_share: float = 0.01
    robust_switch: float = 0.15
    min_variance: float = 0.01
    weak_share: float = 0.01
    test_share: float = 0.2
    hash_width: int = 16


@dataclass
class Settings:
    """What a training run can be told; every interactive choice is a field."""

    target: str | None = None
    problem: str | None = None
    drop: list[str] = field(default_factory=list)
    id_cols: list[str] = field(default_factory=list)
    smote: bool = True
    shap: bool = True
    rfe: bool = False
    unsupervised: bool = False
    k: int | None = None
    time_budget: float = 120.0
    max_trials: int | None = None
    trials_at_once: int = 3
    models: list[str] | None = None
    #: Bounds the drawn rounds and trees; the trial log shows the values that were fitted.
    max_iter: int | None = None
    seed: int = 42
    on_ambiguous: str = "classification"
    thresholds: Thresholds = field(default_factory=Thresholds)
