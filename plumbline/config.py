"""Settings and fixed domain values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DriftConfig:
    """Cut-offs and window sizes of a drift check."""

    window_size: int = 200
    min_window_size: int = 50
    psi_low: float = 0.10
    psi_medium: float = 0.20
    psi_high: float = 0.30
    chi2_pvalue: float = 0.05
    output_psi: float = 0.20
    model_name: str = "monitored-model"


@dataclass(frozen=True)
class SplitConfig:
    """Shares and seed of a stratified split."""

    train: float = 0.60
    validation: float = 0.20
    test: float = 0.20
    seed: int = 42


MIN_RECALL = 0.75

# Severity ranks, the levels that raise an alert, and the colours
# the alert consumer understands.
SEVERITY_RANK = {
    "insufficient_data": 0,
    "none": 1,
    "low": 2,
    "medium": 3,
    "high": 4,
    "critical": 5,
}
ALERTING = ("medium", "high", "critical")
CONTRACT_COLOUR = {
    "insufficient_data": "green",
    "none": "green",
    "low": "green",
    "medium": "yellow",
    "high": "red",
    "critical": "red",
}

# What-if shift profiles as (share of rows, numeric delta).
SHIFT_PROFILES = {
    "Mild": (0.35, 0.8),
    "Medium": (0.65, 1.6),
    "Strong": (1.0, 3.0),
}

# Promotion gate.
CHECKLIST = (
    "hil_approved",
    "tests_passed",
    "schema_compatible",
    "metrics_available",
    "rollback_plan_exists",
    "artifact_triple_exists",
)
ALLOWED_METRIC_DROP = {"test_auc": 0.02, "test_f1": 0.02, "test_recall": 0.0}
REQUIRED_ARTIFACTS = ("schema.json", "threshold.json", "card.md")

# Smallest share a PSI bin may take, and smallest expected count of a
# chi-square cell.
CLIP = 1e-6
