"""Business and model settings, passed explicitly to operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    target_rate: float = 0.18
    rate_tolerance: float = 0.08
    train_fraction: float = 0.80
    decision_threshold: float = 0.40
    champion_gap: float = 0.02
    trees: int = 300
    tree_depth: int = 6
    learning_rate: float = 0.05
    cox_ridge: float = 0.1
    replacement_cost: float = 450_000.0
    intervention_cost: float = 50_000.0
    high_threshold: float = 200_000.0
    medium_threshold: float = 50_000.0
    retention_success: float = 0.75
    chunk_size: int = 300
    chunk_overlap: int = 50
    results_per_query: int = 2


DEFAULTS = Settings()
