"""Parameters of the operators, with the defaults used in production."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class BuildConfig:
    """Candidate build and evaluation parameters (fixed values)."""

    horizon_minutes: int = 30
    radius_m: float = 300.0
    alert_threshold: float = 0.6
    hard_threshold: float = 0.6
    uncertain_threshold: float = 0.4
    hard_per_day: int = 600
    uncertain_per_day: int = 200
    random_per_day: int = 200
    train_end: str = "2025-08-31 23:59:59"
    validation_end: str = "2025-10-31 23:59:59"
    test_end: str = "2025-12-31 23:59:59"
    seed: int = 20260730


@dataclass(frozen=True)
class Scenario:
    """Accident loss and the per-action cost and false-alarm penalty."""

    name: str
    accident_loss: float
    cost_warning: float = 1.0
    cost_patrol: float = 5.0
    cost_emergency: float = 15.0
    penalty_warning: float = 0.5
    penalty_patrol: float = 3.0
    penalty_emergency: float = 10.0


def _default_scenarios() -> tuple[Scenario, ...]:
    return tuple(Scenario(f"loss_cost_ratio_{loss}", float(loss)) for loss in (2000, 5000, 10000))


@dataclass(frozen=True)
class DispatchConfig:
    """Site windows, capacities and mitigation rates (fixed values)."""

    window_minutes: int = 10
    zone_m: int = 500
    candidate_score_minimum: float = 0.4
    warning_capacity: int = 8
    patrol_capacity: int = 3
    emergency_capacity: int = 1
    max_patrols_per_road: int = 2
    patrol_separation_m: float = 1000.0
    ranking_threshold: float = 0.6
    emergency_threshold: float = 0.8
    mitigation_warning: float = 0.1
    mitigation_patrol: float = 0.45
    mitigation_emergency: float = 0.3
    robust_radius: float = 0.03
    scenarios: tuple[Scenario, ...] = field(default_factory=_default_scenarios)


STRATEGIES = (
    "no_action",
    "stage1_priority",
    "student_priority",
    "greedy_expected_utility",
    "binary_program_expected_utility",
    "robust_binary_program",
)
