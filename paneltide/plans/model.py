"""Declarations of a screening model: measures, indicators, weights, regimes, cut-offs."""
from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Measure:
    """How an indicator is computed from panel columns.

    kind: ``ratio`` (a / b * scale), ``growth`` (exact prior period of a), ``complement`` (1 - a),
    ``payment`` (monthly payment on level a at percent rate c, over b).
    """
    kind: str
    a: str
    b: str | None = None
    c: str | None = None
    scale: float = 1.0


@dataclass(frozen=True)
class Indicator:
    measure: Measure
    weight: float
    bucket: str
    inverse: bool = False


@dataclass(frozen=True)
class Model:
    indicators: Mapping[str, Indicator]
    regimes: Mapping[str, tuple[int, int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        check_weights({k: v.weight for k, v in self.indicators.items()})

    @property
    def names(self) -> list[str]:
        return list(self.indicators)

    @property
    def weights(self) -> dict[str, float]:
        return {k: v.weight for k, v in self.indicators.items()}

    @property
    def signs(self) -> dict[str, int]:
        return {k: -1 if v.inverse else 1 for k, v in self.indicators.items()}

    @property
    def buckets(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for k, v in self.indicators.items():
            out.setdefault(v.bucket, []).append(k)
        return out


def check_weights(weights: Mapping[str, float], label: str = "model") -> None:
    total = sum(weights.values())
    if abs(total - 1.0) > 1e-9:
        raise ValueError(f"{label} weights must sum to 1, got {total:.6f}")


# Indicator weights, directions and buckets of the default model.
RENT_MODEL = Model({
    "net_migration": Indicator(Measure("ratio", "net_migration", "population"), 0.20, "demand"),
    "job_growth": Indicator(Measure("growth", "total_emp"), 0.12, "demand"),
    "income_growth": Indicator(Measure("growth", "income_pc"), 0.08, "demand"),
    "permits_to_stock": Indicator(Measure("ratio", "permits_total", "housing_units"), 0.25, "supply", True),
    "rent_to_income": Indicator(Measure("ratio", "rent", "income_pc", scale=12.0), 0.12, "affordability", True),
    "cost_to_own_vs_rent": Indicator(Measure("payment", "home_value", "rent", "mortgage_rate"), 0.08, "affordability"),
    "trailing_rent_growth": Indicator(Measure("growth", "rent"), 0.10, "momentum"),
    "employment_diversity": Indicator(Measure("complement", "emp_hhi"), 0.05, "resilience"),
}, regimes={"pre_covid": (2015, 2019), "shock": (2020, 2022), "normalization": (2023, 2099)})

# Evaluation and reporting cut-offs.
WINSOR_LIMITS = (0.01, 0.99)
PRECISION_K = 10
TOP_QUANTILE = 0.75
MIN_WINDOW_ROWS = 10
MIN_COVERAGE = 8
REGIME_FLAG_THRESHOLD = 0.075
TIERS = (("Leading cluster", 28), ("Strong", 40), ("Mid", 70), ("Weak", 95), ("Lagging", None))
LEADING_LOW = 10
MATERIAL = 0.02
SCHEME_FACTORS = {
    "current": {}, "equal": None, "demand-tilt": {"demand": 1.5},
    "supply-tilt": {"supply": 1.6}, "affordability-light": {"affordability": 0.4}}
CROSS_SOURCE_GAP = 0.04
CROSS_SOURCE_SIGMA = 3.0
OUTLIER_SIGMA = 4.0
TOP_MOVER_RANKS = 15
GOLDEN_RTOL = 1e-4
GOLDEN_ATOL = 1e-8
