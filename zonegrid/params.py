"""Run parameters (the configuration file of the original service, as one dataclass)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from . import fixed


@dataclass(frozen=True)
class ModelParams:
    n_estimators: int = 100
    learning_rate: float = 0.1
    max_depth: int = 6
    seed: int = 42
    early_stopping_rounds: int = 20
    # Where early stopping looks: "train_tail" (last slice of train by time)
    # or "test" (parity with the original, which stops on the holdout).
    early_stopping_on: str = "test"
    max_bins: int = 256


@dataclass(frozen=True)
class TuningParams:
    enabled: bool = False
    cv_splits: int = 3
    max_samples: int = 20000
    param_grid: tuple = (
        ("n_estimators", (100, 200)),
        ("max_depth", (4, 6)),
        ("learning_rate", (0.05, 0.1)),
    )


@dataclass(frozen=True)
class Params:
    split_date: str = "2025-02-15"
    weather_start: str = "2025-01-01"
    weather_end: str = "2025-03-31"
    der_outlier_upper: float = 15.0
    der_outlier_lower: float = 0.01
    min_active_requests: int = 0
    holidays: tuple = fixed.DEFAULT_HOLIDAYS
    bin_minutes: int = fixed.BIN_MINUTES
    # Supply is binned by *pickup* time in the original; "dropoff" is an option.
    supply_time: str = "pickup"
    # Per-zone series are windowed in (zone, chunk) pieces of this many days,
    # with a halo of neighbour rows, so one hot zone never lands in one task.
    series_chunk_days: int = 7
    model: ModelParams = field(default_factory=ModelParams)
    tuning: TuningParams = field(default_factory=TuningParams)

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


# Shipped configuration of the original service.
SHIPPED = Params(
    split_date="2026-03-01",
    weather_start="2025-01-01",
    weather_end="2026-05-31",
    model=ModelParams(n_estimators=300, learning_rate=0.08, max_depth=6, early_stopping_rounds=30),
    tuning=TuningParams(param_grid=(
        ("n_estimators", (100, 200)),
        ("max_depth", (4, 6, 8)),
        ("learning_rate", (0.05, 0.1)),
    )),
)

# Parameters for the driver's test tables (events span 2024-01-01 .. 2024-01-30).
TESTDATA = Params(
    split_date="2024-01-22",
    weather_start="2024-01-01",
    weather_end="2024-01-30",
    holidays=("2024-01-01", "2024-01-15"),
)
