"""Default thresholds and fixed lists; every function takes them as arguments."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DriftSettings:
    """Thresholds of a drift comparison.

    ``correction`` is one of ``none``, ``bonferroni`` or ``bh``
    (Benjamini-Hochberg). ``ks_exact_at_most`` asks for exact Kolmogorov-Smirnov
    p-values where both samples have at most so many values (10,000 is usual); 0
    takes the series for all.
    """

    # Fixed values of the monitoring rules.
    alpha: float = 0.05
    correction: str = "bh"
    psi_moderate: float = 0.10
    psi_major: float = 0.25
    psi_bins: int = 10
    share_floor: float = 1e-6
    batch_share: float = 0.05
    null_jump: float = 0.35
    min_finite: int = 20
    ks_exact_at_most: int = 0

    def __post_init__(self) -> None:
        if self.correction not in CORRECTIONS:
            raise ValueError(f"correction must be one of {CORRECTIONS}, got {self.correction!r}")


# Fixed values.
CORRECTIONS = ("none", "bonferroni", "bh")
SEED = 42
SAMPLE_CAP = 20_000
N_MONITORED = 40
BASELINE_FRACTION = 0.4
N_WINDOWS = 8
N_TRIALS = 20
COHORT_SHARE = 0.35
ROLLING_ROWS = 50

DECISION_THRESHOLD = 0.5
BASE_RATE = 0.03499
MODEL_VERSION = "scorer-v1"

# Columns that advance with the calendar and are never monitored.
CALENDAR_FEATURES = ("day_index", "TransactionDT", "D1", "D2", "D10", "D15")

# Columns that get a frequency encoding.
FREQUENCY_COLUMNS = ("card1", "card2", "addr1", "P_emaildomain", "_uid")


@dataclass(frozen=True)
class GateSettings:
    """Limits a model's metrics must meet before promotion."""

    # Fixed values of the promotion gate.
    min_val_auc: float = 0.85
    max_n_features: int = 500
    min_train_rows: int = 500_000


@dataclass(frozen=True)
class FieldRule:
    """Range and default of one request field; ``high_open`` excludes ``high``."""

    name: str
    type: str
    low: float | None = None
    high: float | None = None
    high_open: bool = False
    default: float | None = None

    @property
    def required(self) -> bool:
        return self.default is None


# The request contract.
REQUEST_CONTRACT = (
    FieldRule("TransactionAmt", "double", 0, 100_000),
    FieldRule("ProductCD", "int", 0, 4, default=4),
    FieldRule("card1", "int", 0, default=7919),
    FieldRule("card4", "int", 0, 3, default=3),
    FieldRule("card6", "int", 0, 3, default=1),
    FieldRule("addr1", "double", default=299.0),
    FieldRule("hour", "double", 0, 24, high_open=True, default=14.0),
    FieldRule("dayofweek", "double", 0, 7, high_open=True, default=2.0),
    FieldRule("C1", "double", default=1.0),
    FieldRule("C13", "double", default=1.0),
    FieldRule("D1", "double", default=0.0),
    FieldRule("has_identity", "int", 0, 1, default=0),
)
