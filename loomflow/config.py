"""Parameters of an analysis; nothing in the package assumes a particular log."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, replace
from datetime import datetime, timedelta

METHODS = ("Frequency", "Mean burden", "Empirical Tail", "Original DRO", "Saturation-Aware DRO")
#: The score column that each method ranks by.
SCORES = {"Frequency": "frequency", "Mean burden": "mean_score", "Empirical Tail": "tail_score", "Original DRO": "dro_score", "Saturation-Aware DRO": "sa_score"}


@dataclass(frozen=True)
class Config:
    """Windows are half-open; delays are capped at `cap` hours; blocks are `block_days` long from `start`."""

    start: datetime
    decision: datetime
    holdout_end: datetime
    observation_end: datetime | None = None
    cap: float = 2160.0
    alpha: float = 0.95
    block_days: int = 14
    min_obs: int = 500
    min_block: int = 20
    coverage: float = 0.6
    radius_q: float = 0.9
    kappa: float = 0.9
    multiplier: float = 1.0
    reference: str = "pooled"
    grid: float | None = None
    sizes: tuple[int, ...] = (3, 5, 10)
    methods: tuple[str, ...] = METHODS
    seed: int = 20260914

    @property
    def tail(self) -> float:
        return 1.0 - self.alpha

    @property
    def blocks(self) -> int:
        """Calendar blocks of the history window, one at least."""
        span = (self.decision - self.start) / timedelta(days=self.block_days)
        return max(1, int(-(-span // 1)))

    def but(self, **changes) -> Config:
        return replace(self, **changes)

    def digest(self) -> str:
        """A hash by which stored results are keyed, so that other parameters never reuse them."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, default=str).encode()).hexdigest()


def common_followup_end(holdout_end: datetime, observation_end: datetime, days: int) -> datetime:
    """The last origin that `days` of follow-up are recorded for, within the holdout."""
    return min(holdout_end, observation_end - timedelta(days=days))
