"""Parameters of featurisation; the defaults suit dense captures, SPARSE the thin event streams of the test tables."""

from __future__ import annotations

from dataclasses import dataclass

#: Guards divisions.
EPS = 1e-9


@dataclass(frozen=True)
class Settings:
    window: int = 64
    min_count: int = 50
    max_period: float = 0.25
    max_rel_iqr: float = 0.25
    vocabulary: int = 48
    trail: int = 8


SPARSE = Settings(window=16, min_count=5, max_period=1e9, max_rel_iqr=5.0)

#: Alarms an hour, and shares of attack-free windows, at which thresholds are set: fixed values of the protocol.
ALARM_BUDGETS = (1.0, 10.0, 100.0)
RATE_TARGETS = (0.001, 0.01)
