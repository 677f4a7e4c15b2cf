"""Settings of the detectors."""

from __future__ import annotations

from dataclasses import dataclass

SECOND = 1_000_000  # microseconds


@dataclass(frozen=True)
class BurstConfig:
    """threshold: events that make a burst. window: the largest gap between neighbours, in microseconds, itself included."""

    threshold: int = 5
    window: int = 60 * SECOND


@dataclass(frozen=True)
class TriggerConfig:
    """repeats: events within `window` that fire. cooldown: least time between two hits of one source."""

    repeats: int = 3
    window: int = 3600 * SECOND
    cooldown: int = 24 * 3600 * SECOND
