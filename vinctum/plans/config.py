"""Settings of both matchers. Opposite sides are a hard contradiction in either; their cap is no tuning matter."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RecordConfig:
    """Matcher A: missing fields drop out and the weights are scaled up."""

    weights: tuple[tuple[str, float], ...] = (("marks", 0.45), ("height", 0.12), ("age", 0.13), ("temporal", 0.15), ("geo", 0.15))
    cap: float = 0.2
    age_slack: int = 3
    age_conflict: int = 12
    tiers: tuple[float, float] = (0.75, 0.5)


@dataclass(frozen=True)
class MatchConfig:
    """Matcher B: missing fields score neutral."""

    retrieve_k: int = 50
    top_k: int = 8
    verify_top_n: int = 3
    mark_threshold: float = 0.4
    w_marks: float = 0.45
    w_height: float = 0.20
    w_age: float = 0.10
    w_geo: float = 0.15
    w_temporal: float = 0.10
    height_tolerance: float = 25.0
    age_decay: float = 12.0
    other_state: float = 0.40
    tier_high: float = 0.65
    tier_medium: float = 0.35
    cap: float = 0.20
    block_on_sex: bool = True
    block_on_time: bool = True
    age_margin: int = 12
    neutral: float = 0.5
