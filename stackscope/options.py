"""Tuning knobs shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Options:
    stuck_k: int = 3
    fingerprint_depth: int = 8
    top_stacks: int = 15
    max_frames_shown: int = 40
    leak_min_growth: int = 5
    critical_victims: int = 5
    pause_slack_ms: int = 2000
    #: user pool rules, checked before the built-in ones: (pool name, regex)
    pool_patterns: tuple[tuple[str, str], ...] = field(default_factory=tuple)
