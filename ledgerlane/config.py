"""Business parameters, passed to operators and emitted as literals."""

from __future__ import annotations

from dataclasses import dataclass, replace
from decimal import Decimal


@dataclass(frozen=True)
class ReconConfig:
    # Match tolerances.
    tax_slack: Decimal = Decimal("1.00")
    tax_fraction: Decimal = Decimal("0.005")
    tax_cap: Decimal = Decimal("100.00")
    date_window_days: int = 30

    # Statutory thresholds.
    ruleset_version: str = "2026.07"
    exposure_absolute: Decimal = Decimal("100000.00")
    exposure_fraction: Decimal = Decimal("0.20")
    claim_cutoff_month: int = 11
    claim_cutoff_day: int = 30
    action_cutoff_day: int = 14
    auto_accept_ceiling: Decimal = Decimal("25000.00")
    confidence_floor: float = 0.75

    # Investigation budgets, applied to recorded step logs.
    max_steps: int = 8
    max_seconds: float = 120.0
    max_tokens: int = 60_000
    repeat_threshold: int = 2

    # Recovery conversations.
    max_messages_per_cycle: int = 2

    # Evidence lookups.
    probe_rows: int = 8
    probe_slack: Decimal = Decimal("1.00")
    precedents_per_query: int = 3

    # Physical limits. Results do not depend on them, only the strategy does.
    hot_key_rows: int | None = 1_000_000
    """Groups with more rows than this are ranked by a range sort, not one window task.
    None states that no group can be that large, which saves the checks."""
    pair_group_lines: int = 200
    """Suffix-variant groups with more lines than this are assigned in distributed rounds."""
    broadcast_rows: int = 100_000
    """Largest counted side that may be broadcast."""


DEFAULTS = ReconConfig()


def for_row_count(config: ReconConfig, rows: int) -> ReconConfig:
    """Drop the hot-key checks where the whole table is no larger than a hot key."""
    if config.hot_key_rows is not None and rows <= config.hot_key_rows:
        return replace(config, hot_key_rows=None)
    return config
