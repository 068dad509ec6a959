"""From a query text to a plan: intent, fusion strategy and cost, decided on the driver from a few numbers."""

from __future__ import annotations

from dataclasses import dataclass

from lattica.operators.search import INTENTS

#: Unit costs in milliseconds, fixed values.
SCAN_1K, INDEX, KEY_VALUE, POINTS_1K, HOP, LENS = 50.0, 5.0, 0.1, 1.0, 10.0, 5.0
COST_CAP = 30_000.0


@dataclass(frozen=True)
class Plan:
    intent: str
    fusion: str
    cost_ms: float


def plan(text: str, slots: int, rows: int = 0, indexed: bool = True, points: int = 0, hops: int = 0, cap: float = COST_CAP) -> Plan:
    """Code takes one lens, an intent with a profile is fused by it, the rest by equal ranks; a plan dearer than ``cap`` is
    refused. :func:`lattica.operators.fusion.fuse` runs the strategy."""
    low = text.lower()
    intent = next((name for name, words in INTENTS.items() if any(w in low for w in words)), "general")
    cost = slots * LENS + (INDEX if indexed else rows / 1000 * SCAN_1K) + points / 1000 * POINTS_1K + hops * HOP
    if cost > cap:
        raise ValueError(f"the plan costs {cost:.0f} ms, more than {cap:.0f}")
    return Plan(intent, "single" if slots == 1 or intent == "code" and slots else "rrf" if intent == "general" else "weighted", cost)
