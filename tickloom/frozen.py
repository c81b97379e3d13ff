"""Frozen research parameters. Results are only comparable under exactly these."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Frozen:
    primary: tuple[str, ...] = ("EURUSD", "GBPUSD", "USDJPY", "AUDUSD", "USDCAD", "USDCHF")
    secondary: tuple[str, ...] = ("EURGBP", "EURJPY", "GBPJPY", "AUDJPY")
    store_zone: str = "UTC"
    session_zone: str = "Europe/London"
    close_zone: str = "America/New_York"
    asia_minutes: tuple[int, int] = (0, 420)  # local minutes, end excluded
    london_minutes: tuple[int, int] = (420, 601)
    lookback: int = 60
    threshold: float = 0.30
    plateau: tuple[float, ...] = (0.20, 0.25, 0.30, 0.35, 0.40)
    events: tuple[float, float] = (1.0, 1.5)
    horizons: tuple[int, ...] = (15, 30, 60, 180)
    split: tuple[float, float, float] = (0.60, 0.20, 0.20)
    draws: int = 2000
    block: int = 20
    seed: int = 42
    quote_age: float = 5.0
    asia_bars: int = 350
    london_bars: int = 150


FROZEN = Frozen()


def inconsistencies(p: Frozen = FROZEN) -> list[str]:
    """What contradicts itself in a parameter set; empty for a usable one."""
    found = []
    if set(p.primary) & set(p.secondary):
        found.append("a pair is in both universes")
    if p.asia_minutes[1] > p.london_minutes[0]:
        found.append("the sessions overlap")
    if abs(sum(p.split) - 1) > 1e-9:
        found.append("the split doesn't add up to 1")
    if p.threshold not in p.plateau:
        found.append("the threshold isn't on its plateau")
    return found
