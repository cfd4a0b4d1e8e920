"""Durations as people write them."""

from __future__ import annotations

import re

UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def parse(text: str) -> float:
    """Seconds of 30s, 5m, 1h30m, 1.5h or 1 d."""
    low = text.strip().lower()
    parts = re.findall(r"(\d+(?:\.\d+)?)\s*([smhd])", low)
    if not parts or re.sub(r"\d+(?:\.\d+)?\s*[smhd]|\s", "", low):
        raise ValueError(f"not a duration: {text!r}")
    seconds = sum(float(n) * UNITS[u] for n, u in parts)
    return int(seconds) if seconds == int(seconds) else seconds


def show(seconds: float) -> str:
    """In the largest unit that leaves no rest: 90m, not 1h30m."""
    unit = next(u for u in "dhms" if int(seconds) % UNITS[u] == 0)
    return f"{int(seconds) // UNITS[unit]}{unit}"
