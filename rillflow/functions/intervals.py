"""Interval and duration texts, in milliseconds."""

from __future__ import annotations

import re

UNITS = {"millisecond": 1, "ms": 1, "second": 1000, "sec": 1000, "minute": 60_000, "min": 60_000, "hour": 3_600_000, "hr": 3_600_000, "h": 3_600_000, "day": 86_400_000, "d": 86_400_000}
SHORT = {"ns": 1e-6, "us": 1e-3, "ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000}


def interval_ms(text: str) -> int:
    """'10 seconds', INTERVAL '10' SECOND, INTERVAL '10 seconds', or a duration such as 1h30m."""
    t = re.sub(r"(?i)^\s*interval\b", "", text).replace("'", " ").strip()
    m = re.fullmatch(r"(\d+)\s+([a-zA-Z]+)", t)
    if m:
        unit = m[2].lower()
        unit = unit if unit in UNITS else unit.removesuffix("s")
        if unit in UNITS:
            return int(m[1]) * UNITS[unit]
    return duration_ms(t)


def duration_ms(text: str) -> int:
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|ms|s|m|h)", text.strip())
    if not parts or "".join(a + b for a, b in parts) != text.strip():
        raise ValueError(f"no interval: {text!r}")
    return round(sum(float(a) * SHORT[b] for a, b in parts))
