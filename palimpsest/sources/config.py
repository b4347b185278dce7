"""Settings out of a JSON file: known names only, numbers within their bounds."""

from __future__ import annotations

import json
import math
from pathlib import Path

# The settings that are numbers, with the greatest value of each, and those that are true or false.
NUMBERS = {
    "alert_error_rate": 1.0, "alert_p95_latency_ms": 300_000.0, "alert_queue_depth": 10_000.0, "heap_warning_mb": 16_384.0, "memory_limit_mb": 16_384.0,
    "consolidation_interval_minutes": 1440.0, "max_concurrent": 100.0, "embedding_batch_size": 1000.0, "metrics_flush_interval_seconds": 3600.0,
}
SWITCHES = ("memory_sampling_enabled",)


def validated(given: dict) -> tuple[dict, list[str]]:
    """(settings, complaints): unknown names, wrong kinds, negative and non-finite numbers are rejected, too great ones lowered."""
    made, rejected = {}, []
    for name, value in given.items():
        if name in SWITCHES:
            if isinstance(value, bool):
                made[name] = value
            else:
                rejected.append(f"{name}: must be true or false")
        elif name not in NUMBERS:
            rejected.append(f"{name}: unknown")
        elif isinstance(value, bool) or not isinstance(value, int | float):
            rejected.append(f"{name}: must be a number")
        elif not math.isfinite(value) or value < 0:
            rejected.append(f"{name}: must be finite and not negative")
        else:
            made[name] = min(float(value), NUMBERS[name])
    return made, rejected


def load(path: str | Path) -> tuple[dict, list[str]]:
    """The settings of a file; a missing file has none, one that isn't a JSON object is a complaint."""
    path = Path(path)
    if not path.exists():
        return {}, []
    try:
        given = json.loads(path.read_text())
    except ValueError as fault:
        return {}, [f"{path}: {fault}"]
    return validated(given) if isinstance(given, dict) else ({}, [f"{path}: must hold an object"])
