"""Labels and numbers as people read them."""

from __future__ import annotations

import math
from enum import Enum


class Status(Enum):
    """How a method's run ended."""

    NOT_RUN = "NotRun"
    COMPLETED = "Completed"
    SKIPPED = "SkippedByPolicy"
    OUT_OF_MEMORY = "OutOfMemory"
    FAILED = "Failed"


def status_name(status: object) -> str:
    return status.value if isinstance(status, Status) else "UnknownStatus"


def answer_name(reachable: object) -> str:
    return {True: "Reachable", False: "Unreachable"}.get(reachable, "UnknownAnswer") if isinstance(reachable, bool) else "UnknownAnswer"


def _tiered(value: float, tiers: list[tuple[float, str]], rest: str) -> str:
    """The value in the first unit (size, name, largest first) that it fills."""
    for size, unit in tiers:
        if value >= size:
            return f"{value / size:.2f} {unit}"
    return rest


def nanoseconds(value: float) -> str:
    return _tiered(value, [(1e9, "s"), (1e6, "ms"), (1e3, "us")], f"{value:.0f} ns")


def size(n: int) -> str:
    """Bytes, in powers of 1024."""
    return _tiered(n, [(1 << 40, "TiB"), (1 << 30, "GiB"), (1 << 20, "MiB"), (1 << 10, "KiB")], f"{n} B")


def count(n: int) -> str:
    """A count; thousands are abbreviated from 10000 on."""
    return str(n) if n < 10_000 else _tiered(n, [(1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K")], "")


def progress(done: int, total: int) -> str:
    return f"{count(done)} / {count(total)}"


def speedup(ratio: float) -> str:
    """A ratio; none or an infinite one is a dash."""
    if not math.isfinite(ratio) or ratio <= 0:
        return "-"
    return f"{ratio:.2f}x" if ratio >= 0.01 else f"{ratio:.4f}x" if ratio >= 0.0001 else "<0.0001x"


def build_time(ns: int) -> str:
    """An index's build time, always in milliseconds."""
    return f"{ns / 1e6:.1f} ms"


def build_size(n: int) -> str:
    """An index's bytes: as ``size``, but kilobytes with one digit and nothing above gigabytes."""
    return f"{n / 1024:.1f} KiB" if 1024 <= n < 1 << 20 else _tiered(n, [(1 << 30, "GiB"), (1 << 20, "MiB")], f"{n} B")
