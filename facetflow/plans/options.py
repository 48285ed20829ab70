"""Options of a simplification and how they are written."""

from __future__ import annotations

import math
from dataclasses import dataclass
from pathlib import Path

SEQUENTIAL, BATCH = "sequential", "partitioned_batch"


@dataclass(frozen=True)
class SimplifyOptions:
    """target_fraction of the vertices are to be left.  partitions 0: as many as threads.  batch_size: most
    collapses of a slab in a round, 0 for no limit.  repartition_every 0: when the slabs have aged."""

    target_fraction: float = 1.0
    threads: int = 1
    mode: str = BATCH
    partitions: int = 0
    batch_size: int = 0
    repartition_every: int = 0

    def __post_init__(self) -> None:
        if not 0.0 <= self.target_fraction <= 1.0:  # false for NaN
            raise ValueError("the target fraction must lie between 0 and 1")
        if self.mode not in (SEQUENTIAL, BATCH):
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.threads < 1 or min(self.partitions, self.batch_size, self.repartition_every) < 0:
            raise ValueError("counts must not be negative, and there is at least one thread")

    @property
    def slabs(self) -> int:
        return (self.partitions or self.threads) if self.mode == BATCH else 1


def target_count(fraction: float, vertices: int) -> int:
    return max(1, math.ceil(fraction * vertices))


def parse_fraction(text: str) -> float:
    """25% or 25 for percent, 0.25 as a ratio; 1 is all of it."""
    raw = text.strip()
    percent = raw.endswith("%")
    try:
        value = float(raw[:-1] if percent else raw)
    except ValueError:
        raise ValueError(f"not a percentage: {text!r}") from None
    if percent or value > 1:
        if not 0 <= value <= 100:
            raise ValueError(f"a percentage must lie between 0 and 100: {text!r}")
        return value / 100
    if not 0 <= value <= 1:
        raise ValueError(f"a ratio must lie between 0 and 1: {text!r}")
    return value


def parse_count(text: str, zero: bool = False) -> int:
    if not text.isascii() or not text.isdigit() or (int(text) == 0 and not zero):
        raise ValueError(f"not a positive integer: {text!r}")
    return int(text)


def check_paths(source: str, target: str) -> None:
    a, b = Path(source), Path(target)
    if a.resolve() == b.resolve() or (a.exists() and b.exists() and a.samefile(b)):
        raise ValueError("input and output must be different files")
