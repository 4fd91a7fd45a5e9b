"""Study settings: one immutable record handed to the composed plans."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Study:
    # fixed values
    mass_min: float = 2000.0
    mass_max: float = 13000.0
    bin_width: float = 1.0
    known_min_clusters: int = 5
    sensitivity_min_clusters: int = 3
    folds: int = 5
    seeds: tuple[int, ...] = (20260907, 20260919, 20261001, 20261013, 20261025)
    primary_model: str = "extra_trees"
    coverage: float = 0.95
    replicates: int = 2000

    def __post_init__(self) -> None:
        if not self.mass_min < self.mass_max or self.bin_width <= 0:
            raise ValueError("the mass grid is empty")
        if not 0 < self.coverage < 1:
            raise ValueError("coverage must lie strictly between 0 and 1")
        if self.folds < 2 or not self.seeds:
            raise ValueError("at least two folds and one seed are needed")
        if self.sensitivity_min_clusters > self.known_min_clusters:
            raise ValueError("the sensitivity threshold cannot exceed the primary one")

    @property
    def bins(self) -> int:
        return int(round((self.mass_max - self.mass_min) / self.bin_width))

    @classmethod
    def from_json(cls, text: str) -> "Study":
        known = {f.name for f in fields(cls)}
        values = {k: v for k, v in json.loads(text).items() if k in known}
        if "seeds" in values:
            values["seeds"] = tuple(int(s) for s in values["seeds"])
        return cls(**values)
