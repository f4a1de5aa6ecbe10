"""Scenario contract: an immutable, validated description of one scoring run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import constants as C


class ScenarioError(ValueError):
    pass


@dataclass(frozen=True)
class Scenario:
    scenario_name: str = "Baseline"
    regions: tuple[str, ...] = C.REGIONS
    min_risk_threshold: float = 0.0
    max_risk_threshold: float = 1.0
    weighting: str = "balanced"
    include_ai_narrative: bool = True
    max_map_points: int = C.MAP_POINTS_DEFAULT

    def __post_init__(self):
        # Lists are accepted for convenience but stored as tuples (immutable).
        object.__setattr__(self, "regions", tuple(self.regions or ()))
        if not 1 <= len(self.scenario_name or "") <= C.SCENARIO_NAME_MAX:
            raise ScenarioError("scenario_name must hold 1 to 100 characters")
        for name in ("min_risk_threshold", "max_risk_threshold"):
            v = getattr(self, name)
            if not (0.0 <= float(v) <= 1.0):
                raise ScenarioError(f"{name} must lie in [0, 1]")
        if self.min_risk_threshold > self.max_risk_threshold:
            raise ScenarioError("min_risk_threshold must be <= max_risk_threshold")
        if self.weighting not in C.WEIGHTS:
            raise ScenarioError(f"unknown weighting {self.weighting!r}")
        if not (0 < int(self.max_map_points) <= C.MAP_POINTS_MAX):
            raise ScenarioError("max_map_points must lie in (0, 250000]")

    @property
    def weights(self) -> tuple[float, ...]:
        return C.WEIGHTS[self.weighting]

    @classmethod
    def from_dict(cls, data: dict) -> "Scenario":
        allowed = set(cls.__dataclass_fields__)
        extra = set(data) - allowed
        if extra:
            raise ScenarioError(f"unknown scenario fields: {sorted(extra)}")
        return cls(**data)
