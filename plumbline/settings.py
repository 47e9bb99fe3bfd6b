"""Settings of an experiment: defaults, checks, JSON."""

from __future__ import annotations

import json
import warnings
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

MISSING = ("median", "mean", "mode", "drop")
CORRECTIONS = ("holm", "bh")
CALIBRATIONS = ("isotonic", "sigmoid")


@dataclass
class Settings:
    """What a run depends on; `problems` says what is wrong with it."""

    target: str = "state"
    id_column: str | None = None
    features: list[str] = field(default_factory=list)
    rules: list[str] = field(default_factory=list)
    combinations: list[str] = field(default_factory=list)
    default_combinations: bool = True
    models: list[str] = field(default_factory=lambda: ["logistic", "forest", "gbt"])
    parameters: dict[str, dict] = field(default_factory=dict)
    grids: dict[str, dict[str, list]] = field(default_factory=dict)
    outer: int = 10
    inner: int = 5
    seed: int = 42
    calibrate: bool = False
    calibration_folds: int = 3
    calibration: str = "isotonic"
    missing: str = "median"
    search: bool = False
    search_budget: int | None = None
    search_seconds: float | None = None
    scale: bool = True
    explain: bool = False
    bootstrap: int = 1000
    level: float = 0.95
    primary: str = "mcc"
    metrics: list[str] = field(default_factory=list)
    correction: str = "holm"

    @classmethod
    def from_dict(cls, values: dict) -> Settings:
        """From flat or sectioned values (the names of sections do not matter); unknown names are warned of and dropped."""
        known, flat = {f.name for f in fields(cls)}, {}

        def put(part: dict) -> None:
            for k, v in part.items():
                if k in known:
                    flat[k] = v
                elif isinstance(v, dict):
                    put(v)
                else:
                    warnings.warn(f"unknown setting {k!r} dropped", stacklevel=3)

        put(values)
        return cls(**flat)

    @classmethod
    def load(cls, path: str) -> Settings:
        return cls.from_dict(json.loads(Path(path).read_text()))

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2, sort_keys=True))

    def merged(self, **values) -> Settings:
        """With the given values in place of its own; None leaves a value as it is."""
        return Settings(**asdict(self) | {k: v for k, v in values.items() if v is not None})

    def problems(self) -> list[str]:
        from plumbline.operators.models import REGISTRY
        from plumbline.operators import replicates
        from plumbline.operators.rules import parse

        bad = [f"unknown model {m!r}" for m in self.models if m not in REGISTRY] or ["no models"] * (not self.models)
        bad += [f"{n} must be at least {least}" for n, least in (("outer", 2), ("inner", 2), ("calibration_folds", 2), ("bootstrap", 100)) if getattr(self, n) < least]
        bad += [f"calibration must be one of {CALIBRATIONS}"] * (self.calibration not in CALIBRATIONS)
        bad += ["level must lie between 0 and 1"] * (not 0 < self.level < 1)
        bad += [f"missing must be one of {MISSING}"] * (self.missing not in MISSING)
        bad += [f"correction must be one of {CORRECTIONS}"] * (self.correction not in CORRECTIONS)
        bad += [f"unknown metric {m!r}" for m in self.metrics if m not in replicates.BUILT_IN and m not in replicates.REGISTRY]
        bad += [f"the grid of {m!r} must map parameters to lists" for m, g in self.grids.items() if not isinstance(g, dict) or not all(isinstance(v, list) and v for v in g.values())]
        bad += [f"a grid for {m!r}, which is no model" for m in self.grids if m not in REGISTRY]
        bad += ["the target cannot be a feature"] * (self.target in self.features)
        for c in self.combinations:
            try:
                bad += [f"{c!r} names {n!r}, which is no rule" for n in parse(c)[0] if n not in self.rules]
            except ValueError as e:
                bad.append(str(e))
        return bad
