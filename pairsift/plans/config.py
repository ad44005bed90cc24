"""Settings: which detectors run, and at which percentile they flag; from the environment and a file of NAME=value lines."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from pathlib import Path

LOG_LEVELS = ("CRITICAL", "ERROR", "WARNING", "INFO", "DEBUG")


@dataclass(frozen=True)
class DetectorConfig:
    enabled: bool = True
    threshold_percentile: float = 99.5
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not 0 <= self.threshold_percentile <= 100:
            raise ValueError("threshold_percentile must be between 0 and 100")


def _default_detectors() -> dict[str, DetectorConfig]:
    # Default percentiles. The judge runs only if a backend gives responses.
    return {
        "semantic_similarity": DetectorConfig(threshold_percentile=99.5),
        "readability_mismatch": DetectorConfig(threshold_percentile=95.0),
        "repetition": DetectorConfig(threshold_percentile=1.0),
        "length_ratio": DetectorConfig(threshold_percentile=5.0),
        "refusal_bias": DetectorConfig(threshold_percentile=99.0),
        "unsafe_prompt": DetectorConfig(threshold_percentile=99.0),
        "llm_judge": DetectorConfig(threshold_percentile=99.5),
    }


@dataclass(frozen=True)
class Settings:
    detectors: dict[str, DetectorConfig] = field(default_factory=_default_detectors)
    store_path: str = "pairsift-store"
    batch_size: int = 32  # texts that a model gets at once
    embedding_model: str = "all-MiniLM-L6-v2"
    debug: bool = False
    log_level: str = "INFO"

    def __post_init__(self) -> None:
        if self.batch_size < 1:
            raise ValueError("batch_size must be at least 1")
        level = str(self.log_level).strip().upper()
        if level not in LOG_LEVELS:
            raise ValueError(f"log_level must be one of {', '.join(LOG_LEVELS)}")
        object.__setattr__(self, "log_level", level)

    def detector(self, name: str) -> DetectorConfig:
        return self.detectors.get(name, DetectorConfig())

    @classmethod
    def load(cls, file: str = ".env", environment: dict[str, str] | None = None, prefix: str = "PAIRSIFT_") -> Settings:
        """Settings from a file of NAME=value lines, if there is one, and over these the environment.

        Names are the fields' in capitals behind the prefix; DETECTORS is a JSON object of detectors, each with what
        differs from its defaults. Unknown names are left out.
        """
        given = {**_file_values(Path(file)), **(os.environ if environment is None else environment)}
        named = {k[len(prefix) :].lower(): v for k, v in given.items() if k.upper().startswith(prefix)}
        values: dict = {k: v for k, v in named.items() if k in ("store_path", "embedding_model", "log_level")}
        if "batch_size" in named:
            values["batch_size"] = int(named["batch_size"])
        if "debug" in named:
            values["debug"] = named["debug"].strip().lower() in ("1", "true", "yes", "on")
        if "detectors" in named:
            detectors = _default_detectors()
            for name, change in json.loads(named["detectors"]).items():
                usual = detectors.get(name, DetectorConfig())
                detectors[name] = DetectorConfig(**{"enabled": usual.enabled, "threshold_percentile": usual.threshold_percentile, "extra": usual.extra, **change})
            values["detectors"] = detectors
        return cls(**values)


def _file_values(path: Path) -> dict[str, str]:
    if not path.is_file():
        return {}
    lines = (x.strip().removeprefix("export ").split("=", 1) for x in path.read_text(encoding="utf-8").splitlines() if "=" in x and not x.lstrip().startswith("#"))
    return {name.strip(): value.strip().strip("\"'") for name, value in lines}
