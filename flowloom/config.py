"""Settings of a run: defaults, then a JSON file, then ``FLOWLOOM_<NAME>`` variables."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    window_s: float = 10.0
    suspicious_floor: float = 0.5
    attack_floor: float = 0.8
    cooldown_s: float = 60.0
    threshold: float = 0.5
    seed: int = 42

    @staticmethod
    def load(path: str | None = None) -> Config:
        given = {}
        if path:
            with open(path, encoding="utf-8") as f:
                given = json.load(f)
        known = {f.name: type(f.default) for f in fields(Config)}
        if unknown := given.keys() - known.keys():
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        for name in known:
            if (text := os.environ.get(f"FLOWLOOM_{name.upper()}")) is not None:
                given[name] = text
        return Config(**{k: known[k](v) for k, v in given.items()})
