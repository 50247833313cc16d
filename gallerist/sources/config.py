"""Typed configuration and protocol files, with unknown keys refused."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path


@dataclass(frozen=True)
class Recognition:
    distance_threshold: float = 0.275
    margin: float = 0.04
    vote_window: int = 7
    vote_min_frames: int = 4
    vote_required_ratio: float = 0.6


@dataclass(frozen=True)
class Tracking:
    max_gap_seconds: float = 0.9
    ambiguity_gap: float = 0.025
    max_tracks: int = 32


@dataclass(frozen=True)
class Search:
    strategy: str = "topk_median"
    k: int = 3


@dataclass(frozen=True)
class Config:
    recognition: Recognition = field(default_factory=Recognition)
    tracking: Tracking = field(default_factory=Tracking)
    search: Search = field(default_factory=Search)


@dataclass(frozen=True)
class Protocol:
    """A bound experiment: what is compared, fixed before the test is opened."""

    budgets: tuple = (1, 2, 3, 5)
    methods: tuple = ("first", "quality", "random", "diversity", "coverage")
    seeds: tuple = (0,)
    margins: tuple = (0.0, 0.04)
    target_fpir: float = 0.01
    primary: str = "coverage"
    comparator: str = "first"


#: Ranges of the values, ends included.
RANGES = {
    "distance_threshold": (0, 1), "margin": (0, 1), "vote_window": (1, 100), "vote_min_frames": (1, 100), "vote_required_ratio": (0, 1),
    "max_gap_seconds": (0, 60), "ambiguity_gap": (0, 1), "max_tracks": (1, 1000), "k": (1, 100), "target_fpir": (0, 1),
}


def build(kind: type, value: dict, at: str = ""):
    """A dataclass from a JSON object; unknown keys, wrong types, numbers that
    are not finite and values out of range are errors."""
    if not isinstance(value, dict):
        raise ValueError(f"{at or 'config'}: an object is needed")
    known = {f.name: f for f in fields(kind)}
    if extra := set(value) - set(known):
        raise ValueError(f"{at}unknown keys: {sorted(extra)}")
    default, out = kind(), {}
    for name, v in value.items():
        now = getattr(default, name)
        if is_dataclass(now):
            out[name] = build(type(now), v, f"{at}{name}.")
        elif isinstance(now, tuple):
            if not isinstance(v, list) or not v or len(set(map(str, v))) != len(v):
                raise ValueError(f"{at}{name}: a list of different values is needed")
            out[name] = tuple(v)
        elif isinstance(now, str):
            if not isinstance(v, str):
                raise ValueError(f"{at}{name}: text is needed")
            out[name] = v
        else:
            whole = isinstance(now, int)
            if isinstance(v, bool) or not isinstance(v, int if whole else (int, float)) or not math.isfinite(v):
                raise ValueError(f"{at}{name}: a finite number is needed")
            low, high = RANGES[name]
            if not low <= v <= high:
                raise ValueError(f"{at}{name}: not within {low}..{high}")
            out[name] = v
    return kind(**out)


def load_config(path: str | Path) -> Config:
    c = build(Config, json.loads(Path(path).read_text("utf-8")))
    if c.recognition.vote_min_frames > c.recognition.vote_window:
        raise ValueError("recognition.vote_min_frames is larger than the window")
    from gallerist.operators.search import STRATEGIES

    if c.search.strategy not in STRATEGIES:
        raise ValueError(f"search.strategy is none of {STRATEGIES}")
    return c


def load_protocol(path: str | Path) -> Protocol:
    p = build(Protocol, json.loads(Path(path).read_text("utf-8")))
    if p.primary not in p.methods or p.comparator not in p.methods or p.primary == p.comparator:
        raise ValueError("primary and comparator have to be two of the methods")
    return p
