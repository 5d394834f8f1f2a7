"""Thresholds of all operators, with recursive overrides.

The defaults are fixed values that results depend on.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, is_dataclass, replace


@dataclass(frozen=True)
class Inference:
    confidence: float = 0.35
    iou: float = 0.45
    image_size: int = 640


@dataclass(frozen=True)
class Vision:
    frame_skip: int = 1
    letterbox: int = 1280
    default_fps: int = 30


@dataclass(frozen=True)
class SceneDefaults:
    altitude_m: float = 50.0
    weather: str = "clear"
    weather_source: str = "default"
    scene_type: str = "urban"
    time_of_day: str = "daytime"


@dataclass(frozen=True)
class Tracker:
    high: float = 0.5
    low: float = 0.1
    new: float = 0.6
    buffer: int = 30
    match: float = 0.8


@dataclass(frozen=True)
class Motion:
    buffer: int = 30
    stationary: float = 0.003
    erratic_variance: float = 800.0
    grid: int = 4


@dataclass(frozen=True)
class NearMiss:
    distance: float = 0.05
    min_speed: float = 0.004
    dedup_frames: int = 15


@dataclass(frozen=True)
class Loiter:
    frames: int = 90
    classes: tuple[str, ...] = ("pedestrian", "people", "person")


@dataclass(frozen=True)
class Convoy:
    min_distance: float = 0.03
    max_distance: float = 0.12
    heading: float = 20.0
    frames: int = 45


@dataclass(frozen=True)
class Crowd:
    density: float = 8.0
    window: int = 60


@dataclass(frozen=True)
class Jaywalking:
    vehicle_ratio: float = 0.8
    classes: tuple[str, ...] = ("pedestrian", "people", "person")


@dataclass(frozen=True)
class Zones:
    pedestrian_ratio: float = 0.0
    vehicle_ratio: float = 0.0


@dataclass(frozen=True)
class ReId:
    spatial: float = 0.10
    gap_frames: int = 60
    heading: float = 45.0
    confidence: float = 0.70
    ambiguity: float = 0.05
    weight_spatial: float = 0.35
    weight_temporal: float = 0.25
    weight_heading: float = 0.20
    weight_class: float = 0.20
    coexist_default: float = 1.0


@dataclass(frozen=True)
class Graph:
    near: float = 0.08
    same_zone_only: bool = True
    moving_speed: float = 0.001
    batch_frames: int = 30


@dataclass(frozen=True)
class Config:
    inference: Inference = field(default_factory=Inference)
    vision: Vision = field(default_factory=Vision)
    scene: SceneDefaults = field(default_factory=SceneDefaults)
    tracker: Tracker = field(default_factory=Tracker)
    motion: Motion = field(default_factory=Motion)
    near_miss: NearMiss = field(default_factory=NearMiss)
    loiter: Loiter = field(default_factory=Loiter)
    convoy: Convoy = field(default_factory=Convoy)
    crowd: Crowd = field(default_factory=Crowd)
    jaywalking: Jaywalking = field(default_factory=Jaywalking)
    zones: Zones = field(default_factory=Zones)
    reid: ReId = field(default_factory=ReId)
    graph: Graph = field(default_factory=Graph)

    def merge(self, overrides: dict) -> "Config":
        """A copy with nested overrides; an unknown name or a non-mapping raises ValueError."""
        return _merge(self, overrides)


def _merge(base, overrides):
    if not isinstance(overrides, dict):
        raise ValueError(f"overrides must be a mapping, not {type(overrides).__name__}")
    known = {f.name for f in fields(base)}
    if unknown := set(overrides) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    changed = {}
    for k, v in overrides.items():
        now = getattr(base, k)
        changed[k] = _merge(now, v) if is_dataclass(now) else v
    return replace(base, **changed)


DEFAULT = Config()

#: Two taxonomies on purpose: the role in event rules and the class group in the graph.
PEDESTRIAN_CLASSES = ("pedestrian", "people", "bicycle", "motor", "tricycle", "person")
VEHICLE_CLASSES = ("car", "van", "truck", "bus", "awning-tricycle", "motorcycle")
CLASS_GROUPS = {
    "MotorVehicle": ("car", "van", "truck", "bus"),
    "VulnerableRoadUser": ("pedestrian", "people", "person", "bicycle", "tricycle", "awning-tricycle", "motor", "motorcycle"),
}


def load(path: str, base: Config = DEFAULT) -> Config:
    """``base`` with the overrides of a YAML or JSON file; a file that holds no mapping raises ValueError."""
    with open(path) as f:
        text = f.read()
    try:
        import yaml
    except ImportError:  # JSON is read either way
        data = json.loads(text)
    else:
        data = yaml.safe_load(text)
    return base.merge({} if data is None else data)
