"""Settings with their checks; frozen, on the driver only."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path


def _within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be in {low}..{high}, not {value}")


@dataclass(frozen=True)
class Routing:
    share_threshold: int = 4
    review_threshold: int = 3
    burst_rank_consider: int = 2
    diversity: bool = True
    too_similar: float = 0.95
    retries: int = 2
    retry_delay: float = 2.0
    ranked_bursts: bool = False
    classify_videos: bool = True
    workers: int = 10

    def __post_init__(self):
        _within("share_threshold", self.share_threshold, 1, 5)
        _within("review_threshold", self.review_threshold, 1, 5)
        if self.review_threshold >= self.share_threshold:
            raise ValueError("review_threshold must be below share_threshold")
        _within("too_similar", self.too_similar, 0, 1)
        if self.retries < 0:
            raise ValueError("retries must not be negative")
        if self.workers < 1:
            raise ValueError("workers must be 1 or more")


@dataclass(frozen=True)
class Bursts:
    enabled: bool = True
    window_seconds: float = 10.0
    similarity: float = 0.92
    least: int = 2
    most: int = 50
    chunk: int = 10

    def __post_init__(self):
        _within("similarity", self.similarity, 0, 1)
        if self.least < 2 or self.most < self.least:
            raise ValueError("need 2 <= least <= most")


@dataclass(frozen=True)
class Quality:
    sharpness: float = 0.8
    brightness: float = 0.2

    def __post_init__(self):
        if abs(self.sharpness + self.brightness - 1) > 0.01:
            raise ValueError("the weights must add up to 1")


@dataclass(frozen=True)
class Documents:
    grouping: bool = True
    similarity: float = 0.85
    kept_chars: int = 50_000
    dim: int = 64

    def __post_init__(self):
        _within("similarity", self.similarity, 0, 1)


@dataclass(frozen=True)
class Config:
    routing: Routing = field(default_factory=Routing)
    bursts: Bursts = field(default_factory=Bursts)
    quality: Quality = field(default_factory=Quality)
    documents: Documents = field(default_factory=Documents)

    @classmethod
    def of(cls, tree: dict | None) -> Config:
        """From nested dicts; unknown names are ignored, known values are checked."""
        parts = {}
        for f in fields(cls):
            kind = f.default_factory
            given = (tree or {}).get(f.name) or {}
            parts[f.name] = kind(**{k.name: given[k.name] for k in fields(kind) if k.name in given})
        return cls(**parts)


def _scalar(text: str):
    for value, names in ((None, ("", "null", "~")), (True, ("true", "yes", "on")), (False, ("false", "no", "off"))):
        if text.lower() in names:
            return value
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text


def load(path: str | Path) -> Config:
    """Settings from JSON, or from YAML of two levels: sections with plain values, comments allowed."""
    text = Path(path).read_text(encoding="utf-8")
    if text.lstrip().startswith("{"):
        return Config.of(json.loads(text))
    tree: dict[str, dict] = {}
    section: dict = {}
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        name, colon, value = bare.strip().partition(":")
        if not colon:
            raise ValueError(f"cannot read: {line}")
        if not line[0].isspace():
            section = tree.setdefault(name, {})
        else:
            section[name] = _scalar(value.strip())
    return Config.of(tree)


def save(config: Config, path: str | Path) -> None:
    """The settings as YAML of two levels, or as JSON where the name says so."""
    tree = asdict(config)
    if str(path).endswith(".json"):
        text = json.dumps(tree, indent=2) + "\n"
    else:
        text = "".join(f"{name}:\n" + "".join(f"  {k}: {json.dumps(v)}\n" for k, v in part.items()) for name, part in tree.items())
    Path(path).write_text(text, encoding="utf-8")


def find(*places: str | Path | None, name: str = "gleanery.json") -> Path | None:
    """The first of the given files or folders that holds the settings."""
    for place in places:
        if place is None:
            continue
        p = Path(place)
        for candidate in (p, p / name):
            if candidate.is_file():
                return candidate
    return None
