"""Settings of the operators: defaults, under a TOML file, under the environment, under the session's configuration.

A value is looked for as `chronovec.<section>.<name>` in the session, as CHRONOVEC_<SECTION>_<NAME> in the environment
and as <name> in the table [<section>] of the file. Sections without code behind them have no settings.
"""

from __future__ import annotations

import os
import tomllib
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession

# Defaults of the sections below, and the words that mean true.


@dataclass(frozen=True)
class Sampling:
    interval_seconds: float = 8.0
    mode: str = "sparse"
    pipeline: str = "raw"


@dataclass(frozen=True)
class Markers:
    tag_name: str = "moment"


@dataclass(frozen=True)
class Embedding:
    model: str = "dino"
    clip_model: str = "ViT-H-14"
    clip_pretrained: str = "laion2b_s32b_b79k"
    dino_model: str = "dinov2_vitl14"


@dataclass(frozen=True)
class Scoring:
    reduce: str = "max"
    normalize: str = "none"
    smooth_window: int = 3
    high: float = 0.45
    low: float = 0.35
    min_duration: float = 3.0
    merge_gap: float = 2.0
    max_duration: float = 30.0
    pad: float = 0.5

    def rules(self) -> dict:
        """Keywords of score_scenes and recommend; a longest duration of 0 is none."""
        return {
            "high": self.high, "low": self.low, "normalize": self.normalize, "window": self.smooth_window, "min_duration": self.min_duration,
            "merge_gap": self.merge_gap, "max_duration": self.max_duration or None, "padding": self.pad,
        }


@dataclass(frozen=True)
class Modeling:
    classifier: str = "logreg"
    taste_classifier: str = "auto"
    recency_halflife_days: float = 90.0


@dataclass(frozen=True)
class Library:
    path: str = ""


@dataclass(frozen=True)
class Sync:
    prune: bool = False


TRUE = ("1", "true", "yes", "on")


def _as(kind: str, value, name: str):
    if kind == "bool":
        return value if isinstance(value, bool) else str(value).strip().lower() in TRUE
    try:
        return {"str": str, "int": int, "float": float}[kind](value)
    except ValueError:
        raise ValueError(f"{name} needs {'a whole number' if kind == 'int' else 'a number'}, it is {value!r}") from None


@dataclass(frozen=True)
class Settings:
    sampling: Sampling = field(default_factory=Sampling)
    markers: Markers = field(default_factory=Markers)
    embedding: Embedding = field(default_factory=Embedding)
    scoring: Scoring = field(default_factory=Scoring)
    modeling: Modeling = field(default_factory=Modeling)
    library: Library = field(default_factory=Library)
    sync: Sync = field(default_factory=Sync)

    @classmethod
    def load(cls, path: str | Path | None = None, environment: Mapping[str, str] | None = None, spark: SparkSession | None = None) -> "Settings":
        """Settings of a file, where it exists, of an environment and of a session; unknown names in the file are left out."""
        held: dict = {}
        if path is not None and Path(path).exists():
            held = tomllib.loads(Path(path).read_text(encoding="utf-8"))
        known = os.environ if environment is None else environment
        sections = {}
        for section in fields(cls):
            kind = section.default_factory
            own = {}
            for f in fields(kind):
                name = f"{section.name}.{f.name}"
                value = held.get(section.name, {}).get(f.name)
                value = known.get(f"CHRONOVEC_{section.name}_{f.name}".upper(), value)
                if spark is not None:
                    value = spark.conf.get(f"chronovec.{name}", None) or value
                if value is not None:
                    own[f.name] = _as(f.type, value, name)
            sections[section.name] = kind(**own)
        return cls(**sections)


#: A vector of each row's bytes.
Embedder = Callable[[Column], Column]
_EMBEDDERS: dict[str, Callable[..., Embedder]] = {}


def register_embedder(name: str, make: Callable[..., Embedder]) -> None:
    """make(**options) gives an embedder; names are told apart without regard to case."""
    _EMBEDDERS[name.lower()] = make


def embedder(name: str, **options) -> Embedder:
    """The embedder registered under a name; an unknown one raises ValueError."""
    if name.lower() not in _EMBEDDERS:
        raise ValueError(f"unknown embedder {name!r}; there are {', '.join(sorted(_EMBEDDERS))}")
    return _EMBEDDERS[name.lower()](**options)


def embed(rows: DataFrame, name: str, data: str = "content", into: str = "vec", **options) -> DataFrame:
    """rows with the vector of a column of bytes."""
    return rows.withColumn(into, embedder(name, **options)(rows[data]))


def _hashed(dim: int = 32) -> Embedder:
    from chronovec.functions.binary import hashed_embedding

    return lambda data: hashed_embedding(data, dim)


register_embedder("hashed", _hashed)
