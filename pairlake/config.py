"""Defaults of the operators, as immutable records.

``override`` takes dotted assignments ("mixer.seed=7"); "${env:KEY,default}" in a
value is looked up in the environment. Later settings win over earlier ones.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, fields, replace
from typing import Any


@dataclass(frozen=True)
class Corpus:
    min_text_length: int = 1_000
    max_text_length: int = 500_000
    sequence_length: int = 8_192
    stride: int = 128


@dataclass(frozen=True)
class Triplets:
    abstract_preview: int = 512
    same_topic: float = 0.5
    two_hop: float = 0.3
    random: float = 0.2
    min_citations: int = 0
    max_forward: int = 20


@dataclass(frozen=True)
class Contexts:
    min_chars: int = 50
    max_chars: int = 1_000


@dataclass(frozen=True)
class Intents:
    background: int = 1
    methodology: int = 3
    result: int = 10


@dataclass(frozen=True)
class Sections:
    positive_ratio: float = 0.6
    max_papers: int = 500_000


@dataclass(frozen=True)
class Mixer:
    seed: int = 42
    shard_rows: int = 500_000


@dataclass(frozen=True)
class Training:
    eval_fraction: float = 0.05
    dims: tuple[int, ...] = (768, 512, 256, 128)


@dataclass(frozen=True)
class Config:
    corpus: Corpus = field(default_factory=Corpus)
    triplets: Triplets = field(default_factory=Triplets)
    contexts: Contexts = field(default_factory=Contexts)
    intents: Intents = field(default_factory=Intents)
    sections: Sections = field(default_factory=Sections)
    mixer: Mixer = field(default_factory=Mixer)
    training: Training = field(default_factory=Training)


def _resolved(value: Any) -> Any:
    if not isinstance(value, str):
        return value
    return re.sub(r"\$\{env:([^,}]+)(?:,([^}]*))?\}", lambda m: os.environ.get(m[1], m[2] or ""), value)


def _typed(like: Any, value: Any) -> Any:
    if isinstance(like, bool):
        return str(value).lower() in ("1", "true", "yes")
    if isinstance(like, tuple):
        return tuple(int(x) for x in (value if isinstance(value, (list, tuple)) else str(value).strip("[]()").split(",")))
    return type(like)(value)


def override(config: Config, *settings: str | dict[str, dict[str, Any]]) -> Config:
    """Apply nested dictionaries and dotted assignments, in order."""
    flat: list[tuple[str, Any]] = []
    for s in settings:
        flat += [(f"{g}.{k}", v) for g, kv in s.items() for k, v in kv.items()] if isinstance(s, dict) else [tuple(s.split("=", 1))]
    for name, value in flat:
        group, key = name.split(".")
        part = getattr(config, group)
        if key not in {f.name for f in fields(part)}:
            raise KeyError(name)
        config = replace(config, **{group: replace(part, **{key: _typed(getattr(part, key), _resolved(value))})})
    return config
