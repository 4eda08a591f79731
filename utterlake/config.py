"""Settings of a run: defaults, a mapping read from a file, overrides."""

from __future__ import annotations

import argparse
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class SynthesisConfig:
    candidates: int = 4
    chunk_ms: int = 500
    initial_s: float = 1.0
    seed: int = 21
    max_files: int = 0  # 0: all


def load(values: Mapping[str, object], cls: type = SynthesisConfig):
    """An instance of ``cls``; an unknown key is a TypeError."""
    return cls(**values)


def load_file(path: str, cls: type = SynthesisConfig):
    """The settings of a YAML file (or JSON, which is YAML); an empty file gives the defaults."""
    try:
        import yaml
    except ImportError:  # JSON alone is read then
        import json

        with open(path, encoding="utf-8") as f:
            return load(json.load(f), cls)
    with open(path, encoding="utf-8") as f:
        return load(yaml.safe_load(f) or {}, cls)


def with_arguments(config, argv: list[str]):
    """``config`` with the options of the command line, which win over the file."""
    p = argparse.ArgumentParser()
    for f in fields(config):
        p.add_argument("--" + f.name.replace("_", "-"), type=type(getattr(config, f.name)), default=None)
    given = {k: v for k, v in vars(p.parse_args(argv)).items() if v is not None}
    return replace(config, **given)
