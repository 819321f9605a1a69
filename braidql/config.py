"""Settings, layered: defaults, files, environment, then what a caller gives."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

PREFIX = "BRAIDQL_"
#: Looked for in this order; later files win.
PLACES = ("~/.config/braidql/config.toml", "braidql.toml", "braidql.json")


@dataclass(frozen=True)
class Config:
    master: str | None = None
    shuffle_partitions: int | None = None
    time_zone: str = "UTC"
    input_format: str | None = None
    output_format: str = "json"
    limit: int | None = None
    variables: dict[str, Any] = field(default_factory=dict)


def _read(path: Path) -> dict[str, Any]:
    text = path.read_text()
    return tomllib.loads(text) if path.suffix == ".toml" else json.loads(text)


def _merged(base: Config, values: dict[str, Any]) -> Config:
    known = {f.name: f for f in fields(Config)}
    wrong = [k for k in values if k not in known]
    if wrong:
        raise ValueError(f"no setting {', '.join(wrong)}")
    numbers = ("shuffle_partitions", "limit")
    return replace(base, **{k: int(v) if k in numbers and v is not None else v for k, v in values.items()})


def load(path: str | None = None, environment: dict[str, str] | None = None, **given: Any) -> Config:
    """The settings in force."""
    out = Config()
    for place in [path] if path else PLACES:
        at = Path(place).expanduser()
        if at.exists():
            out = _merged(out, _read(at))
    env = os.environ if environment is None else environment
    found = {k[len(PREFIX) :].lower(): v for k, v in env.items() if k.startswith(PREFIX)}
    out = _merged(out, {k: v for k, v in found.items() if k in {f.name for f in fields(Config)} - {"variables"}})
    return _merged(out, {k: v for k, v in given.items() if v is not None})
