"""Settings from lineora.toml in the working folder."""

from __future__ import annotations

import tomllib
import warnings
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

FILE = "lineora.toml"


@dataclass
class Config:
    """None: not set there, the built-in default holds."""

    dialect: str | None = None
    level: str | None = None
    output_format: str | None = None
    templater: str | None = None
    no_star: bool | None = None
    catalog_type: str | None = None
    ddl_folder: str | None = None
    provide_schema: str | None = None
    templating: dict[str, Any] = field(default_factory=dict)
    graph: dict[str, Any] = field(default_factory=dict)
    dissect: dict[str, Any] = field(default_factory=dict)
    catalog: dict[str, Any] = field(default_factory=dict)


def load_config(folder: str | Path = ".") -> Config:
    """A missing file gives defaults; a malformed one gives a warning and defaults; unknown keys are ignored."""
    path = Path(folder) / FILE
    if not path.is_file():
        return Config()
    try:
        data = tomllib.loads(path.read_text(encoding="utf-8"))
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        warnings.warn(f"Ignoring {path}: {e}", stacklevel=2)
        return Config()
    data = data.get("lineora", data)
    known = {f.name: f for f in fields(Config)}
    return Config(**{k: v for k, v in data.items() if k in known and isinstance(v, dict) == ("dict" in str(known[k].type))})


def pick(*choices: Any) -> Any:
    """The first that is set."""
    return next((c for c in choices if c is not None), None)
