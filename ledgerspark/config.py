"""Settings: defaults, overridden by ledgerspark.toml or pyproject.toml's [tool.ledgerspark], then the environment, then
arguments."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    warehouse_id: str = ""
    tag_key: str = ""
    days: int = 30
    idle_threshold: float = 0.10
    drift_threshold: float = 0.25
    select: tuple[str, ...] = ("ALL",)
    extend_select: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()
    extend_ignore: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    #: {glob of paths: patterns of rules that are off for them}
    per_file_ignores: dict[str, tuple[str, ...]] = field(default_factory=dict)
    fail_on: str = "error"
    directive: str = "ledger"


def _typed(name: str, value):
    kind = type(getattr(Settings(), name))
    if kind is dict:
        return {k: tuple(v) for k, v in (json.loads(value) if isinstance(value, str) else value).items()}
    if kind is tuple:
        return tuple(value.split(",")) if isinstance(value, str) else tuple(value)
    return kind(value)


def discovered(start: str | Path) -> dict:
    """The first settings found from start upwards, as far as a .git folder or the home folder."""
    for folder in [Path(start).resolve(), *Path(start).resolve().parents]:
        own, project = folder / "ledgerspark.toml", folder / "pyproject.toml"
        if own.is_file():
            return tomllib.loads(own.read_text())
        if project.is_file() and (found := tomllib.loads(project.read_text()).get("tool", {}).get("ledgerspark")):
            return found
        if (folder / ".git").exists() or folder == Path.home():
            break
    return {}


def load(start: str | Path = ".", **arguments) -> Settings:
    known = {f.name for f in fields(Settings)}
    layers = [discovered(start), {k: os.environ[f"LEDGERSPARK_{k.upper()}"] for k in known if f"LEDGERSPARK_{k.upper()}" in os.environ}, {k: v for k, v in arguments.items() if v is not None}]
    out = Settings()
    for layer in layers:
        if unknown := set(layer) - known:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        out = replace(out, **{k: _typed(k, v) for k, v in layer.items()})
    return out
