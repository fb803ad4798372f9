"""Settings in layers: built-in values, a file and what it extends, the environment, overrides."""

from __future__ import annotations

import copy
import json
import os
from collections.abc import Mapping
from pathlib import Path
from typing import Any

#: Built-in values.
DEFAULTS: dict[str, Any] = {
    "ingest": {"parser_mode": "auto", "split_over": 8000, "split_target": 5000},
    "distill": {"mode": "full", "compression_ratio": 0.30, "max_rounds": 5},
    "coherence": {"max_fix_rounds": 2, "similarity_threshold": 0.75},
    "routes": {"classify": "extractive", "spine": "extractive", "distill": "extractive", "coherence": "extractive"},
    "runs_dir": "runs",
}
#: Environment variables and the settings they set.
ENVIRONMENT = {"QUIRE_RUNS_DIR": ("runs_dir",), "QUIRE_COMPRESSION": ("distill", "compression_ratio"), "QUIRE_PARSER_MODE": ("ingest", "parser_mode")}


class ConfigError(ValueError):
    """A setting that is unknown, of the wrong type, or out of its domain."""


def merge(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """Nested maps merged, all other values replaced."""
    out = copy.deepcopy(dict(base))
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else copy.deepcopy(v)
    return out


def _file(path: Path, above: tuple[Path, ...] = ()) -> dict[str, Any]:
    path = path.resolve()
    if path in above:
        raise ConfigError(f"{path} extends itself")
    try:
        text = path.read_text(encoding="utf-8")
        if path.suffix == ".json":
            own = json.loads(text)
        else:
            import yaml  # only where YAML files are used

            own = yaml.safe_load(text) or {}
    except (OSError, ValueError, ImportError) as e:
        raise ConfigError(f"{path}: {e}") from e
    if not isinstance(own, dict):
        raise ConfigError(f"{path} holds no settings")
    parent = own.pop("extends", None)
    return merge(_file(path.parent / parent, (*above, path)), own) if parent else own


def _checked(given: Mapping[str, Any], known: Mapping[str, Any], at: str = "") -> None:
    for k, v in given.items():
        if k not in known:
            raise ConfigError(f"unknown setting {at}{k}")
        if isinstance(known[k], Mapping):
            if not isinstance(v, Mapping):
                raise ConfigError(f"{at}{k} must be a group of settings")
            _checked(v, known[k], f"{at}{k}.")
        elif isinstance(known[k], (int, float)) and not isinstance(v, (int, float)):
            raise ConfigError(f"{at}{k} must be a number")


def load(path: str | Path | None = None, overrides: Mapping[str, Any] | None = None, env: Mapping[str, str] | None = None) -> dict[str, Any]:
    out = merge(DEFAULTS, _file(Path(path)) if path else {})
    for name, keys in ENVIRONMENT.items():
        if name in (os.environ if env is None else env):
            value: Any = (os.environ if env is None else env)[name]
            at: Any = DEFAULTS
            for k in keys:
                at = at[k]
            try:
                value = type(at)(value)
            except ValueError as e:
                raise ConfigError(f"{name}: {e}") from e
            for k in reversed(keys):
                value = {k: value}
            out = merge(out, value)
    out = merge(out, overrides or {})
    _checked(out, DEFAULTS)
    if not 0 < out["distill"]["compression_ratio"] <= 1:
        raise ConfigError("distill.compression_ratio must be in (0, 1]")
    return out
