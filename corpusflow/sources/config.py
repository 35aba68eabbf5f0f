"""The configuration of a source: one YAML file, held against a table of its keys."""

from __future__ import annotations

import re
from pathlib import Path
from types import SimpleNamespace
from typing import Any

from ..operators.html import CONTENT, STRIP

NEEDED = object()
# The keys of the file, their types (of a list, its items' type) and defaults. A nested table is a part.
KEYS: dict[str, Any] = {
    "name": (str, NEEDED),
    "sitemaps": ([str], []),
    "urls": ([str], []),
    "include": ([str], []),
    "exclude": ([str], []),
    "respect_robots": (bool, True),
    "user_agent": (str, "corpusflow/0.1"),
    "fetch": {"delay_seconds": (float, 0.5), "workers": (int, 2), "timeout_seconds": (float, 30.0), "max_retries": (int, 3)},
    "detect": {"recheck_after_hours": (float, 24.0), "content_selectors": ([str], list(CONTENT)), "strip_selectors": ([str], list(STRIP))},
    "sections": (dict, {}),
    "prepare": (dict, {}),
}
_SAFE_NAME = re.compile(r"[A-Za-z0-9._-]+")


class Settings(SimpleNamespace):
    """A checked configuration, or a part of one, whose attributes are the file's keys. It can't be changed."""

    def _refuse(self, *_):
        raise AttributeError("a configuration can't be changed")

    __setattr__ = __delattr__ = _refuse
    __hash__ = None


class Source(Settings):
    """A source's configuration."""


def _typed(kind: Any, value: Any, where: str) -> Any:
    if isinstance(kind, list):
        if not isinstance(value, (list, tuple)):
            raise TypeError(f"{where}: a list is wanted, got {value!r}")
        return [_typed(kind[0], x, f"{where}[{i}]") for i, x in enumerate(value)]
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if not isinstance(value, kind) or kind is int and isinstance(value, bool):
        raise TypeError(f"{where}: {kind.__name__} is wanted, got {value!r}")
    return dict(value) if kind is dict else value


def _filled(keys: dict[str, Any], data: dict[str, Any], where: str) -> dict[str, Any]:
    """data with defaults; a key that isn't known is a mistake, and a null stands for the default."""
    if strange := sorted(map(str, set(data) - set(keys))):
        raise TypeError(f"unknown key in {where or 'the source'}: {', '.join(strange)}")
    out: dict[str, Any] = {}
    for key, spec in keys.items():
        place, value = f"{where}.{key}".lstrip("."), data.get(key)
        if isinstance(spec, dict):
            out[key] = Settings(**_filled(spec, value or {}, place))
        elif value is None and spec[1] is NEEDED:
            raise TypeError(f"{place} is missing")
        else:
            out[key] = _typed(spec[0], spec[1] if value is None else value, place)
    return out


def source_from_dict(data: dict[str, Any]) -> Source:
    source = Source(**_filled(KEYS, data, ""))
    if not _SAFE_NAME.fullmatch(source.name):
        raise ValueError(f"name: letters, digits, dot, hyphen and underscore only (it names a folder), got {source.name!r}")
    for key in ("include", "exclude"):
        for i, pattern in enumerate(getattr(source, key)):
            try:
                re.compile(pattern)
            except re.error as e:
                raise ValueError(f"{key}[{i}]: {e}") from e
    return source


def profile(source: Source, name: str) -> dict[str, Any]:
    """A copy of a profile of the prepare part."""
    profiles = source.prepare.get("profiles") or {}
    if name not in profiles:
        raise KeyError(f"unknown prepare profile {name!r} of {source.name}; there are: {', '.join(sorted(profiles)) or 'none'}")
    return {**profiles[name]}


def load_source(path: str | Path) -> Source:
    import yaml

    with open(path, encoding="utf-8") as f:
        return source_from_dict(yaml.safe_load(f) or {})
