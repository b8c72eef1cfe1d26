"""Driver-side settings: merge, override and flatten nested dicts. Not tables."""

from __future__ import annotations

import copy
import json
from typing import Any


def merged(base: dict, over: dict) -> dict:
    """over on top of base, dicts merged in depth; neither is changed."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def parsed(text: str) -> Any:
    """bool, null, number, list or object as JSON says; '~' is null; else the text itself. Nothing is evaluated."""
    if text.strip().lower() in ("~", "none", "null"):
        return None
    try:
        return json.loads(text.strip().lower() if text.strip().lower() in ("true", "false") else text)
    except ValueError:
        return text


def overridden(config: dict, assignment: str) -> dict:
    """config with 'a.b.c=value' applied."""
    path, equals, value = assignment.partition("=")
    if not equals or not path:
        raise ValueError(f"not an override: {assignment!r}")
    out: Any = parsed(value)
    for part in reversed(path.split(".")):
        out = {part: out}
    return merged(config, out)


def flat(config: dict, prefix: str = "") -> dict[str, Any]:
    out: dict[str, Any] = {}
    for k, v in config.items():
        out |= flat(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def load(*paths: str, overrides: list[str] | None = None) -> dict:
    """YAML files merged in order, then overrides."""
    import yaml

    out: dict = {}
    for path in paths:
        with open(path) as lines:
            out = merged(out, yaml.safe_load(lines) or {})
    for one in overrides or []:
        out = overridden(out, one)
    return out


def said(config: dict, depth: int = 1) -> str:
    """The config as lines of text, nested parts in brackets and further in."""
    blank = " " * (2 * depth)
    lines = [f"{blank}{k}:[\n{said(v, depth + 1)}{blank}]\n" if isinstance(v, dict) else f"{blank}{k}: {v}\n" for k, v in config.items()]
    return "".join(lines)
