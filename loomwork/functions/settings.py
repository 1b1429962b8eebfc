"""Settings from files and options: search, precedence, dotted look-ups, rule files."""

from __future__ import annotations

import json
from pathlib import Path


def load(path: str | Path) -> dict | list:
    """A JSON file, or a YAML file where the yaml package is installed."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith((".yml", ".yaml")):
        try:
            import yaml
        except ImportError:
            raise RuntimeError(f"{path}: the yaml package is not installed; write the settings as JSON") from None
        return yaml.safe_load(text) or {}
    return json.loads(text) if text.strip() else {}


def save(settings: dict, path: str | Path) -> None:
    Path(path).write_text(json.dumps(settings, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def find_upwards(name: str, start: str | Path) -> Path | None:
    """The file ``name`` in a folder or the nearest folder above it."""
    at = Path(start).resolve()
    return next((p / name for p in (at, *at.parents) if (p / name).is_file()), None)


def merge(*layers: dict | None) -> dict:
    """Settings over each other, the last over all; dicts merge, other values replace. None as a value says nothing."""
    out: dict = {}
    for layer in layers:
        for k, v in (layer or {}).items():
            if isinstance(v, dict) and isinstance(out.get(k), dict):
                out[k] = merge(out[k], v)
            elif v is not None:
                out[k] = merge(v) if isinstance(v, dict) else v
    return out


def get(settings: dict, dotted: str, default: object = None) -> object:
    """``get(s, "a.b")`` is ``s["a"]["b"]``, or the default where a step is missing."""
    for step in dotted.split("."):
        if not isinstance(settings, dict) or step not in settings:
            return default
        settings = settings[step]
    return settings


def put(settings: dict, dotted: str, value: object) -> dict:
    """A copy of the settings with one value set, folders of it made as needed."""
    step, _, rest = dotted.partition(".")
    inner = settings.get(step)
    return {**settings, step: put(inner if isinstance(inner, dict) else {}, rest, value) if rest else value}


def engine_rules(path: str | Path) -> list[tuple[str, str, int]]:
    """Classification rules of a file: {"rules": {family: [{"pattern": p, "score": n}, ...]}}. They take the place of the built-in ones."""
    rules = get(load(path), "rules", {})
    return [(family, r["pattern"], int(r.get("score", 1))) for family, rows in rules.items() for r in rows]


def rewrite_rules(path: str | Path) -> list[tuple]:
    """Rewrite rules of a file, to be added to the built-in ones: {"rules": [{"name", "pattern", "replacement", "priority", "version", "regex", "auto_fixable"}]}."""
    return [(r["name"], r["pattern"], r["replacement"], int(r.get("priority", 0)), str(r.get("version", "3.0")), bool(r.get("regex", True)), bool(r.get("auto_fixable", True))) for r in get(load(path), "rules", [])]
