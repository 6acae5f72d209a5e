"""Arguments and settings as clients send them."""

from __future__ import annotations

import json
import os
from pathlib import Path
from typing import Any


def text(args: dict, *names: str, default: str = "") -> str:
    """The first of some names that is there, as stripped text."""
    for n in names:
        if args.get(n) is not None:
            return str(args[n]).strip()
    return default


def number(args: dict, name: str, default: int, low: int = 0, high: int = 1 << 31) -> int:
    """A whole number within bounds; fractions are cut, what is no number gives the default."""
    v = args.get(name)
    if isinstance(v, bool) or v is None:
        return default
    try:
        return min(max(int(float(v)), low), high)
    except (TypeError, ValueError):
        return default


def fraction(args: dict, name: str, default: float) -> float:
    """A number."""
    try:
        return float(args[name])
    except (KeyError, TypeError, ValueError):
        return default


def flag(args: dict, name: str, default: bool = False) -> bool:
    """A switch: true, "true", "1" and 1 turn it on."""
    v = args.get(name)
    return default if v is None else v is True or str(v).strip().lower() in ("true", "1", "yes")


def strings(args: dict, *names: str) -> list[str]:
    """A list, or text with commas, without blanks."""
    for n in names:
        v = args.get(n)
        if isinstance(v, str):
            return [x.strip() for x in v.split(",") if x.strip()]
        if isinstance(v, (list, tuple)):
            return [str(x).strip() for x in v if str(x).strip()]
    return []


def settings(folder: str = ".", env: dict[str, str] | None = None) -> dict[str, str]:
    """WEFTLINE_* from a ``.env`` file, with the environment winning."""
    found: dict[str, str] = {}
    path = Path(folder, ".env")
    if path.is_file():
        for line in path.read_text(encoding="utf-8").splitlines():
            k, eq, v = line.strip().removeprefix("export ").partition("=")
            if eq and not k.startswith("#"):
                found[k.strip()] = v.strip().strip("'\"")
    found |= dict(os.environ if env is None else env)
    return {k.removeprefix("WEFTLINE_").lower(): v for k, v in found.items() if k.startswith("WEFTLINE_")}


def clamp_timeout(seconds: int | None) -> int:
    """Seconds that a rebuild may take: 300 unless given, from 30 to 1800."""
    return min(max(seconds or 300, 30), 1800)


def dumps(value: Any) -> str:
    """Indented JSON."""
    return json.dumps(value, indent=2, ensure_ascii=False, default=str)
