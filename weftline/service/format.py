"""Results as compact text, at a level of detail."""

from __future__ import annotations

import re
from typing import Any

from weftline.service.args import dumps, number, text

MAX_ITEMS, MOST_ITEMS = 20, 200
LEVELS = ("summary", "files", "samples", "full")


def options(args: dict) -> dict[str, Any]:
    """detail, json and items. ``format`` chooses the serialisation only; ``raw`` asks for JSON at the given level."""
    detail = text(args, "detail", default="summary").lower()
    as_json = text(args, "format").lower() in ("json", "raw") or args.get("raw") is True
    return {"detail": detail if detail in LEVELS else "summary", "json": as_json, "items": number(args, "maxItems", MAX_ITEMS, 1, MOST_ITEMS)}


def one_line(value: Any, most: int = 160) -> str:
    """A value on one line, cut."""
    s = re.sub(r"\s+", " ", str(value)).strip()
    return s if len(s) <= most else s[: most - 3] + "..."


def row(item: Any) -> str:
    """One item: its path or name first, then what else it has."""
    if not isinstance(item, dict):
        return one_line(item)
    lead = [k for k in ("path", "name", "id", "symbol", "type") if item.get(k)][:1]
    rest = [f"{k}={one_line(v, 80)}" for k, v in item.items() if k not in lead and v not in (None, "", [], {})]
    return " ".join([str(item[k]) for k in lead] + rest)


def section(title: str, items: list, most: int) -> list[str]:
    """A title with the count, the first items and how many more there are."""
    out = [f"{title} ({len(items)})"] + [f"- {row(x)}" for x in items[:most]]
    return out + [f"+{len(items) - most} more"] * (len(items) > most)


def render(tool: str, result: dict[str, Any], args: dict) -> str:
    """A tool's result as the client wants it."""
    o = options(args)
    if o["json"]:
        return dumps(result)
    plain = {k: v for k, v in result.items() if not isinstance(v, (list, dict))}
    out = [f"# {tool}"] + ["  ".join(f"{k}: {one_line(v)}" for k, v in plain.items())] * bool(plain)
    for k, v in result.items():
        if isinstance(v, dict):
            out.append(f"{k}: {row(v)}")
        elif isinstance(v, list):
            out += section(k, v, min(o["items"], 5) if o["detail"] == "summary" and len(v) > 5 and "maxItems" not in args else o["items"])
    return "\n".join(out)
