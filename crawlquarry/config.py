"""Rule pack: load, merge, validate."""

from __future__ import annotations

import re
import tomllib
from importlib import resources
from pathlib import Path
from typing import Any

SEVERITIES = ("high", "medium", "low", "info")
LEVELS = ("error", "warning", "info")


def default_config() -> str:
    """The default rule pack as TOML text."""
    return resources.files("crawlquarry").joinpath("rules/default.toml").read_text(encoding="utf-8")


def merge(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """Tables are merged key by key; everything else, arrays too, is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def _check_regex(where: str, pattern: str) -> None:
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"{where}: bad regular expression {pattern!r}: {e}") from e


def parse_bucket_spec(spec: str) -> list[list[tuple[str, str]]]:
    """`a | b` alternatives of `part + part`; a part is host:REGEX, segment:N or path:REGEX."""
    out = []
    for alternative in spec.split(" | "):
        parts = []
        for part in alternative.split(" + "):
            kind, _, arg = part.strip().partition(":")
            if kind not in ("host", "segment", "path") or not arg:
                raise ValueError(f"bad bucket part {part!r}")
            if kind == "segment":
                if not arg.isdigit() or int(arg) < 1:
                    raise ValueError(f"bad segment number in {part!r}")
            else:
                _check_regex("bucket", arg)
            parts.append((kind, arg))
        out.append(parts)
    return out


def validate(config: dict[str, Any]) -> dict[str, Any]:
    """The same config; ValueError with the entry's name for anything that can't be compiled."""
    categories = {c["id"] for c in config["security"].get("category", [])}
    for s in config["security"].get("signature", []):
        name = f"security signature {s.get('reason', s.get('category'))!r}"
        if s["severity"] not in SEVERITIES:
            raise ValueError(f"{name}: bad severity {s['severity']!r}")
        if s["category"] not in categories:
            raise ValueError(f"{name}: unknown category {s['category']!r}")
        if not s.get("keywords") and not s.get("pattern"):
            raise ValueError(f"{name}: needs keywords or a pattern")
        if s.get("pattern"):
            _check_regex(name, s["pattern"])
    for p in config["security"].get("ignore", []):
        _check_regex("security ignore", p)
    for p in config.get("platform", []):
        for x in (*p.get("strong", []), *p.get("weak", []), *p.get("comments", [])):
            _check_regex(f"platform {p['name']!r}", x)
    for g in config.get("generator", []):
        for x in g["comments"]:
            _check_regex(f"generator {g['name']!r}", x)
    for c in config.get("cloud", []):
        _check_regex(f"cloud {c['provider']!r}", c["host"])
        if c.get("bucket"):
            try:
                parse_bucket_spec(c["bucket"])
            except ValueError as e:
                raise ValueError(f"cloud {c['provider']!r}: {e}") from e
    for a in config.get("api", []):
        _check_regex(f"api {a['kind']!r}", a["pattern"])
    for ident, level in config["rules"].get("levels", {}).items():
        if level not in LEVELS:
            raise ValueError(f"rule {ident!r}: bad level {level!r}")
    for section in ("hosts", "data", "comments"):
        for k, v in config.get(section, {}).items():
            if isinstance(v, str):
                _check_regex(f"{section}.{k}", v)
    return config


def load(*overrides: str | Path | dict[str, Any]) -> dict[str, Any]:
    """The default pack with user packs (paths, TOML texts or dicts) merged over it, validated."""
    config = tomllib.loads(default_config())
    for o in overrides:
        if isinstance(o, dict):
            extra = o
        else:
            p = Path(o) if isinstance(o, Path) or "\n" not in str(o) else None
            extra = tomllib.loads(p.read_text(encoding="utf-8") if p else str(o))
        config = merge(config, extra)
    return validate(config)


def keyword_pattern(words: list[str]) -> str:
    """A path segment (or the start of a file name) that is one of the words."""
    return "(?:^|/)(?:" + "|".join(re.escape(w) for w in words) + r")(?:/|$|\*|\.)"
