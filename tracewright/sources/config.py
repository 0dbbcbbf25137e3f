"""Settings of a sender: where they lie, what they say, and the secret salt. Plain Python at the edge."""

from __future__ import annotations

import json
import os
import secrets
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from tracewright.functions import vocab as V


def settings_dir(env: Mapping[str, str], home: Path, names: tuple[str, str], variables: tuple[str, str]) -> Path:
    """The folder of settings: a variable that is not empty, new name before old; a folder that is there, new name before old; else the new one."""
    for v in variables:
        if env.get(v):
            return Path(env[v])
    there = [home / n for n in names if (home / n).is_dir()]
    return there[0] if there else home / names[0]


def pick(env: Mapping[str, str], suffix: str, prefixes: tuple[str, str]) -> str | None:
    """A variable under its new prefix, else under its old one. An empty value is a value."""
    return next((env[p + suffix] for p in prefixes if p + suffix in env), None)


def without_prefix(env: Mapping[str, str], prefix: str) -> dict[str, str]:
    """The variables that a child process may see."""
    return {k: v for k, v in env.items() if not k.startswith(prefix)}


@dataclass(frozen=True)
class Config:
    url: str
    token: str
    labels: dict[str, str] = field(default_factory=dict)
    classify: str = "on"
    api_key: str = ""
    tier: str = V.DEFAULT_TIER
    warning: str | None = None

    @property
    def usage(self) -> bool:
        return V.TIERS[self.tier][1]

    @property
    def facts(self) -> bool:
        return V.TIERS[self.tier][2]


def load(path: Path, *, env_tier: str | None = None) -> Config | None:
    """The settings in a JSON file; none unless it has a url and a token that are texts."""
    try:
        raw = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return None
    if not isinstance(raw, dict) or not isinstance(raw.get("url"), str) or not isinstance(raw.get("token"), str):
        return None
    labels, key = raw.get("project_labels"), raw.get("anthropic_api_key")
    given = env_tier if env_tier is not None else raw.get("tier") if isinstance(raw.get("tier"), str) else None
    tier = V.DEFAULT_TIER if given is None else given.lower() if given.lower() in V.TIERS else "off"
    warning = None if given is None or given.lower() in V.TIERS else f'"{given}" is not a valid tier: nothing is shared'
    return Config(raw["url"], raw["token"], labels if isinstance(labels, dict) else {}, "off" if raw.get("classify") == "off" else "on", key if isinstance(key, str) else "", tier, warning)


def load_salt(folder: Path) -> str:
    """The salt of this machine, made once. Whoever creates the file first wins; a blank file is repaired."""
    file = Path(folder) / "salt"
    folder.mkdir(parents=True, exist_ok=True)
    for _ in range(2):
        try:
            if held := file.read_text().strip():
                return held
            file.unlink()
        except FileNotFoundError:
            pass
        fresh = secrets.token_hex(32)
        try:
            with os.fdopen(os.open(file, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o600), "w") as f:
                f.write(fresh)
            return fresh
        except FileExistsError:
            continue
    return file.read_text().strip()
