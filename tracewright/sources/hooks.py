"""What a host tells a hook: JSON on its input, and variables that one process leaves to the next."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from tracewright.sources.config import pick

Prefixes = tuple[str, str]  #: of variables: the new name, the old one


def transcript_path(text: str | None) -> str:
    """The finished session's transcript, from a hook's input; '' if the input is no object or names none."""
    try:
        told = json.loads(text or "")
    except ValueError:
        return ""
    path = told.get("transcript_path") if isinstance(told, dict) else None
    return path if isinstance(path, str) else ""


@dataclass(frozen=True)
class Enrichment:
    """What the process that labels one session is told."""

    file: str = ""
    transcripts: str = ""
    url: str = ""
    token: str = ""
    settings: str = ""
    api_key: str = ""
    labels: dict[str, str] = field(default_factory=dict)
    ship_facts: bool = True


def of_environment(env: Mapping[str, str], prefixes: Prefixes, host_key: str = "") -> Enrichment:
    """The channel's variables: labels that do not parse are none, facts are shipped unless the flag is 0, and the host's own key stands in for a blank one."""
    get = lambda name: pick(env, name, prefixes) or ""
    try:
        labels = json.loads(get("PROJECT_LABELS") or "{}")
    except ValueError:
        labels = {}
    return Enrichment(get("FILE"), get("TRANSCRIPTS"), get("URL"), get("TOKEN"), get("SETTINGS"), get("API_KEY") or env.get(host_key, ""), labels if isinstance(labels, dict) else {}, get("SHIP_FACTS") != "0")


def to_environment(told: Enrichment, prefix: str) -> dict[str, str]:
    """The variables that of_environment reads back. Only what the child needs: settings are read from their folder, not passed."""
    return {
        f"{prefix}FILE": told.file, f"{prefix}TRANSCRIPTS": told.transcripts, f"{prefix}URL": told.url, f"{prefix}TOKEN": told.token, f"{prefix}SETTINGS": told.settings,
        f"{prefix}API_KEY": told.api_key, f"{prefix}PROJECT_LABELS": json.dumps(told.labels), f"{prefix}SHIP_FACTS": "1" if told.ship_facts else "0",
    }
