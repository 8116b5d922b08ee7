"""Settings from TOML, with defaults."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields

from ..functions.text import ADJACENT_BYTES, RESPONSE_BYTES


@dataclass(frozen=True)
class Settings:
    roots: dict[str, list[str]] = field(default_factory=dict)
    context_turns: int = 3
    context_max_tokens: int = 2000
    search_mode: str = "hybrid"
    response_bytes: int = RESPONSE_BYTES
    adjacent_bytes: int = ADJACENT_BYTES


def load_settings(text: str) -> Settings:
    """Unknown names are refused."""
    values = tomllib.loads(text)
    unknown = {*values} - {f.name for f in fields(Settings)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return Settings(**values)
