"""Settings from the environment; a number that cannot be read falls back to its default."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

PREFIX = "SPARKSCOPE_"


@dataclass(frozen=True)
class Settings:
    store: str = "~/.sparkscope"
    max_file_bytes: int = 524_288
    result_limit: int = 5
    session_key: str = "default"
    respect_gitignore: bool = True
    embed_model: str = "hashing-256"
    embed_batch: int = 32
    summary_model: str = ""

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        found = {}
        for f in fields(cls):
            value = env.get(f"{PREFIX}{f.name.upper()}")
            if value is None:
                continue
            if isinstance(f.default, bool):
                found[f.name] = value.strip().lower() in ("1", "true", "yes")
            elif isinstance(f.default, int):
                if value.strip().lstrip("-").isdigit():
                    found[f.name] = int(value)
            else:
                found[f.name] = value
        return cls(**found)
