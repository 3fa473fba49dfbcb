"""Settings from the environment, with a .env file beneath it."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path

PREFIX = "SEDIMENTA_"


def read_env_file(path: str = ".env") -> dict[str, str]:
    """Assignments of an env file; blank lines, comments and lines without = are skipped."""
    p, out = Path(path), {}
    if p.exists():
        for line in p.read_text("utf-8").splitlines():
            line = line.strip()
            if line and not line.startswith("#") and "=" in line:
                k, v = line.split("=", 1)
                out[k.strip()] = v.strip().strip("\"'")
    return out


@dataclass(frozen=True)
class Settings:
    data_dir: str = "data"
    sample: int = 2000
    workers: int = 8
    per_category: int = 25
    seed: str = "42"

    @classmethod
    def load(cls, env_file: str = ".env") -> Settings:
        """Defaults, then the file, then the environment."""
        values = {**read_env_file(env_file), **os.environ}
        kinds = {f: type(getattr(cls, f)) for f in cls.__dataclass_fields__}
        return cls(**{f: kinds[f](values[PREFIX + f.upper()]) for f in kinds if PREFIX + f.upper() in values})
