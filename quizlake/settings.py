"""Where the bank and its inputs lie: from the environment, else from a file of KEY=VALUE lines, else by default."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


@dataclass(frozen=True)
class Settings:
    """Folders in any file system that Spark reads. On a cluster both must be shared ones."""

    bank_root: str = f"file://{ROOT}/bank"
    data_dir: str = f"file://{ROOT}/data"


def lines_of(path: Path) -> dict[str, str]:
    """The values of a file of KEY=VALUE lines, by lower-case key; empty lines and comments say nothing. An absent file has none."""
    out = {}
    for line in path.read_text().splitlines() if path.is_file() else ():
        key, equals, value = line.strip().removeprefix("export ").partition("=")
        if not equals or key.startswith("#"):
            continue
        value = value.strip()
        if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
            value = value[1:-1]
        out[key.strip().lower()] = value
    return out


def read(environ: Mapping[str, str] | None = None, file: Path = ROOT / ".env") -> Settings:
    """Names count in either case; names of no setting are ignored."""
    given = lines_of(file) | {k.lower(): v for k, v in (os.environ if environ is None else environ).items()}
    return Settings(**{k: given[k] for k in Settings.__dataclass_fields__ if k in given})
