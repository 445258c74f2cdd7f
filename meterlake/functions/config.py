"""Settings of the accounting: aliases, overrides, billing, time zone, history cutoff. Read and saved as JSON."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Override:
    """A provider for records of a harness, optionally of one raw provider or model and from (incl.) to (excl.) a time."""

    harness: str
    provider: str
    raw_provider: str | None = None
    raw_model: str | None = None
    since: str | None = None
    until: str | None = None


@dataclass(frozen=True)
class ModelAlias:
    model: str
    canonical: str
    owner: str | None = None
    provider: str | None = None


@dataclass(frozen=True)
class Config:
    provider_aliases: tuple[tuple[str, str], ...] = ()
    overrides: tuple[Override, ...] = ()
    model_aliases: tuple[ModelAlias, ...] = ()
    project_aliases: tuple[tuple[str, tuple[str, ...]], ...] = ()
    billing: tuple[tuple[str, str], ...] = ()
    zone: str = "Europe/Berlin"
    cutoff: str | None = None
    ignore_path_case: bool = True
    sources: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def from_dict(raw: dict) -> Config:
        return Config(
            provider_aliases=tuple((a["raw"], a["display"]) for a in raw.get("provider_aliases", ())),
            overrides=tuple(Override(**o) for o in raw.get("overrides", ())),
            model_aliases=tuple(ModelAlias(**a) for a in raw.get("model_aliases", ())),
            project_aliases=tuple((a["name"], tuple(a["paths"])) for a in raw.get("project_aliases", ())),
            billing=tuple((b["provider"], b["mode"]) for b in raw.get("billing", ())),
            zone=raw.get("zone", "Europe/Berlin"),
            cutoff=raw.get("cutoff"),
            ignore_path_case=raw.get("ignore_path_case", True),
            sources=dict(raw.get("sources", {})),
        )

    def to_dict(self) -> dict:
        return {
            "provider_aliases": [{"raw": r, "display": d} for r, d in self.provider_aliases],
            "overrides": [asdict(o) for o in self.overrides],
            "model_aliases": [asdict(a) for a in self.model_aliases],
            "project_aliases": [{"name": n, "paths": list(p)} for n, p in self.project_aliases],
            "billing": [{"provider": p, "mode": m} for p, m in self.billing],
            "zone": self.zone,
            "cutoff": self.cutoff,
            "ignore_path_case": self.ignore_path_case,
            "sources": self.sources,
        }


def load(path: str | Path) -> Config:
    """The config of a file; a file that cannot be read is set aside and the defaults are used."""
    path = Path(path)
    if not path.exists():
        return Config()
    try:
        return Config.from_dict(json.loads(path.read_text()))
    except (ValueError, KeyError, TypeError):
        path.replace(path.with_suffix(".broken.json"))
        return Config()


def save(config: Config, path: str | Path) -> None:
    """Replaces the file in one step."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_suffix(".part")
    part.write_text(json.dumps(config.to_dict(), indent=2, sort_keys=True))
    os.replace(part, path)
