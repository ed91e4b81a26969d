"""Settings of an installation, from a properties file."""

from __future__ import annotations

from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Config:
    """Where things lie: sources of projects, saved graphs, written documents; how a project's paths become names; what isn't read."""

    source_dir: str = ""
    graph_dir: str = ""
    json_dir: str = ""
    project_prefix: str = ""
    project_drop: str = ""
    skip_dirs: tuple[str, ...] = ()
    skip_names: tuple[str, ...] = ()

    @classmethod
    def read(cls, path: str) -> Config:
        """Settings of ``name=value`` lines; ``#`` starts a comment line, lists are separated by commas, other names are an error."""
        known = {f.name: f.type for f in fields(cls)}
        given: dict = {}
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            name, _, value = (x.strip() for x in line.partition("="))
            if name not in known:
                raise ValueError(f"unknown setting {name}")
            given[name] = tuple(v.strip() for v in value.split(",") if v.strip()) if "tuple" in known[name] else value
        return cls(**given)
