"""Settings, read from a JSON file."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path

#: Read in this order when no path is given.
SEARCHED = ("logquarry.json", "/etc/logquarry/config.json")
LARGEST_FILE = 1 << 20


@dataclass(frozen=True)
class ScrapeJob:
    paths: tuple[str, ...]
    job: str = "default"
    labels: tuple[tuple[str, str], ...] = ()

    def as_mapping(self) -> dict:
        return {"job": self.job, "paths": self.paths, "labels": dict(self.labels)}


@dataclass(frozen=True)
class Config:
    data_dir: str = "./data"
    index_dir: str = "./index"
    chunk_max_bytes: int = 10_485_760
    compression_enabled: bool = True
    watch_files: tuple[str, ...] = ()
    scrape_configs: tuple[ScrapeJob, ...] = ()
    batch_size: int = 256
    flush_interval_ms: int = 1000
    tail_poll_ms: int = 250
    #: Empty: read offsets are not exported.
    positions_path: str = ""
    http_host: str = "0.0.0.0"
    http_port: int = 3100
    max_connections: int = 128
    default_query_limit: int = 1000
    log_level: str = "info"

    def jobs(self) -> list[dict]:
        """Scrape jobs as mappings; files to watch that no job names are a job of their own without labels."""
        named = {p for j in self.scrape_configs for p in j.paths}
        return [j.as_mapping() for j in self.scrape_configs] + [{"paths": [p]} for p in self.watch_files if p not in named]


_TYPES = {f.name: type(f.default) for f in fields(Config) if f.name not in ("watch_files", "scrape_configs")}


def parse_config(text: str) -> Config:
    """Unknown keys and values of another type are passed over; defaults take their place."""
    raw = json.loads(text)
    known = {k: v for k, v in raw.items() if k in _TYPES and type(v) is _TYPES[k]}
    jobs = tuple(
        ScrapeJob(tuple(j.get("paths", ())), j.get("job", "default"), tuple((k, v) for k, v in j.get("labels", {}).items() if isinstance(v, str)))
        for j in raw.get("scrape_configs", ())
    )
    return Config(**known, watch_files=tuple(raw.get("watch_files", ())), scrape_configs=jobs)


def load_config(path: str | None = None) -> Config:
    """The file named, which must be there; else the first of SEARCHED that can be read; else defaults."""
    if path is not None:
        return _read(Path(path))
    for candidate in SEARCHED:
        try:
            return _read(Path(candidate))
        except (OSError, ValueError):
            continue
    return Config()


def _read(path: Path) -> Config:
    if path.stat().st_size > LARGEST_FILE:
        raise ValueError(f"{path} is larger than {LARGEST_FILE} bytes")
    return parse_config(path.read_text())


@dataclass
class Positions:
    """Read offsets of files, exported as a JSON object. An empty path keeps them in memory."""

    path: str = ""
    offsets: dict[str, int] = field(default_factory=dict)

    def load(self) -> Positions:
        try:
            found = json.loads(Path(self.path).read_text()) if self.path else {}
        except (OSError, ValueError):
            found = {}
        self.offsets |= {k: v for k, v in found.items() if isinstance(v, int) and v >= 0}
        return self

    def save(self) -> None:
        if self.path:
            target = Path(self.path)
            target.parent.mkdir(parents=True, exist_ok=True)
            part = target.with_name(target.name + ".tmp")
            part.write_text(json.dumps(self.offsets))
            part.replace(target)
