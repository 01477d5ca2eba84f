"""Configuration, from YAML."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from driftloom.plans.dialects import DRIVERS


class ConfigError(ValueError):
    """A configuration that cannot be used; the message names the field."""


@dataclass
class Source:
    """One side: a directory of Parquet tables (driver "parquet") or a database."""

    driver: str = "parquet"
    host: str = ""
    port: int = 0
    user: str = ""
    password: str = ""
    database: str = ""
    path: str = ""


@dataclass
class Config:
    prod: Source
    dev: Source
    output_dir: str = "./diff-output"
    ignore_tables: list[str] = field(default_factory=list)
    ignore_columns: list[str] = field(default_factory=list)
    ignore_views: list[str] = field(default_factory=list)
    ignore_routines: list[str] = field(default_factory=list)
    ignore_triggers: list[str] = field(default_factory=list)
    ignore_sequences: list[str] = field(default_factory=list)
    primary_keys: dict[str, list[str]] = field(default_factory=dict)
    default_strategy: str = "manual"
    strategies: list[tuple[str, str]] = field(default_factory=list)
    allow: dict[str, bool] = field(default_factory=dict)
    fetch_size: int = 10_000
    partitions: int = 8
    check_keys: bool = True
    ranges: int = 0

    def strategy_for(self, table: str) -> str:
        """The first override of that exact name, or the default."""
        return next((s for t, s in self.strategies if t == table), self.default_strategy)

    @property
    def fingerprint(self) -> str:
        """What a resumed run must share with the one before; passwords don't matter."""
        own = asdict(self)
        for side in ("prod", "dev"):
            own[side].pop("password")
        return hashlib.sha256(json.dumps(own, sort_keys=True, default=str).encode()).hexdigest()


def parse_config(raw: dict) -> Config:
    raw = raw or {}
    sides = {}
    for side in ("prod", "dev"):
        if side not in raw:
            raise ConfigError(f"{side} is missing")
        known = {k: v for k, v in raw[side].items() if k in Source.__dataclass_fields__}
        sides[side] = Source(**known)
        driver = sides[side].driver
        if driver not in (*DRIVERS, "parquet"):
            raise ConfigError(f"{side}.driver must be one of {', '.join((*DRIVERS, 'parquet'))}")
        if driver in ("parquet", "sqlite") and not (sides[side].path or sides[side].database):
            raise ConfigError(f"{side}.path is missing")
        if driver not in ("parquet", "sqlite") and not (sides[side].host and sides[side].database):
            raise ConfigError(f"{side}.host and {side}.database are needed")
    ignore, resolution, migration = raw.get("ignore") or {}, raw.get("conflict_resolution") or {}, raw.get("migration") or {}
    strategy = resolution.get("default_strategy") or "manual"
    overrides = [(x["table"], x["strategy"]) for x in resolution.get("strategies") or []]
    for s in (strategy, *(s for _, s in overrides)):
        if s not in ("ours", "theirs", "manual"):
            raise ConfigError(f"unknown strategy {s!r}")
    performance = raw.get("performance") or {}
    return Config(
        sides["prod"], sides["dev"], (raw.get("output") or {}).get("dir") or "./diff-output",
        *[list(ignore.get(k) or []) for k in ("tables", "columns", "views", "routines", "triggers", "sequences")],
        dict(raw.get("primary_keys") or {}), strategy, overrides, {k: bool(v) for k, v in migration.items() if k.startswith("allow_")},
        int(performance.get("hash_batch_size") or 10_000), int(performance.get("max_parallel_tables") or 8), bool(performance.get("check_keys", True)), int(performance.get("key_ranges") or 0),
    )


def load_config(path: str) -> Config:
    import yaml

    with open(path, encoding="utf-8") as f:
        return parse_config(yaml.safe_load(f))
