"""Settings of a data source: guards, time zone and naming, from a file and the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from pathlib import Path

ENV_VARIABLE = "TAMARACK_ENV"

TEMPLATE = """# one block per environment; TAMARACK_ENV chooses, dev by default
dev:
  adapter: parquet
  database: data
  config:
    change_db: false
    change_data: false
    time_zone: UTC
"""


@dataclass
class Settings:
    adapter: str = "parquet"
    database: str = ""
    host: str | None = None
    port: int | None = None
    username: str | None = None
    password: str | None = None
    change_db: bool = False
    change_data: bool = False
    time_zone: str = "UTC"
    log_level: str = "WARN"
    table_prefix: str | None = None
    nullable_fk_left: bool = False
    options: dict = field(default_factory=dict)

    @classmethod
    def from_yaml(cls, path: str, env: str | None = None) -> Settings:
        """The block of ``env`` (else of the environment variable, else dev); ``config:`` overrides settings."""
        blocks = parse_yaml(Path(path).read_text(encoding="utf-8"))
        env = env or os.environ.get(ENV_VARIABLE, "dev")
        if env not in blocks:
            raise ValueError(f"{path} has no block {env}; it has {', '.join(blocks)}")
        values = dict(blocks[env])
        values |= values.pop("config", None) or {}
        known = {f.name for f in fields(cls)} - {"options"}
        return cls(**{k: v for k, v in values.items() if k in known and v is not None}, options={k: v for k, v in values.items() if k not in known})

    def apply(self, spark) -> None:
        spark.conf.set("spark.sql.session.timeZone", self.time_zone)
        spark.sparkContext.setLogLevel({"warning": "WARN", "warn": "WARN"}.get(self.log_level.lower(), self.log_level.upper()))


def scaffold(folder: str) -> str:
    """Make ``folder`` with a template ``connection.yml``, unless it has one; returns its path."""
    path = Path(folder) / "connection.yml"
    if not path.exists():
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(TEMPLATE, encoding="utf-8")
    return str(path)


def parse_yaml(text: str) -> dict:
    """Nested ``key: value`` maps by indentation, with comments and quotes; what such files need."""
    root: dict = {}
    levels = [(-1, root)]
    for number, line in enumerate(text.splitlines(), 1):
        body = line.split(" #")[0].rstrip() if not line.lstrip().startswith("#") else ""
        if not body.strip():
            continue
        indent, (key, colon, value) = len(body) - len(body.lstrip()), body.strip().partition(":")
        if not colon:
            raise ValueError(f"line {number}: key: value is expected, not {line.strip()!r}")
        while levels[-1][0] >= indent:
            levels.pop()
        if value.strip():
            levels[-1][1][key.strip()] = scalar(value.strip())
        else:
            child: dict = {}
            levels[-1][1][key.strip()] = child
            levels.append((indent, child))
    return root


def scalar(value: str):
    if value[0] in "\"'" and value[-1] == value[0]:
        return value[1:-1]
    lower = value.lower()
    if lower in ("true", "false", "null", "~"):
        return {"true": True, "false": False}.get(lower)
    return int(value) if value.lstrip("-").isdigit() else value


#: Settings by the name of their source; a model's source name selects one.
SOURCES: dict[str, Settings] = {}


def connect(name: str, settings: Settings) -> Settings:
    SOURCES[name] = settings
    return settings


def connection(name: str) -> Settings:
    if name not in SOURCES:
        raise KeyError(f"no source {name}; there are {', '.join(SOURCES) or 'none'}")
    return SOURCES[name]
