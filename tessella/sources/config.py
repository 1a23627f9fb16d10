"""Configuration from TOML, with unknown keys refused; and a file name for each repository."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from ..functions.cron import Schedule
from ..functions.scalars import parse_duration, parse_size
from ..operators.retention import Policy
from .lists import patterns
from .objects import parse_location


class ConfigError(ValueError):
    pass


@dataclass
class Job:
    schedule: Schedule
    text: str


@dataclass
class Config:
    location: tuple[str, str]
    sources: list[str]
    exclude: list = field(default_factory=list)
    larger_than: int | None = None
    one_file_system: bool = False
    policy: Policy | None = None
    grace_seconds: int = 72 * 3600
    jobs: dict[str, Job] = field(default_factory=dict)


_KEYS = {"repository": {"location"}, "backup": {"sources", "exclude", "exclude_larger_than", "one_file_system", "schedule"},
         "forget": {"last", "within", "hourly", "daily", "weekly", "monthly", "yearly", "schedule"}, "prune": {"grace", "schedule"}}


def load(text: str) -> Config:
    data = tomllib.loads(text)
    for section, body in data.items():
        if section not in _KEYS or not isinstance(body, dict):
            raise ConfigError(f"unknown section {section!r}")
        if extra := sorted(set(body) - _KEYS[section]):
            raise ConfigError(f"unknown keys in [{section}]: {', '.join(extra)}")
    try:
        backup, forget, prune = (data.get(s, {}) for s in ("backup", "forget", "prune"))
        if not backup.get("sources"):
            raise ConfigError("[backup] needs sources")
        counts = {k: v for k, v in forget.items() if k not in ("schedule", "within")}
        if "within" in forget:
            counts["within_seconds"] = parse_duration(forget["within"])
        return Config(
            parse_location(data.get("repository", {}).get("location", "")), list(backup["sources"]), patterns("\n".join(backup.get("exclude", []))),
            parse_size(str(backup["exclude_larger_than"])) if "exclude_larger_than" in backup else None, bool(backup.get("one_file_system", False)), Policy(**counts) if counts else None,
            parse_duration(prune["grace"]) if "grace" in prune else 72 * 3600, {s: Job(Schedule(b["schedule"]), b["schedule"]) for s, b in (("backup", backup), ("forget", forget), ("prune", prune)) if "schedule" in b})
    except ConfigError:
        raise
    except (ValueError, TypeError) as e:
        raise ConfigError(str(e)) from e


def state_name(url: str) -> str:
    """The FNV-1a hash (64 bits) of a repository's address, in hex: a file name for its state."""
    h = 0xCBF29CE484222325
    for b in url.encode():
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"
