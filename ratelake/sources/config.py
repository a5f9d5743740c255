"""Settings and lender configuration, read on the driver: both are small by nature."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from ..functions.lexicon import DEFAULT, Lexicon
from ..functions.parsing import substitute
from . import yaml

LENDER = "config_idx int, id string, lender_name string, abbreviation string, lender_type string, domain string, website string, jurisdiction string, enabled boolean, volatile boolean, frequency string, priority int, collection_urls array<string>"
DEFAULT_LENDER = {"id": "lender-1", "lender_name": "Default Lender", "abbreviation": "DEF", "domain": "example.com", "enabled": True, "frequency": "daily"}


@dataclass(frozen=True)
class Settings:
    schema_version: str = "2.0.0"
    verify: bool = True
    min_rate: float = 0.0
    max_rate: float = 50.0
    search_quota: int = 100
    per_thousand: float = 5.0
    snapshot_html: bool = False
    max_age_hours: float = 24.0
    extra: dict = field(default_factory=dict)

    @classmethod
    def from_text(cls, text: str, env: dict | None = None) -> "Settings":
        """From YAML, its sections nested as they may; placeholders are filled from the environment
        and values are cast to the fields' types.  Other settings are in ``extra`` by their path,
        as "section.key"."""
        known, extra = {}, {}
        for path, v in _leaves(yaml.parse(substitute(text, env)) or {}):
            k = path.rsplit(".", 1)[-1]
            f = cls.__dataclass_fields__.get(k)
            if f is None or k == "extra":
                extra[path] = v
            elif v:
                known[k] = v.lower() in ("true", "1", "yes", "on") if f.type == "bool" else {"float": float, "int": int}.get(f.type, str)(v)
        return cls(**known, extra=extra)


def _leaves(x, path: str = ""):
    for k, v in x.items():
        at = f"{path}.{k}" if path else k
        if isinstance(v, dict):
            yield from _leaves(v, at)
        else:
            yield at, v


def load_lexicon(*paths: str) -> Lexicon:
    """The vocabulary of the first of the YAML files that is there; categories that it lacks, and
    a file that can't be read, leave the built-in ones."""
    for path in paths:
        if os.path.isfile(path):
            try:
                with open(path, encoding="utf-8") as f:
                    return DEFAULT.loaded(yaml.parse(f.read()) or {})
            except (OSError, ValueError, AttributeError, TypeError):
                break
    return DEFAULT


def load_env(text: str) -> dict[str, str]:
    """``NAME=value`` lines; NUL characters are dropped."""
    out = {}
    for line in text.replace("\0", "").splitlines():
        line = line.strip()
        if line and not line.startswith("#") and "=" in line:
            k, v = line.split("=", 1)
            out[k.strip()] = v.strip().strip("'\"")
    return out


def apply_env(values: dict[str, str]) -> None:
    for k, v in values.items():
        os.environ.setdefault(k, v)


def parse_lenders(text: str | None) -> list[dict]:
    """A list, or ``{"lenders": [...]}``, with other names for keys and defaults; what can't be
    read gives the one default lender."""
    try:
        data = json.loads(text or "")
        rows = data.get("lenders", []) if isinstance(data, dict) else data
        if not rows:
            raise ValueError("no lenders")
    except ValueError:
        rows = [DEFAULT_LENDER]
    out = []
    for i, r in enumerate(rows):
        name = r.get("lender_name") or r.get("name") or "Unknown"
        out.append(
            {
                "config_idx": i,
                "id": str(r.get("id", i + 1)),
                "lender_name": name,
                "abbreviation": r.get("abbreviation") or name[:3].upper(),
                "lender_type": r.get("lender_type"),
                "domain": r.get("domain"),
                "website": r.get("website") or r.get("url"),
                "jurisdiction": r.get("jurisdiction", "AU"),
                "enabled": bool(r.get("enabled", True)),
                "volatile": bool(r.get("volatile", False)),
                "frequency": r.get("frequency", "daily"),
                "priority": r.get("priority"),
                "collection_urls": r.get("collection_urls") or [],
            }
        )
    return out


@dataclass(frozen=True)
class Lenders:
    rows: tuple

    @classmethod
    def load(cls, text: str | None) -> "Lenders":
        return cls(tuple(parse_lenders(text)))

    def add(self, row: dict) -> "Lenders":
        new = parse_lenders(json.dumps([row]))[0] | {"config_idx": len(self.rows)}
        if any(r["lender_name"].lower() == new["lender_name"].lower() for r in self.rows):
            raise ValueError(f"lender {new['lender_name']} exists")
        return Lenders(self.rows + (new,))

    def update(self, name: str, **fields) -> "Lenders":
        return Lenders(tuple(r | fields if r["lender_name"].lower() == name.lower() else r for r in self.rows))

    def enable(self, name: str, on: bool = True) -> "Lenders":
        return self.update(name, enabled=on)

    def to_json(self) -> str:
        return json.dumps({"lenders": [{k: v for k, v in r.items() if k != "config_idx"} for r in self.rows]}, indent=2)

    def frame(self, spark: SparkSession) -> DataFrame:
        order = [c.split()[0] for c in LENDER.split(", ")]
        return spark.createDataFrame([tuple(r[c] for c in order) for r in self.rows], LENDER)


def enabled(df: DataFrame) -> DataFrame:
    return df.where("enabled")


def volatile(df: DataFrame) -> DataFrame:
    return df.where("enabled AND volatile")


def of_frequency(df: DataFrame, frequency: str) -> DataFrame:
    return df.where((df.frequency == frequency) & df.enabled)


def with_settings(base: Settings, **fields) -> Settings:
    return replace(base, **fields)
