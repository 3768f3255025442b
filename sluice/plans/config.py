"""Configuration: defaults, a file's table, the environment; later ones win."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from sluice.catalog import Catalog
from sluice.operators.guard import Guard

PREFIX = "SLUICE_"


@dataclass(frozen=True)
class Config:
    presets: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    action: str = "flag"
    min_confidence: float = 0.0
    require_context: bool = False
    allow_texts: tuple[str, ...] = ()
    secret: str = ""

    def updated(self, values: Mapping) -> Config:
        known = {f.name: f.type for f in fields(self)}
        out = {}
        for k, v in values.items():
            if k not in known:
                raise ValueError(f"unknown setting {k}")
            now = getattr(self, k)
            if isinstance(now, tuple):
                v = tuple(x.strip() for x in v.split(",") if x.strip()) if isinstance(v, str) else tuple(v)
            elif isinstance(now, bool):
                v = str(v).lower() in ("1", "true", "yes", "on")
            elif isinstance(now, float):
                v = float(v)
            out[k] = v
        return replace(self, **out)

    @staticmethod
    def parse(text: str, kind: str = "json") -> Config:
        return Config().updated(json.loads(text) if kind == "json" else tomllib.loads(text).get("tool", {}).get("sluice", {}))

    def with_environment(self, env: Mapping[str, str]) -> Config:
        names = {f.name for f in fields(self)}
        return self.updated({k.removeprefix(PREFIX).lower(): v for k, v in env.items() if k.startswith(PREFIX) and k.removeprefix(PREFIX).lower() in names})

    def guard(self, base: Catalog | None = None) -> Guard:
        catalog = base or Catalog.core()
        wanted = {p.category for n in self.presets for p in catalog.preset(n).patterns} | set(self.categories)
        return Guard(catalog.only(wanted) if wanted else catalog, self.action, self.min_confidence, {}, self.allow_texts, (), self.require_context, secret=self.secret.encode())
