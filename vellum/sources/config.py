"""Settings, from keyword arguments or a TOML file; keys that aren't known are ignored."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    engine: str = "text"
    scripts: bool = True
    enrich: bool = True
    crop_dpi: float = 200.0
    crop_padding: float = 4.0
    keep_versions: int = 1
    label: str = "vellum"
    model: str | None = None
    ocr_model: str | None = None
    out: str = os.environ.get("VELLUM_OUT", "out")

    @classmethod
    def load(cls, path: str) -> Config:
        with open(path, "rb") as f:
            said = tomllib.load(f)
        return replace(cls(), **{k: v for k, v in said.items() if k in {x.name for x in fields(cls)}})
