"""Settings, each from an environment variable CORPUSLOOM_<NAME> or a .env file, else the default."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path

PREFIX = "CORPUSLOOM_"


@dataclass(frozen=True)
class Settings:
    store: str = "corpusloom-store"
    repo: str = ""  # the scope where a call names none
    max_chars: int = 4000
    dim: int = 256
    batch: int = 32
    notes_model: str = "extractive"
    rollup_model: str = "extractive"
    include_bodies: bool = False
    num_ctx: int = 8192
    module_markers: tuple[str, ...] = ("pom.xml", "build.gradle", "build.gradle.kts", "package.json")
    docs_md_root: str = ""
    notes_root: str = ""
    wiki_url: str = ""
    wiki_email: str = ""
    wiki_token: str = ""
    wiki_format: str = "view"
    wiki_page_size: int = 50
    compat_accessors: bool = False


def _value(kind: str, text: str):
    if kind == "bool":
        return text.strip().lower() in ("1", "true", "yes", "on")
    if kind == "int":
        return int(text)
    return tuple(x.strip() for x in text.split(",") if x.strip()) if kind.startswith("tuple") else text


def load(env: dict[str, str] | None = None, dotenv: str = ".env") -> Settings:
    given: dict[str, str] = {}
    if Path(dotenv).is_file():
        for line in Path(dotenv).read_text(encoding="utf-8").splitlines():
            name, sep, value = line.partition("=")
            if sep and not name.strip().startswith("#"):
                given[name.strip()] = value.strip().strip("\"'")
    given |= os.environ if env is None else env
    return Settings(**{f.name: _value(f.type, given[PREFIX + f.name.upper()]) for f in fields(Settings) if PREFIX + f.name.upper() in given})
