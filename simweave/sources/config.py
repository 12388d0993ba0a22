"""Configuration of a scan: defaults, validation, file."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace

import pyarrow.fs as pafs

from simweave.sources.fs import kind, open_fs, read_text, write_text

FILE = "dryconfig.json"


@dataclass(frozen=True)
class Config:
    # defaults: fixed values, but for the source of vectors, which works offline
    excludedPaths: list[str] = field(default_factory=lambda: ["**/test/**"])
    excludedPairs: list[str] = field(default_factory=list)
    minLines: float = 3
    minBlockLines: float = 5
    threshold: float = 0.8
    embeddingSource: str = "hashed"
    contextLength: float = 2048
    enableLLMFilter: bool = True


def validate(raw: object) -> dict:
    """Known fields must have their type; others are let through."""
    if not isinstance(raw, dict):
        raise ValueError("config is invalid: not an object")
    kinds = {f.name: f.type for f in fields(Config)}
    wrong = []
    for name, value in raw.items():
        kind = kinds.get(name)
        good = {"list[str]": lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v), "float": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool), "str": lambda v: isinstance(v, str), "bool": lambda v: isinstance(v, bool)}
        if kind and not good[kind](value):
            wrong.append(f"{name} is not of type {kind}")
    if wrong:
        raise ValueError("config is invalid: " + "; ".join(wrong))
    return raw


def load(folder: str) -> Config:
    """The folder's file over the defaults; no file is all defaults. Any file system that :func:`open_fs` knows."""
    text = read_text(f"{folder}/{FILE}")
    raw = validate(json.loads(text)) if text is not None else {}
    known = {f.name for f in fields(Config)}
    return replace(Config(), **{k: v for k, v in raw.items() if k in known})


def save(folder: str, config: Config) -> None:
    write_text(f"{folder}/{FILE}", json.dumps(validate(asdict(config)), indent=2))


def ensure(folder: str) -> bool:
    """Write the defaults where the folder exists and has no file."""
    fs, path = open_fs(folder)
    if kind(fs, path) != pafs.FileType.Directory or kind(fs, f"{path}/{FILE}") != pafs.FileType.NotFound:
        return False
    save(folder, Config())
    return True
