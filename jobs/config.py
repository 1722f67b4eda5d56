"""Configurations of jobs: JSON objects over the defaults of a dataclass."""

from __future__ import annotations

import json
from dataclasses import fields
from typing import TypeVar

Settings = TypeVar("Settings")


def read(kind: type[Settings], path: str | None) -> Settings:
    """kind with the values of the file at path (on the machine of the command line), or its defaults. An unknown name is an
    error, so that a misspelt one isn't passed over."""
    if path is None:
        return kind()
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    unknown = sorted(set(given) - {x.name for x in fields(kind)})
    if unknown:
        raise ValueError(f"{path}: no such setting: {', '.join(unknown)}")
    return kind(**given)
