"""Named extensions: transforms of DataFrames, with settings and a manifest.

An extension is registered under its kind (``tool``, ``pipe``, ``filter`` or ``action``) and name.  Its
function takes the DataFrame and a context with the settings, merged for the user.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any

from pyspark.sql import DataFrame

KINDS = ("tool", "pipe", "filter", "action")


@dataclass(frozen=True)
class Context:
    user: dict[str, Any] = field(default_factory=dict)
    settings: Any = None
    emit: Callable[[dict], None] | None = None

    def status(self, description: str, done: bool = False) -> None:
        if self.emit is not None:
            self.emit({"type": "status", "data": {"description": description, "done": done}})


@dataclass(frozen=True)
class Extension:
    kind: str
    name: str
    apply: Callable[[DataFrame, Context], DataFrame]
    settings: Any = None  # a dataclass with defaults
    manifest: dict[str, str] = field(default_factory=dict)
    citation: bool = False
    descriptor: dict[str, str] = field(default_factory=dict)  # of an action: id, name, icon, description


class Plugins:
    def __init__(self):
        self._held: dict[tuple[str, str], Extension] = {}

    def register(self, extension: Extension) -> Extension:
        if extension.kind not in KINDS:
            raise ValueError(f"kind must be one of {', '.join(KINDS)}")
        self._held[extension.kind, extension.name] = extension
        return extension

    def names(self, kind: str) -> list[str]:
        return sorted(n for k, n in self._held if k == kind)

    def get(self, kind: str, name: str) -> Extension:
        return self._held[kind, name]

    def run(self, kind: str, name: str, df: DataFrame, user: dict | None = None, emit=None, **overrides) -> DataFrame:
        """The extension's transform; overrides replace the settings that they name."""
        e = self.get(kind, name)
        return e.apply(df, Context(user or {}, merged(e.settings, overrides), emit))

    def chain(self, kind: str, df: DataFrame, **context) -> DataFrame:
        """All extensions of a kind, in the order of their names."""
        for n in self.names(kind):
            df = self.run(kind, n, df, **context)
        return df


def merged(settings: Any, overrides: dict[str, Any]) -> Any:
    """Settings of one user: known fields replaced, others refused."""
    if settings is None or not is_dataclass(settings):
        return overrides or settings
    unknown = set(overrides) - {f.name for f in fields(settings)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return replace(settings, **overrides)
