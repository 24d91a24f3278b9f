"""Columns that a table has already under a name that an operator works with."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame


def set_aside(table: DataFrame, names: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(table with its columns of these names called otherwise, function that names them back)."""
    wanted = {n.lower() for n in names}
    away = {c: f"own column {i} {c}" for i, c in enumerate(table.columns) if c.lower() in wanted}
    if not away:
        return table, lambda df: df
    return table.withColumnsRenamed(away), lambda df: df.withColumnsRenamed({v: k for k, v in away.items()})
