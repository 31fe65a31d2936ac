"""Active and inactive index columns: an inactive one has an underscore before its name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The index columns of object tables, in the order in which tables list them.
ORDER = ("roi", "object", "label", "channel", "channel_ref", "stain", "acquisition")


def _columns(df: DataFrame, names: Sequence[str]) -> list:
    return [F.col(f"`{n}`") for n in names]


def active(df: DataFrame, order: Sequence[str] = ORDER) -> list[str]:
    """Index columns of a table by their plain names, in table order."""
    return [n for n in df.columns if n in order]


def inactive(df: DataFrame, order: Sequence[str] = ORDER) -> list[str]:
    return [n for n in df.columns if n.startswith("_") and n[1:] in order]


def others(df: DataFrame, order: Sequence[str] = ORDER) -> list[str]:
    known = {*active(df, order), *inactive(df, order)}
    return [n for n in df.columns if n not in known]


def arranged(df: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Active index columns in their fixed order, then the others, then inactive ones."""
    return df.select(*_columns(df, sorted(active(df, order), key=list(order).index)), *_columns(df, others(df, order)), *_columns(df, inactive(df, order)))


def activate(df: DataFrame, names: Sequence[str], order: Sequence[str] = ORDER) -> DataFrame:
    """Inactive columns of these plain names become active, behind those that are."""
    chosen = [n for n in names if f"_{n}" in inactive(df, order)]
    rest = [n for n in inactive(df, order) if n[1:] not in chosen]
    return df.select(*_columns(df, active(df, order)), *[F.col(f"`_{n}`").alias(n) for n in chosen], *_columns(df, others(df, order)), *_columns(df, rest))


def deactivate(df: DataFrame, names: Sequence[str] | None = None, order: Sequence[str] = ORDER) -> DataFrame:
    """Active columns of these names, all by default, become inactive and go last."""
    chosen = [n for n in active(df, order) if names is None or n in names]
    kept = [n for n in active(df, order) if n not in chosen]
    return df.select(*_columns(df, kept), *_columns(df, others(df, order)), *_columns(df, inactive(df, order)), *[F.col(f"`{n}`").alias(f"_{n}") for n in chosen])


def set_index(df: DataFrame, names: Sequence[str], order: Sequence[str] = ORDER) -> DataFrame:
    """Only these are active."""
    return activate(deactivate(df, order=order), names, order)


def join(left: DataFrame, right: DataFrame, how: str = "full", order: Sequence[str] = ORDER) -> DataFrame:
    """Join on the index columns that are active in both."""
    shared = [n for n in active(left, order) if n in active(right, order)]
    if not shared:
        raise ValueError("no index column is active in both tables")
    return left.join(right, shared, how)
