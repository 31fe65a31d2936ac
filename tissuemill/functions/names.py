"""Column-name grammar: families of feature columns, selector algebra, globs, renames."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The name families of wide feature tables, in the order in which they are tried.
FAMILIES = {
    "index": r"^(idx\..*|roi|object|label|parent\..*)$",
    "correlation": r"^[^|_]+\|[^|_]+_.+$",
    "density": r"^(RAD|KNN|KNNd|DELAUNAY|TOUCH)(:[^_]*)_.+$",
    "distance": r"^[A-Za-z0-9.]+-\d+_.+$",
    "intensity": r"^[A-Za-z0-9.-]+\.\d+_.+$",
    "label": r"^[A-Z][A-Za-z]+(-[a-z0-9]+)*([.-].*)?$",
}


# Further selections of wide feature tables and of tables with dotted index columns; they overlap.
SELECTIONS = {
    "full_index": r"^(well|roi|parent[^A-Za-z0-9_].+|object|label|channel|stain|acquisition|channel_pair)$",
    "site_index": r"^(roi|parent[^A-Za-z0-9_].+|object|label)$",
    "object_index": r"^(roi|object|label)$",
    "hierarchy": r"^parent[^A-Za-z0-9_].+$",
    "density": r"^((DELAUNAY|TOUCH):[0-9]+_Count|RAD:[0-9]+([^A-Za-z0-9_][0-9]+)?_Count|KNNd:[0-9]+_.*)$",
    "neighborhood": r"^((DELAUNAY|TOUCH|KNN|KNNd)s?:[0-9]+_.*|RADs?:[0-9]+([^A-Za-z0-9_][0-9]+)?_.*)$",
    "distance": r"^(([A-Za-z0-9-]+)[^A-Za-z0-9_]([0-9]+)_)?({features})_?({functions})([^A-Za-z0-9_][xyz])?$|^(([A-Za-z0-9-]+)[^A-Za-z0-9_]([0-9]+)_)?({functions})_?({features})([^A-Za-z0-9_][xyz])?$",
    "idx": r"^idx[.]",
    "idx_roi": r"^idx[.]roi",
    "idx_object_type": r"^idx[.]o",
    "idx_label": r"^idx[.]label",
    "idx_label_object": r"^idx[.](o|roi|label)$",
    "idx_parent": r"^idx[.](o[.]parent|roi|label[.]parent)$",
    "idx_child": r"^idx[.](o[.]child|roi|label[.]child)$",
    "empty": r"(?!)",
}
# What a distance column names, in either order.
_DISTANCES = {"features": "Centroid|Minimum|Maximum|Median|MinimumIndex|MaximumIndex|Mean", "functions": "DistanceToBorder|DistanceAlongX|DistanceAlongY|DistanceAlongZ"}


def chosen(columns: Sequence[str], *selections: str) -> list[str]:
    """Names in any of the given :data:`SELECTIONS`, in the columns' order; ``features`` are all but the full index and what no family knows, ``meta`` the rest."""
    def fits(name: str, which: str) -> bool:
        if which in ("features", "meta"):
            known = family(name) not in ("index", "meta") or any(fits(name, x) for x in ("density", "neighborhood", "distance"))
            return (known and not fits(name, "full_index")) == (which == "features")
        if which not in SELECTIONS:
            raise ValueError(f"no such selection: {which}")
        pattern = SELECTIONS[which]
        for key, names in _DISTANCES.items():
            pattern = pattern.replace(f"{{{key}}}", names)
        return re.search(pattern, name) is not None

    return [n for n in columns if any(fits(n, s) for s in selections)]


def family(name: str) -> str:
    """The first family whose pattern a column name fits, or ``meta``."""
    return next((f for f, p in FAMILIES.items() if re.match(p, name)), "meta")


def select(df: DataFrame, *families: str) -> list[str]:
    """Names of the columns of the given families, in table order."""
    return [c for c in df.columns if family(c) in families]


def matching(df: DataFrame, pattern: str) -> list[str]:
    """Names that fit a regular expression somewhere."""
    return [c for c in df.columns if re.search(pattern, c)]


def of_type(df: DataFrame, *kinds: type[T.DataType]) -> list[str]:
    """Names of the columns of the given types."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def numeric(df: DataFrame) -> list[str]:
    return of_type(df, T.NumericType)


def union(*sets: Iterable[str]) -> list[str]:
    """Names in any of the lists, first seen first."""
    return list(dict.fromkeys(n for s in sets for n in s))


def intersection(first: Iterable[str], *others: Iterable[str]) -> list[str]:
    keep = [set(o) for o in others]
    return [n for n in first if all(n in k for k in keep)]


def difference(first: Iterable[str], *others: Iterable[str]) -> list[str]:
    gone = {n for o in others for n in o}
    return [n for n in first if n not in gone]


def complement(df: DataFrame, names: Iterable[str]) -> list[str]:
    return difference(df.columns, names)


def glob(names: Sequence[str], patterns: Sequence[str]) -> list[str]:
    """Names that fit any glob, or with ``!`` before every glob, none of them.

    All or none of the patterns must be negated and each must fit some name.
    """
    negated = {p.startswith("!") for p in patterns}
    if len(negated) > 1:
        raise ValueError("negate all patterns or none")
    plain = [p.lstrip("!") for p in patterns]
    for p in plain:
        if not fnmatch.filter(names, p):
            raise ValueError(f"{p} fits no name")
    hit = {n for p in plain for n in fnmatch.filter(names, p)}
    return [n for n in names if (n in hit) != (negated == {True})]


def where_glob(df: DataFrame, column: str, patterns: Sequence[str]) -> DataFrame:
    """The rows whose column fits any glob, or with ``!`` before every glob, none: :func:`glob` for the values of a column.

    The globs become regular expressions on the column, and one aggregate tells whether each fits some row; no value comes to the driver.
    """
    from pyspark.sql import functions as F

    negated = {p.startswith("!") for p in patterns}
    if len(negated) > 1:
        raise ValueError("negate all patterns or none")
    plain = [p.lstrip("!") for p in patterns]
    fits = [F.col(f"`{column}`").rlike("^" + fnmatch.translate(p).replace("\\Z", "$").replace("\\z", "$")) for p in plain]
    seen = df.agg(*[F.bool_or(f).alias(f"p{i}") for i, f in enumerate(fits)]).first()
    for p, found in zip(plain, seen):
        if not found:
            raise ValueError(f"{p} fits no value of {column}")
    hit = F.coalesce(F.array_contains(F.array(*fits), True), F.lit(False))
    return df.where(~hit if negated == {True} else hit)


def glob_pairs(names: Sequence[str], left: Sequence[str], right: Sequence[str]) -> list[tuple[str, str]]:
    """Product of two glob selections."""
    return [(a, b) for a in glob(names, left) for b in glob(names, right)]


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename the columns that are there."""
    return df.withColumnsRenamed({a: b for a, b in mapping.items() if a in df.columns})


def dotted_channels(name: str) -> str:
    """``A-0`` to ``A.0`` and ``A.0-B.1`` to ``A.0|B.1`` at the start of a name."""
    head, sep, tail = name.partition("_")
    head = re.sub(r"([A-Za-z][A-Za-z0-9]*)-(\d+)(?=$|-)", r"\1.\2", head)
    return re.sub(r"(\.\d+)-(?=[A-Za-z])", r"\1|", head) + sep + tail


def numeric_and_nested(df: DataFrame) -> list[str]:
    return of_type(df, T.NumericType, T.StructType)


def without_structs(df: DataFrame) -> DataFrame:
    return df.select(*[f"`{c}`" for c in difference(df.columns, of_type(df, T.StructType))])


def keys_first(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    """Cast the key columns that are there and move them first."""
    from pyspark.sql import functions as F

    keys = [k for k in casts if k in df.columns]
    return df.select(*[F.col(f"`{k}`").cast(casts[k]).alias(k) for k in keys], *[F.col(f"`{c}`") for c in df.columns if c not in keys])
