"""Nesting and unnesting of structs, wide and tall feature tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def c(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col(f"`{name}`")


def unnest(df: DataFrame, columns: Sequence[str] | None = None, sep: str = ".", levels: int | None = 1) -> DataFrame:
    """Structs as one column per field, named ``{column}{sep}{field}``; all structs by default, ``levels`` None for every level."""
    while True:
        wanted = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StructType) and (columns is None or f.name in columns)]
        if not wanted or levels == 0:
            return df
        out = []
        for f in df.schema.fields:
            out += [c(f.name).getField(g).alias(f"{f.name}{sep}{g}") for g in f.dataType.names] if f.name in wanted else [c(f.name)]
        df, levels = df.select(*out), None if levels is None else levels - 1
        columns = None if columns is None else [x for x in df.columns if any(x.startswith(f"{w}{sep}") for w in wanted)]


def depth(kind: T.DataType) -> int:
    """Levels of structs in a type."""
    return 1 + max((depth(f.dataType) for f in kind.fields), default=0) if isinstance(kind, T.StructType) else 0


def unnest_to(df: DataFrame, level: int, sep: str = ".") -> DataFrame:
    """Unnest until at most ``level`` levels of structs are left; negative: that many levels from the deepest."""
    deepest = max((depth(f.dataType) for f in df.schema.fields), default=0)
    return unnest(df, sep=sep, levels=max(0, -level if level < 0 else deepest - level))


def nest(df: DataFrame, sep: str = ".", single: bool = False, keep: str = "drop", level: int | None = None, whole: str | None = None) -> DataFrame:
    """Names that share the part before a ``sep`` as one struct; groups of one stay flat unless ``single``.

    The last ``sep`` parts, or the ``level``-th from the left (0 the first), if a name
    has so many; ``keep`` leaves the separator ``before`` on the struct's name,
    ``after`` on the fields' names, or drops it. Names that fit ``whole`` stay as they are.
    """
    def parts(name: str) -> tuple[str, str, str]:
        if whole and re.search(whole, name):
            return name, "", ""
        if level is None:
            return name.rpartition(sep) if sep in name else (name, "", "")
        pieces = name.split(sep)
        return (sep.join(pieces[: level + 1]), sep, sep.join(pieces[level + 1 :])) if len(pieces) > level + 1 else (name, "", "")

    groups: dict[str, list[str]] = {}
    for name in df.columns:
        groups.setdefault(parts(name)[0], []).append(name)
    out = []
    for head, names in groups.items():
        nested = all(parts(n)[1] for n in names) and (single or len(names) > 1)
        field = lambda n: (sep if keep == "after" else "") + parts(n)[2]
        out += [F.struct(*[c(n).alias(field(n)) for n in names]).alias(head + (sep if keep == "before" else ""))] if nested else [c(n) for n in names]
    return df.select(*out)


def nest_at(df: DataFrame, sep: str = "_", at: int = -1) -> DataFrame:
    """Names as structs by their ``at``-th part (negative: from the end), fields by the other parts; names with one part stay flat."""
    groups: dict[str, list[tuple[str, str]]] = {}
    flat = []
    for name in df.columns:
        pieces = name.split(sep)
        if len(pieces) < 2 or not -len(pieces) <= at < len(pieces):
            flat.append(name)
            continue
        head = pieces.pop(at)
        groups.setdefault(head, []).append((sep.join(pieces), name))
    return df.select(*[c(n) for n in flat], *[F.struct(*[c(n).alias(f) for f, n in fields]).alias(g) for g, fields in groups.items()])


def nest_by(df: DataFrame, pattern: str, on: int = 1) -> DataFrame:
    """Names that fit ``pattern`` (two groups) as structs named by group ``on``, fields by the other."""
    groups: dict[str, list[tuple[str, str]]] = {}
    rest = []
    for name in df.columns:
        if m := re.fullmatch(pattern, name):
            groups.setdefault(m[on], []).append((m[3 - on], name))
        else:
            rest.append(name)
    return df.select(*[c(n) for n in rest], *[F.struct(*[c(n).alias(f) for f, n in fields]).alias(g) for g, fields in groups.items()])


def to_wide(df: DataFrame, key: Sequence[str], on: Sequence[str], sep: str = "_", prefix: bool = True, values: Sequence[str] | None = None, most_values: int = 5000) -> DataFrame:
    """One row per key; each value of ``on`` (several joined by ``-``, nulls skipped) before every feature's name.

    Rows whose pivot value is null vanish; a key that repeats within a value fails the
    query. Without rows: the key columns alone. ``values`` saves the scan for the
    distinct values, of which more than ``most_values`` raise ``ValueError``.
    """
    features = [x for x in df.columns if x not in {*key, *on}]
    tall = df.withColumn("_on", F.when(F.coalesce(*[c(x) for x in on]).isNotNull(), F.concat_ws("-", *[c(x).cast("string") for x in on]))).where("_on is not null")
    values = sorted(r[0] for r in tall.select("_on").distinct().limit(most_values + 1).collect()) if values is None else list(values)
    if len(values) > most_values:
        raise ValueError(f"over {most_values} values to pivot on")
    if not values:
        return df.select(*[c(k) for k in key]).limit(0)
    name = lambda v, f: f"{v}{sep}{f}" if prefix else f"{f}{sep}{v}"
    cells = [F.first(F.when(F.col("_on") == v, c(f)), ignorenulls=True).alias(name(v, f)) for v in values for f in features]
    wide = tall.groupBy(*[c(k) for k in key]).agg(*cells, *[F.count(F.when(F.col("_on") == v, 1)).alias(f"_rows_{i}") for i, v in enumerate(values)])
    once = F.greatest(*[F.col(f"_rows_{i}") for i in range(len(values))], F.lit(0)) <= 1
    checked = F.when(once, c(key[0])).otherwise(F.raise_error(F.lit(f"a key of {list(key)} repeats within a value of {list(on)}")).cast(df.schema[key[0]].dataType))
    return wide.select(checked.alias(key[0]), *[c(k) for k in key[1:]], *[c(name(v, f)) for v in values for f in features])


def to_tall(df: DataFrame, key: Sequence[str], pattern: str = r"(.+?)_(.+)", name: str = "channel", drop_null: bool = False) -> DataFrame:
    """One row per key and distinct prefix of the feature names, in one pass; columns that do not fit are dropped.

    ``drop_null`` leaves out the rows of a prefix in which any feature is null. Without a fitting name the input returns.
    """
    blocks: dict[str, dict[str, str]] = {}
    for x in df.columns:
        if x not in key and (m := re.fullmatch(pattern, x)):
            blocks.setdefault(m[1], {})[m[2]] = x
    if not blocks:
        return df
    fields = list(dict.fromkeys(f for b in blocks.values() for f in b))
    kinds = {f: next(df.schema[b[f]].dataType for b in blocks.values() if f in b) for f in fields}
    rows = []
    for p, b in blocks.items():
        whole = F.lit(True)
        for f in b:
            whole = whole & c(b[f]).isNotNull()
        rows.append(F.struct(F.lit(p).alias(name), *[(c(b[f]) if f in b else F.lit(None).cast(kinds[f])).alias(f) for f in fields], whole.alias("_whole")))
    out = df.select(*[c(k) for k in key], F.explode(F.array(*rows)).alias("_r"))
    out = out.where("_r._whole") if drop_null else out
    return out.select(*[c(k) for k in key], *[F.col("_r").getField(x).alias(x) for x in (name, *fields)])


def named_value(column: str) -> Column:
    """A column as a struct of its name and value."""
    return F.struct(F.lit(column).alias("name"), c(column).alias("value"))


def split_column(df: DataFrame, column: str, names: Sequence[str], sep: str) -> DataFrame:
    """Parts of a string column as columns; missing parts are null."""
    parts = F.split(c(column), re.escape(sep))
    return df.withColumns({n: F.get(parts, F.lit(i)) for i, n in enumerate(names)}).drop(column)


def split_channel(df: DataFrame, column: str = "channel") -> DataFrame:
    """``stain`` and integer ``acquisition`` from ``stain.acquisition``."""
    out = split_column(df, column, ("stain", "acquisition"), ".")
    return out.withColumn("acquisition", F.expr("try_cast(acquisition as int)"))


def split_channel_pair(df: DataFrame, reference: str, column: str = "channel") -> DataFrame:
    """``channel`` and ``channel_ref`` of a pair; the reference, on either side, is the second, else a copy of the first."""
    a, b = F.get(F.split(c(column), r"\|"), F.lit(0)), F.get(F.split(c(column), r"\|"), F.lit(1))
    first = F.when(a == reference, b).otherwise(a)
    return df.withColumns({"_first": first, "_ref": F.when((a == reference) | (b == reference), F.lit(reference)).otherwise(first)}).drop(column).withColumnsRenamed({"_first": "channel", "_ref": "channel_ref"})


def melt(df: DataFrame, key: Sequence[str], columns: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """One row per key and column."""
    return df.unpivot([c(k) for k in key], [c(x) for x in columns], name, value)
