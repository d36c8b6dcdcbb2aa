"""Column references and sort keys."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T


def col(name: str) -> Column:
    """Reference a top-level column whatever characters its name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_list(names: str | Iterable[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def require(df: DataFrame, names: Iterable[str]) -> None:
    """Raise when ``df`` lacks one of ``names``."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")


def unused_name(df: DataFrame, base: str) -> str:
    name = base
    while name in df.columns:
        name += "_"
    return name


@dataclass(frozen=True)
class SortKey:
    """One sort column. Nulls count as the smallest value in either direction."""

    name: str
    descending: bool = False

    def column(self) -> Column:
        c = col(self.name)
        return c.desc_nulls_last() if self.descending else c.asc_nulls_first()

    def reversed(self) -> SortKey:
        return SortKey(self.name, not self.descending)

    def follows(self, bound: Column) -> Column:
        """True where the row sorts strictly after ``bound`` on this key alone."""
        c = col(self.name)
        low, high = (c, bound) if self.descending else (bound, c)
        return F.coalesce(low < high, low.isNull() & high.isNotNull())


def sort_keys(order_by) -> list[SortKey]:
    """Read ``"a"``, ``("a", "desc")`` or a list of those; an unknown order is ascending."""
    if not order_by:
        raise ValueError("order_by is required: a DataFrame has no row order of its own")
    if isinstance(order_by, (str, SortKey)) or (
        isinstance(order_by, tuple) and len(order_by) == 2 and order_by[1] in ("asc", "desc")
    ):
        order_by = [order_by]
    keys = []
    for item in order_by:
        if isinstance(item, SortKey):
            keys.append(item)
        elif isinstance(item, str):
            keys.append(SortKey(item))
        else:
            keys.append(SortKey(item[0], str(item[1]).lower() == "desc"))
    return keys


def sort_columns(keys: Sequence[SortKey]) -> list[Column]:
    return [k.column() for k in keys]


def _has_map(data_type: T.DataType) -> bool:
    if isinstance(data_type, (T.MapType, T.VariantType)):
        return True
    if isinstance(data_type, T.ArrayType):
        return _has_map(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return any(_has_map(f.dataType) for f in data_type.fields)
    return False


def row_hash(df: DataFrame) -> Column:
    """Hash of a whole row by value: the same on every run and every retry."""
    return F.xxhash64(*[col(f.name) for f in df.schema.fields if not _has_map(f.dataType)])
