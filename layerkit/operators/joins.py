"""Equi-joins.

Spark picks the physical join from table sizes; nothing is broadcast by hint, and
a side that ``salt`` repeats never is.
Partitions of a sort-merge join that a hot key makes too big are split at run
time (``session.configure``), but Spark does so only for a side whose rows an
outer join keeps, and for neither side of a full join. The hot keys of the other
sides are found by a sketch and dealt over several tasks by plan, in the same
single join. Splitting at run time also needs each side to be shuffled right
before the join, so a side that was aggregated by the join key is shuffled once
more; ``salt`` spreads a hot key by plan too.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from layerkit.functions.columns import as_list, col, require, row_hash, unused_name
from layerkit.session import estimated_bytes

# Join kinds of the source language; an unknown kind is left outer.
JOIN_KINDS = {
    "JoinKind.LeftOuter": "left",
    "JoinKind.Inner": "inner",
    "JoinKind.RightOuter": "right",
    "JoinKind.FullOuter": "outer",
    "JoinKind.LeftAnti": "left_anti",
    "JoinKind.RightAnti": "right_anti",
}
_HOW = set(JOIN_KINDS.values())


def join_kind(name: str) -> str:
    name = name.strip()
    return name if name in _HOW else JOIN_KINDS.get(name, "left")


# Bytes of a side from which its keys are looked at: below, one task takes even a single key.
HOT_BYTES = 256 << 20
# Tasks that a hot key is dealt over, hot keys of one side at most, and keys a sketch keeps count of.
HOT_TASKS, HOT_KEYS, _TRACKED = 32, 64, 10_000


def _keyed(df: DataFrame, keys: Sequence[str], mark: str, key_type) -> tuple[DataFrame, list[str]]:
    """Copy the keys under private names, in the type wanted, so that no reference is ambiguous."""
    names = [f"__{mark}{i}" for i in range(len(keys))]
    return df.withColumns({n: col(k).try_cast(key_type) if key_type else col(k) for n, k in zip(names, keys)}), names


def _condition(left: DataFrame, lk, right: DataFrame, rk) -> Column:
    return reduce(lambda a, b: a & b, [left[a] == right[b] for a, b in zip(lk, rk)])


def _common_types(left: DataFrame, lk, right: DataFrame, rk) -> list[T.DataType] | None:
    """Type in which the keys of both sides are compared; none where they are of different kinds."""
    found = []
    for a, b in zip(lk, rk):
        one, other = left.schema[a].dataType, right.schema[b].dataType
        if one != other:
            if not (isinstance(one, T.NumericType) and isinstance(other, T.NumericType)):
                return None
            one = left.select(col(a)).union(right.select(col(b))).schema[0].dataType
        found.append(one)
    return found


def _key_hash(names: Sequence[str], types: Sequence[T.DataType]) -> Column:
    # Zero has two signs that compare equal.
    return F.xxhash64(*[col(n).cast(t) + F.lit(0.0).cast(t) if isinstance(t, T.FractionalType) else col(n).cast(t) for n, t in zip(names, types)])


def hot_keys(df: DataFrame, hashed: Column, keyed: Column, most: int = HOT_KEYS, share: float | None = None) -> list[int | None]:
    """Hashes of the keys that hold ``share`` of the rows or more, by a frequent-item sketch; none stands for null keys.

    Tasks pass on their sketches only. A key's count is off by a share of the rows that is far below
    ``share``, which by default is a quarter of what one shuffle task gets.
    """
    found = df.select(F.when(keyed, hashed).alias("h")).agg(
        F.call_function("approx_top_k", F.col("h"), F.lit(most), F.lit(_TRACKED)).alias("top"),
        F.count(F.lit(1)).alias("n"), F.count("h").alias("keyed"),
    ).first()
    least = max(2, found.n * (share or 1 / (4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    hot = [r["item"] for r in found.top or [] if r["item"] is not None and r["count"] >= least]
    return hot + ([None] if found.n - found.keyed >= least else [])


def join_on(
    left: DataFrame,
    right: DataFrame,
    left_keys: str | Iterable[str],
    right_keys: str | Iterable[str] | None = None,
    how: str = "left",
    key_type: str | None = None,
    salt: int | None = None,
    unique_right: bool = False,
) -> DataFrame:
    """Join on one or more keys, whose names may differ.

    All columns of both sides are returned (for anti joins those of the kept
    side), so other names must not repeat. ``key_type`` brings both sides' keys
    to one type first, with unreadable keys matching nothing. ``salt=n`` spreads
    the left rows of every key over ``n`` tasks and repeats the right rows ``n``
    times, which are shuffled and never broadcast: for inner, left and anti joins with a hot key on the left. ``salt=1``
    repeats nothing; it only makes Spark shuffle a right side that is already
    laid out by the key, which splitting a hot key at run time needs.

    Each side stands in the plan once. Hot keys of sides that Spark does not
    split (the right one of a left join, the left one of a right join, both of a
    full join) are found first where the side is above :data:`HOT_BYTES`: one scan of
    its keys. Their rows are dealt over :data:`HOT_TASKS` tasks, and the rows of the
    other side with these keys repeated for each. A key that is hot is there, so
    whatever comes out of such a key without a match is a repetition, and is
    dropped. Rows with a null key match nothing and are dealt by their hash.
    ``unique_right`` says that the right side has one row per key at most: it is not
    looked at.
    """
    how = join_kind(how)
    lk = as_list(left_keys)
    rk = lk if right_keys is None else as_list(right_keys)
    if len(lk) != len(rk):
        raise ValueError("both sides need the same number of keys")
    require(left, lk)
    require(right, rk)
    if salt and how not in ("inner", "left", "left_anti", "right_anti"):
        raise ValueError("salt suits inner, left and anti joins")
    if how == "right_anti":
        return join_on(right, left, rk, lk, "left_anti", key_type, salt)
    anti = how == "left_anti"
    same = [b for a, b in zip(lk, rk) if a == b]
    clash = set(left.columns) & set(right.columns) - set(same)
    if clash and not anti:
        raise ValueError(f"both sides hold: {', '.join(sorted(clash))}; rename first")

    out_columns = list(left.columns) + ([] if anti else [c for c in right.columns if c not in same])
    a, ak = _keyed(left, lk, "l", key_type)
    b, bk = _keyed(right, rk, "r", key_type)
    if anti:
        b = b.select(*bk).distinct()
        salt = salt or 1
    elif same:
        b = b.drop(*same)
    if salt:
        spread = row_hash(left) if salt > 1 else F.xxhash64(*[col(k) for k in ak])
        a = a.withColumn("__lsalt", F.pmod(spread, F.lit(salt)).cast("int"))
        b = b.withColumn("__rsalt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        if salt > 1:
            # The optimizer's size estimate leaves the repetitions out, so it may broadcast what the driver cannot hold.
            b = b.hint("merge")
        joined = a.join(b, _condition(a, ak, b, bk) & (a["__lsalt"] == b["__rsalt"]), how)
    elif how in ("left", "right", "outer"):
        joined = _outer(a, ak, b, bk, how, row_hash(left), row_hash(right), unique_right)
    else:
        joined = a.join(b, _condition(a, ak, b, bk), how)
    if how in ("right", "outer"):
        # A shared key name shows whichever side has a value.
        pick = {n: F.coalesce(col(x), col(y)) for x, y, n in zip(ak, bk, lk) if n in same}
        # A key of two types keeps the left one's.
        shown = {n: c.cast(left.schema[n].dataType) for n, c in pick.items()}
        return joined.select(*[shown.get(n, col(n)).alias(n) for n in out_columns])
    return joined.select(*[col(n) for n in out_columns])


def _outer(a: DataFrame, ak, b: DataFrame, bk, how: str, a_row: Column, b_row: Column, unique_right: bool) -> DataFrame:
    """An outer join whose hot keys, on the sides that Spark does not split, are dealt by plan."""
    types = _common_types(a, ak, b, bk)
    keyed = {n: reduce(lambda x, y: x & y, [col(k).isNotNull() for k in keys]) for n, keys in (("a", ak), ("b", bk))}
    hashed = {n: _key_hash(keys, types) if types else None for n, keys in (("a", ak), ("b", bk))}
    hot = {"a": [], "b": []}
    for n, df, needed in (("a", a, how in ("right", "outer")), ("b", b, how in ("left", "outer") and not unique_right)):
        if types and needed and (estimated_bytes(df) or HOT_BYTES) >= HOT_BYTES:
            hot[n] = hot_keys(df, hashed[n], keyed[n])
    if not hot["a"] and not hot["b"]:
        return a.join(b, _condition(a, ak, b, bk), how)
    sides = {}
    for n, other, df, row in (("a", "b", a, a_row), ("b", "a", b, b_row)):
        marks = {f"__{n}_there": F.lit(True)}
        for owner in (n, other):
            if hot[owner]:
                is_hot = keyed[n] & hashed[n].isin([h for h in hot[owner] if h is not None])
                # The owner's rows of a hot key go to one task each, those of the other side to all.
                dealt = F.pmod(row, F.lit(HOT_TASKS)).cast("int")
                place = F.when(is_hot | ~keyed[n], dealt) if owner == n else F.when(is_hot, F.sequence(F.lit(0), F.lit(HOT_TASKS - 1)))
                marks |= {f"__{n}_hot_{owner}": is_hot, f"__{n}_at_{owner}": F.coalesce(place, F.lit(0) if owner == n else F.array(F.lit(0)))}
        df = df.withColumns(marks)
        if hot[other]:
            df = df.withColumn(f"__{n}_at_{other}", F.explode(f"__{n}_at_{other}"))
        sides[n] = df
    a, b = sides["a"], sides["b"]
    condition = _condition(a, ak, b, bk)
    for owner in ("a", "b"):
        if hot[owner]:
            condition = condition & (a[f"__a_at_{owner}"] == b[f"__b_at_{owner}"])
    joined = a.join(b, condition, how)
    if hot["b"] and how in ("left", "outer"):
        joined = joined.where(col("__b_there").isNotNull() | ~F.coalesce(col("__a_hot_b"), F.lit(False)))
    if hot["a"] and how in ("right", "outer"):
        joined = joined.where(col("__a_there").isNotNull() | ~F.coalesce(col("__b_hot_a"), F.lit(False)))
    return joined


def merge_queries(
    left: DataFrame,
    right: DataFrame,
    left_keys: str | Iterable[str],
    right_keys: str | Iterable[str],
    kind: str = "left",
    expand: Mapping[str, str] | None = None,
    aggregate: Mapping[str, Column] | None = None,
    key_type: str | None = None,
    salt: int | None = None,
) -> DataFrame:
    """Nested join, then use of the nested table.

    ``expand={column: alias}`` returns one row per match with the aliased right
    columns. ``aggregate={alias: aggregate}`` returns one row per left row with
    aggregates over its matches; the right side is aggregated by key before the
    join, so no nested table is ever built. Without either, every right column
    that the left side lacks is expanded under its own name.
    """
    lk, rk = as_list(left_keys), as_list(right_keys)
    require(right, rk)
    keys = [unused_name(left, f"__key{i}") for i in range(len(rk))]
    if aggregate:
        small = right.groupBy(*[col(k).alias(n) for k, n in zip(rk, keys)]).agg(
            *[agg.alias(name) for name, agg in aggregate.items()]
        )
    else:
        if expand is None:
            expand = {c: c for c in right.columns if c not in left.columns and c not in rk}
        require(right, expand)
        small = right.select(
            *[col(k).alias(n) for k, n in zip(rk, keys)], *[col(c).alias(a) for c, a in expand.items()]
        )
    kind = join_kind(kind)
    if aggregate and kind in ("inner", "left"):
        salt = salt or 1
    return join_on(left, small, lk, keys, kind, key_type, salt, unique_right=bool(aggregate)).drop(*keys)


def expand(df: DataFrame, column: str, fields: Mapping[str, str], outer: bool = True) -> DataFrame:
    """Expand a column of arrays of structs into rows; ``outer`` keeps rows with nothing nested."""
    require(df, [column])
    item = unused_name(df, "__item")
    explode = F.explode_outer if outer else F.explode
    kept = [c for c in df.columns if c != column]
    return df.select(*[col(c) for c in kept], explode(col(column)).alias(item)).select(
        *[col(c) for c in kept], *[F.col(item).getField(f).alias(a) for f, a in fields.items()]
    )


def enrich(df: DataFrame, lookup: DataFrame, on: str | Iterable[str]) -> DataFrame:
    """Left join on keys both sides share by name."""
    return join_on(df, lookup, as_list(on))


def lookup_dimensions(df: DataFrame, dimensions: Iterable[tuple[DataFrame, str, str, Mapping[str, str]]]) -> DataFrame:
    """Chain left lookups: ``(dimension, key in df, key in dimension, {column: alias})``.

    Dimensions are often just built, hence laid out by their key already.
    """
    for dimension, key, dim_key, wanted in dimensions:
        df = merge_queries(df, dimension, key, dim_key, expand=wanted, salt=1)
    return df
