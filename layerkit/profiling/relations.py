"""Foreign keys between tables, and statistics over whole columns."""

from __future__ import annotations

import datetime
import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from layerkit.functions.columns import col
from layerkit.profiling.findings import is_key_candidate
from layerkit.profiling.profile import as_text, type_name
from layerkit.session import stage


def _stem(table: str, column: str) -> str:
    """Column name without a table prefix: ``o_custkey`` and ``c_custkey`` share one."""
    name = column.lower()
    for ending in ("_id", "_key"):
        if name.endswith(ending):
            return name.removesuffix(ending)
    return name.split("_", 1)[1] if "_" in name else name


def linkable_columns(tables: Mapping[str, DataFrame]) -> dict[str, list[str]]:
    """Columns of each table that share type and name stem with a column, or the name, of another table.

    Only these can be an end of a link, so only these need a profile. Reads no data.
    """
    keys = [(t, f.name, (_stem(t, f.name), type_name(f.dataType))) for t, df in tables.items() for f in df.schema.fields]
    held: dict[tuple[str, str], set[str]] = {}
    for table, _, key in keys:
        held.setdefault(key, set()).add(table)
    names = {t.lower(): t for t in tables}

    def linkable(table: str, key: tuple[str, str]) -> bool:
        by_name = names.get(key[0], table) != table  # a child named after its parent
        parent = held.get((table.lower(), key[1]), set()) - {table}  # any key of a parent that a child is named after
        return bool(held[key] - {table}) or by_name or bool(parent)

    return {t: [c for table, c, key in keys if table == t and linkable(t, key)] for t in tables}


def candidate_links(profiles: DataFrame, threshold: float = 99.0) -> list[tuple[str, str, str, str]]:
    """Pairs (child table, column, parent table, column) with one type and one name stem.

    The parent column must be a key candidate. Works on profile rows, one per column.
    """
    rows = profiles.select("table_name", "column_name", "data_type", is_key_candidate(threshold)).collect()
    parents = [r[:3] for r in rows if r[3]]
    links = []
    for table, column, kind, _ in rows:
        for parent_table, parent_column, parent_kind in parents:
            named = _stem(table, column) in (_stem(parent_table, parent_column), parent_table.lower())
            if parent_table != table and kind == parent_kind and named:
                links.append((table, column, parent_table, parent_column))
    return sorted(links)


def named_links(tables: Mapping[str, DataFrame], threshold: float = 99.0, margin: float = 5.0) -> list[tuple[str, str, str, str]]:
    """The links of :func:`candidate_links` without a profile of every column.

    Signatures tell which columns can be keys; only those that stand at the parent's end of a
    link by name and type are then counted exactly, one aggregate per table.
    """
    kept = {t: c for t, c in linkable_columns(tables).items() if c}
    if not kept:
        return []
    found = key_signatures({t: tables[t].select(*map(col, c)) for t, c in kept.items()}).drop("signature").collect()  # one per column
    rows = [(r.table_name, r.column_name, r.data_type, r.rows, r.present, r.distinct_estimate) for r in found]
    likely = [(t, c, kind) for t, c, kind, n, _, near in rows if kind in ("bigint", "nvarchar") and n and near * 100 >= (threshold - margin) * n]
    links = [
        (t, c, pt, pc) for t, c, kind, *_ in rows for pt, pc, pkind in likely
        if pt != t and kind == pkind and _stem(t, c) in (_stem(pt, pc), pt.lower())
    ]
    wanted: dict[str, list[str]] = {}
    for _, _, pt, pc in links:
        wanted.setdefault(pt, [])
        if pc not in wanted[pt]:
            wanted[pt].append(pc)
    counts = [
        tables[t].agg(F.count(F.lit(1)).alias("n"), *[e.alias(f"{m}{i}") for i, c in enumerate(names) for e, m in ((F.count_distinct(col(c)), "d"), (F.count(col(c)), "p"))]).select(
            F.inline(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(c).alias("c"), F.col(f"d{i}").alias("d"), F.col(f"p{i}").alias("p"), F.col("n")) for i, c in enumerate(names)]))
        ) for t, names in wanted.items()
    ]
    keys = {(r.t, r.c) for r in reduce(DataFrame.unionByName, counts).collect() if r.d * 100 >= threshold * r.n and (r.n - r.p) * 100 <= (100 - threshold) * r.n} if counts else set()
    return sorted(link for link in links if link[2:] in keys)


def relationships(
    tables: Mapping[str, DataFrame], links: Iterable[tuple[str, str, str, str]], min_match: float = 0.0
) -> DataFrame:
    """How well each candidate link holds: distinct keys, matches, and rows without a parent.

    Links that match less than ``min_match`` percent of their keys are left out.
    Every key column is counted per value first; all links are then matched by
    one equi-join on (parent column, value).
    """
    links = list(links)

    def keys(table: str, column: str) -> DataFrame:
        df = tables[table]
        value = as_text(df.schema[column])
        return df.filter(col(column).isNotNull()).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))

    def parents_of(table: str, column: str) -> Column:
        return F.array(*[
            F.struct(F.lit(pt).alias("parent_table"), F.lit(pc).alias("parent_column"))
            for ct, cc, pt, pc in links if (ct, cc) == (table, column)
        ])

    children = reduce(DataFrame.union, [
        keys(t, c).select(
            F.lit(t).alias("child_table"), F.lit(c).alias("child_column"), F.inline(parents_of(t, c)).alias("parent_table", "parent_column"), "value", "n"
        )
        for t, c in dict.fromkeys((ct, cc) for ct, cc, _, _ in links)
    ])
    parents = reduce(DataFrame.union, [
        keys(t, c).select(F.lit(t).alias("parent_table"), F.lit(c).alias("parent_column"), "value", F.lit(True).alias("found"))
        for t, c in dict.fromkeys((pt, pc) for _, _, pt, pc in links)
    ])
    matched = children.join(parents, ["parent_table", "parent_column", "value"], "left")
    hit = F.col("found").isNotNull()
    return matched.groupBy("child_table", "child_column", "parent_table", "parent_column").agg(
        F.count(F.lit(1)).alias("distinct_keys"),
        F.count_if(hit).alias("matched_keys"),
        (F.count_if(hit) / F.count(F.lit(1)) * 100).alias("match_percentage"),
        F.sum(F.when(hit, 0).otherwise(F.col("n"))).alias("orphan_rows"),
    ).filter(F.col("match_percentage") >= min_match)


# Bits of a signature's size: 4,096 hashes, so shares are known to about 1.6 %, and exactly for columns of fewer values.
_SIGNATURE_BITS, _MARGIN = 12, 5.0


def key_signatures(tables: Mapping[str, DataFrame], bits: int = _SIGNATURE_BITS) -> DataFrame:
    """One row per column: type, rows, rows with a value, estimated distinct values, and a bottom-k signature of them.

    A signature is the smallest hashes of a column's values, at most 32 KB whatever the table holds. One scan per
    table moves the tasks' signatures only. They can be kept, and put together with those of other tables.
    """
    parts = []
    for name, df in tables.items():
        fields = [f for f in df.schema.fields if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, (T.BinaryType, T.BooleanType))]
        if not fields:
            continue
        found = df.agg(F.count(F.lit(1)).alias("rows"), *[
            e.alias(f"{m}{i}") for i, f in enumerate(fields) for e, m in
            ((F.theta_sketch_agg(F.xxhash64(F.when(col(f.name).isNotNull(), as_text(f))), F.lit(bits)), "s"), (F.count(col(f.name)), "n"))
        ])
        rows = [
            F.struct(
                F.lit(name).alias("table_name"), F.lit(f.name).alias("column_name"), F.lit(type_name(f.dataType)).alias("data_type"),
                F.col("rows"), F.col(f"n{i}").alias("present"), F.col(f"s{i}").alias("signature"),
            ) for i, f in enumerate(fields)
        ]
        parts.append(found.select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts).withColumn("distinct_estimate", F.theta_sketch_estimate("signature"))


def inclusion_candidates(signatures: DataFrame, min_match: float = 95.0, min_coverage: float = 0.0, margin: float = _MARGIN) -> DataFrame:
    """Pairs of columns, of any names, of which the one may hold the other's values, with shares estimated from signatures.

    A pair is left out where even ``margin`` percent more would not bring the matched share of the child's values to
    ``min_match``, the share of the parent's values in use to ``min_coverage``, or the parent's values close to one row each.
    Joins rows of ``signatures`` by type: one per column.
    """
    child = signatures.select("data_type", *[F.col(c).alias(f"child_{c.removesuffix('_name')}") for c in ("table_name", "column_name", "signature", "distinct_estimate")])
    parent = signatures.where(F.col("distinct_estimate") >= (1 - margin / 100) * F.col("present")).select(
        "data_type", *[F.col(c).alias(f"parent_{c.removesuffix('_name')}") for c in ("table_name", "column_name", "signature", "distinct_estimate")]
    )
    both = F.theta_sketch_estimate(F.call_function("theta_intersection", "child_signature", "parent_signature"))
    pairs = child.where("child_distinct_estimate > 0").join(parent.where("parent_distinct_estimate > 0"), "data_type")
    pairs = pairs.where("child_table <> parent_table").withColumn("both", both)
    return pairs.select(
        "child_table", "child_column", "parent_table", "parent_column",
        (F.col("both") / F.col("child_distinct_estimate") * 100).alias("match_estimate"),
        (F.col("both") / F.col("parent_distinct_estimate") * 100).alias("coverage_estimate"),
    ).where((F.col("match_estimate") + margin >= min_match) & (F.col("coverage_estimate") + margin >= min_coverage))


def inclusions(tables: Mapping[str, DataFrame], min_match: float = 95.0, min_coverage: float = 50.0, threshold: float = 99.0) -> DataFrame:
    """Foreign keys between columns of any names: what signatures leave over, counted exactly.

    As :func:`relationships`, with ``parent_keys``, the parent's distinct values, and ``coverage_percentage``, the share of them
    in use. A parent has ``threshold`` percent of distinct values at least. ``min_coverage`` keeps small ranges of numbers, which
    lie inside any counted key, from passing for links.
    """
    found = inclusion_candidates(stage(key_signatures(tables), "signatures"), min_match, min_coverage).collect()  # pairs of columns
    links = sorted((r.child_table, r.child_column, r.parent_table, r.parent_column) for r in found)
    if not links:
        kinds = "child_table string, child_column string, parent_table string, parent_column string, distinct_keys long, matched_keys long"
        return next(iter(tables.values())).sparkSession.createDataFrame([], f"{kinds}, match_percentage double, orphan_rows long, parent_keys long, coverage_percentage double")
    parents = reduce(DataFrame.union, [
        tables[t].agg(F.count_distinct(col(c)).alias("parent_keys"), F.count(col(c)).alias("n")).select(F.lit(t).alias("parent_table"), F.lit(c).alias("parent_column"), "parent_keys", "n")
        for t, c in dict.fromkeys((pt, pc) for _, _, pt, pc in links)
    ])
    unique = parents.where(F.col("parent_keys") * 100 >= threshold * F.col("n")).drop("n")
    held = relationships(tables, links, min_match).join(unique, ["parent_table", "parent_column"])
    held = held.withColumn("coverage_percentage", F.col("matched_keys") / F.col("parent_keys") * 100)
    return held.where(F.col("coverage_percentage") >= min_coverage)


# Accuracy of the sketch that brackets a rank, and distinct values of a bracket that the driver sorts.
_ACCURACY, BRACKET_VALUES = 10_000, 20_000


def percentiles(
    df: DataFrame, columns: Sequence[str], at: Sequence[float] = (0.25, 0.5, 0.75), most: int = BRACKET_VALUES, accuracy: int = _ACCURACY,
) -> DataFrame:
    """Exact percentiles of numeric columns, one row per column and point.

    A percentile is the smallest value that at least that share of the values
    does not exceed. A sketch gives each wanted rank a bracket of values that
    holds it; the next scan counts what lies below and sketches within. Each scan
    narrows a bracket some thousandfold, until it has ``most`` distinct values at most: only
    these are counted one by one and sorted. No scan moves a column; what is
    shuffled are sketches, counts, and the last brackets' distinct values.
    Should a sketch miss, the counts tell, and the bracket stays as wide as it was.
    """
    spark, at = df.sparkSession, [float(p) for p in at]
    values = [col(c).cast("double") for c in columns]
    sizes = df.agg(*[f(v).alias(f"{m}{i}") for i, v in enumerate(values) for f, m in ((F.count, "n"), (F.min, "low"), (F.max, "high"))]).first()
    wanted = [_Wanted(i, p, max(1, math.ceil(sizes[f"n{i}"] * p)), sizes[f"low{i}"], sizes[f"high{i}"], sizes[f"n{i}"]) for i in range(len(columns)) for p in at if sizes[f"n{i}"]]
    open_ = [w for w in wanted if not _same(w.low, w.high)]
    while open_:
        wide = [w for w in open_ if w.held > most]
        if wide:
            _narrow(df, values, wide, accuracy)
        # A bracket that no sketch narrows any more is counted by value too, however many it has.
        ready = [w for w in open_ if not _same(w.low, w.high) and (w.held <= most or w.stuck)]
        if ready:
            _select(df, values, ready)
        open_ = [w for w in open_ if not _same(w.low, w.high)]
    rows = [(columns[w.column], w.point, w.low) for w in wanted]
    return spark.createDataFrame(rows, "column_name string, percentile double, value double")


@dataclass
class _Wanted:
    """A wanted rank of a column, and the bracket that holds it."""

    column: int
    point: float
    rank: int
    low: float
    high: float
    held: int
    stuck: bool = False


def _same(a: float, b: float) -> bool:
    return a == b or (a != a and b != b)


def _inside(v: Column, w: _Wanted) -> Column:
    return (v >= F.lit(w.low)) & (v <= F.lit(w.high))


def _narrow(df: DataFrame, values: list[Column], wide: list[_Wanted], accuracy: int) -> None:
    """Sketch each bracket from within, and check by counting that the narrower one holds the rank."""
    below = df.agg(*[F.count_if(values[w.column] < F.lit(w.low)).alias(f"b{i}") for i, w in enumerate(wide)]).first()
    points = []
    for i, w in enumerate(wide):
        share, slack = (w.rank - below[f"b{i}"]) / w.held, 2 / accuracy
        points.append([max(0.0, share - slack), min(1.0, share + slack)])
    found = df.agg(*[
        F.percentile_approx(F.when(_inside(values[w.column], w), values[w.column]), points[i], accuracy).alias(f"p{i}") for i, w in enumerate(wide)
    ]).first()
    tried = [_Wanted(w.column, w.point, w.rank, *found[f"p{i}"], 0) for i, w in enumerate(wide)]
    counts = df.agg(*[
        c.alias(f"{m}{i}") for i, t in enumerate(tried) for c, m in
        ((F.count_if(values[t.column] < F.lit(t.low)), "b"), (F.count_if(_inside(values[t.column], t)), "h"))
    ]).first()
    for i, (w, t) in enumerate(zip(wide, tried)):
        holds = counts[f"b{i}"] < w.rank <= counts[f"b{i}"] + counts[f"h{i}"]
        w.stuck = not holds or counts[f"h{i}"] >= w.held
        if holds:
            w.low, w.high, w.held = t.low, t.high, counts[f"h{i}"]


def _select(df: DataFrame, values: list[Column], ready: list[_Wanted]) -> None:
    """Find the ranks in narrow brackets from counts per distinct value."""
    brackets = F.array(*[
        F.when(_inside(values[w.column], w), F.struct(F.lit(i).alias("i"), values[w.column].alias("v"))) for i, w in enumerate(ready)
    ])
    counted = df.select(F.inline(F.array_compact(brackets))).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    below = df.agg(*[F.count_if(values[w.column] < F.lit(w.low)).alias(f"b{i}") for i, w in enumerate(ready)]).first()
    upto = F.sum("n").over(Window.partitionBy("i").orderBy("v"))
    need = F.element_at(F.array(*[F.lit(w.rank - below[f"b{i}"]) for i, w in enumerate(ready)]), F.col("i") + 1)
    reached = counted.withColumn("upto", upto).where(F.col("upto") >= need).groupBy("i").agg(F.min("v").alias("v")).collect()
    for r in reached:
        ready[r.i].low = ready[r.i].high = r.v


def approximate_percentiles(
    df: DataFrame, columns: Sequence[str], at: Sequence[float] = (0.25, 0.5, 0.75), accuracy: int = 10_000
) -> DataFrame:
    """The same in one pass, off by at most 1/accuracy in rank."""
    found = df.agg(*[F.percentile_approx(col(c), list(at), accuracy).alias(f"p{i}") for i, c in enumerate(columns)])
    rows = [
        F.struct(F.lit(c).alias("column_name"), F.lit(float(p)).alias("percentile"), F.col(f"p{i}")[j].cast("double").alias("value"))
        for i, c in enumerate(columns)
        for j, p in enumerate(at)
    ]
    return found.select(F.inline(F.array(*rows)))


def outliers(df: DataFrame, columns: Sequence[str], width: float = 1.5) -> DataFrame:
    """Number of values below and above the quartile fences of each column."""
    quartiles = {(r[0], r[1]): r[2] for r in percentiles(df, columns, (0.25, 0.75)).collect()}  # two per column
    counts, rows = [], []
    for i, c in enumerate(columns):
        q1, q3 = quartiles.get((c, 0.25)), quartiles.get((c, 0.75))
        known = q1 is not None
        low = F.lit(q1 - width * (q3 - q1) if known else None).cast("double")
        high = F.lit(q3 + width * (q3 - q1) if known else None).cast("double")
        counts += [F.count_if(col(c) < low).alias(f"below{i}"), F.count_if(col(c) > high).alias(f"above{i}")]
        rows.append(F.struct(
            F.lit(c).alias("column_name"), low.alias("low_fence"), high.alias("high_fence"),
            F.col(f"below{i}").alias("below"), F.col(f"above{i}").alias("above"),
        ))
    return df.agg(*counts).select(F.inline(F.array(*rows)))


# Character classes of a text.
CHARACTER_CLASSES = [
    ("digits_only", r"^[0-9]+$"),
    ("letters_only", r"^[A-Za-z]+$"),
    ("alphanumeric", r"^[A-Za-z0-9]+$"),
    ("non_ascii", r"[^\x00-\x7F]"),
    ("outer_space", r"^\s|\s$"),
    ("empty", r"^$"),
]


def character_classes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of values of each text column that fall in each character class."""
    found = df.agg(*[
        F.count_if(col(c).rlike(regex)).alias(f"{name}{i}")
        for i, c in enumerate(columns) for name, regex in CHARACTER_CLASSES
    ])
    rows = [
        F.struct(F.lit(c).alias("column_name"), *[F.col(f"{name}{i}").alias(name) for name, _ in CHARACTER_CLASSES])
        for i, c in enumerate(columns)
    ]
    return found.select(F.inline(F.array(*rows)))


def date_gaps(df: DataFrame, column: str) -> DataFrame:
    """Days between the first and last date of a column on which it has no row."""
    days = df.select(col(column).cast("date").alias("day")).filter(F.col("day").isNotNull()).distinct()
    span = days.agg(F.min("day").alias("first"), F.max("day").alias("last")).filter(F.col("first").isNotNull())
    every = span.select(F.explode(F.sequence("first", "last")).alias("day"))
    return every.join(days, "day", "left_anti")


def recency(df: DataFrame, columns: Sequence[str], today: datetime.date) -> DataFrame:
    """Newest date of each column and its age in days."""
    found = df.agg(*[F.max(col(c)).cast("date").alias(f"d{i}") for i, c in enumerate(columns)])
    rows = [
        F.struct(
            F.lit(c).alias("column_name"), F.col(f"d{i}").alias("latest"),
            F.datediff(F.lit(today), F.col(f"d{i}")).alias("age_days"),
        )
        for i, c in enumerate(columns)
    ]
    return found.select(F.inline(F.array(*rows)))
