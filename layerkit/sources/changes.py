"""Keyed upsert, change sets between snapshots, and versioned dimensions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from layerkit.functions.columns import as_list, col, require, row_hash
from layerkit.functions.numbers import key_hash
from layerkit.session import sized_files, stage
from layerkit.sources import files
from layerkit.sources.sinks import write_partitioned
from layerkit.sources.store import BUCKET, TableStore, Version


class DuplicateKeys(ValueError):
    """A table that must have one row per key has more."""


def require_unique(df: DataFrame, keys: Iterable[str], ignore_null_keys: bool = True) -> None:
    """Raise when a key repeats. Runs one job over the keys."""
    keys = as_list(keys)
    require(df, keys)
    checked = df.select(*[col(k) for k in keys])
    if ignore_null_keys:
        checked = checked.dropna()
    repeated = checked.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if repeated:
        raise DuplicateKeys(f"keys ({', '.join(keys)}) repeat, for example {repeated[0].asDict()}")


def _equal(pairs: Iterable[tuple[str, str]], null_safe: bool = False) -> Column:
    tests = [col(a).eqNullSafe(col(b)) if null_safe else col(a) == col(b) for a, b in pairs]
    return reduce(lambda x, y: x & y, tests)


def _no_more(target: DataFrame, source: DataFrame) -> list[str]:
    """No columns; raises when the source has some that the target lacks."""
    extra = [c for c in source.columns if c not in target.columns]
    if extra:
        raise ValueError(f"columns not in the target: {', '.join(extra)}")
    return []


def merge(
    target: DataFrame,
    source: DataFrame,
    keys: str | Iterable[str],
    update_when: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None,
    set: Mapping[str, str | Column] | None = None,
    evolve: bool = False,
    check: bool = True,
) -> DataFrame:
    """Upsert: update matched rows, insert the others, keep the rest.

    ``update_when(target, source)`` builds the update condition from two column
    getters. ``set`` maps target columns to source columns; by default all
    shared columns are taken. A null key matches nothing. Source keys may not
    repeat. With ``evolve`` new source columns are added, else they raise.

    The source is staged, so that it is worked out once. A small one is broadcast
    by Spark, so the target is not shuffled; only its keys found in the source
    are, to tell which rows are new.
    """
    keys = as_list(keys)
    require(target, keys)
    require(source, keys)
    extra = [c for c in source.columns if c not in target.columns] if evolve else _no_more(target, source)
    source = stage(source, "merge-source")
    if check:
        require_unique(source, keys)
    return _merged(target, source, keys, extra, update_when, set)


def _merged(target: DataFrame, source: DataFrame, keys: list[str], extra: list[str], update_when, set) -> DataFrame:
    """:func:`merge` of a staged source."""
    named = {c: f"__s_{c}" for c in source.columns}
    changed = source.select(*[col(c).alias(n) for c, n in named.items()], F.lit(True).alias("__matched"))
    joined = target.join(changed, _equal((k, named[k]) for k in keys), "left")
    applies = F.coalesce(F.col("__matched"), F.lit(False))
    if update_when is not None:
        applies = applies & F.coalesce(update_when(col, lambda c: col(named[c])), F.lit(False))
    if set is None:
        set = {c: c for c in source.columns if c not in keys}
    taken = {c: (v if isinstance(v, Column) else col(named[v])) for c, v in set.items()}
    kept = joined.select(
        *[
            (F.when(applies, taken[c]).otherwise(col(c)) if c in taken else col(c)).alias(c)
            for c in target.columns
        ],
        *[F.when(applies, col(named[c])).alias(c) for c in extra],
    )
    source_keys = source.select(*[col(k).alias(f"__k_{k}") for k in keys])
    present = (
        target.select(*[col(k) for k in keys])
        .join(source_keys, _equal((k, f"__k_{k}") for k in keys), "left_semi")
        .distinct()
        .withColumnsRenamed({k: f"__k_{k}" for k in keys})
    )
    new = source.join(present, _equal((k, f"__k_{k}") for k in keys), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def bucket_of(keys: str | Iterable[str], buckets: int) -> Column:
    """Bucket of a row by its keys, the same for ever."""
    return F.pmod(F.xxhash64(*[col(k) for k in as_list(keys)]), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, path: str, keys: str | Iterable[str], buckets: int) -> None:
    """Write a table as one folder per key bucket, for :func:`merge_buckets`."""
    write_partitioned(df.withColumn(BUCKET, bucket_of(keys, buckets)), path, BUCKET)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """A bucketed table without its bucket column."""
    return spark.read.parquet(path).drop(BUCKET)


def merge_buckets(
    spark: SparkSession,
    path: str,
    source: DataFrame,
    keys: str | Iterable[str],
    buckets: int,
    update_when: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None,
    set: Mapping[str, str | Column] | None = None,
) -> int:
    """Upsert into a bucketed table, rewriting only the buckets the source touches.

    Returns how many were rewritten. The merged buckets are staged before they
    replace the old ones, so a failure leaves the table as it was.
    """
    keys = as_list(keys)
    source = stage(source.withColumn(BUCKET, bucket_of(keys, buckets)), "merge-source")
    require_unique(source, keys)
    touched = [r[0] for r in source.select(BUCKET).distinct().collect()]  # at most one number per bucket
    if not touched:
        return 0
    target = spark.read.parquet(path).filter(F.col(BUCKET).isin(touched))
    if set is None:
        set = {c: c for c in source.columns if c not in keys and c != BUCKET}
    merged = stage(_merged(target, source, [BUCKET, *keys], _no_more(target, source), update_when, set), "merge")
    with sized_files(spark):
        merged.hint("rebalance", F.col(BUCKET)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            BUCKET
        ).parquet(path)
    return len(touched)


# Bytes on disk above which a table gets one more bucket for each such amount.
BUCKET_BYTES = 128 << 20


def _address(hashed: Column, count: int) -> Column:
    """Bucket of a hash in a table of ``count`` buckets, by linear hashing.

    With ``count`` between 2^n and 2^(n+1), the first buckets are already split: their rows
    go by n + 1 bits, the others by n. One bucket more therefore splits one bucket and
    moves no other row, and the number of buckets is all there is to know.
    """
    level = count.bit_length() - 1
    low = hashed.bitwiseAND(F.lit((1 << level) - 1))
    high = hashed.bitwiseAND(F.lit((2 << level) - 1))
    return F.when(low < count - (1 << level), high).otherwise(low).cast("int")


def split_parents(count: int, grown: int) -> set[int]:
    """Buckets of a table of ``count`` that pass rows on when it grows to ``grown``."""
    level = count.bit_length() - 1
    found = set()
    for b in range(count, grown):
        low = b & ((1 << level) - 1)
        found.add(b & ((2 << level) - 1) if low < count - (1 << level) else low)
    return found


def _key_hash(df: DataFrame, keys: list[str]) -> Column:
    """Hash of the keys. A row with a null key matches nothing, so its whole row spreads it over the buckets.

    Columns go by name and nulls leave a hash as it is, so a change set without some of the columns agrees with the table.
    """
    unkeyed = reduce(lambda a, b: a | b, [col(k).isNull() for k in keys])
    return F.when(unkeyed, row_hash(df.select(*[col(c) for c in sorted(df.columns)]))).otherwise(F.xxhash64(*[col(k) for k in keys]))


def merge_table(
    store: TableStore,
    name: str,
    source: DataFrame,
    keys: str | Iterable[str],
    update_when: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None,
    buckets: int | None = None,
    check: bool = True,
    notes: Mapping[str, str] | None = None,
    before: Version | None = None,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Upsert into a table of a store, which lies in key buckets: only those the source touches are written anew.

    The table has one bucket for each ``bucket_bytes`` that it holds, and
    ``buckets`` at least. When a merge makes it grow beyond, single buckets are
    split (linear hashing): what a split costs is the bucket, never the table.
    A table that was written whole until then is bucketed by its first merge.
    The new version holds the buckets written anew; the others are read from the
    versions that wrote them. ``before`` is the current version where the caller
    has read it already; sizes come from its notes and from the file system, so
    metadata takes no Spark job.
    """
    keys, spark = as_list(keys), store.spark
    before = before or store.state(name)
    notes = (before.notes if before else {}) if notes is None else notes
    if before:  # the table's types, so that files and hashes agree
        kinds = {f.name: f.dataType for f in before.schema.fields}
        source = source.select(*[col(c).cast(kinds[c]).alias(c) if c in kinds else col(c) for c in source.columns])
    source = stage(source, "merge-source")
    if check:
        require_unique(source, keys)
    count = before.count if before else 0
    added = sum(sum(files.file_bytes(spark, path).values()) for path in _folders(source))
    if not count:
        target = store.read_state(name, before) if before else None
        held = sum(files.file_bytes(spark, f"{store.path(name)}/{before.folder}").values()) if before else 0
        grown = max(buckets or 1, -(-(held + added) // bucket_bytes))
        rewritten: set[int] = set()
        whole = _merged(target, source, keys, _no_more(target, source), update_when, None) if before else source
    else:
        held = sum(size for _, size in before.buckets.values())
        grown = max(count, buckets or 1, -(-(held + added) // bucket_bytes))
        touched = [r[0] for r in source.select(_address(_key_hash(source, keys), count)).distinct().collect()]  # one number per bucket at most
        rewritten = {*touched} | split_parents(count, grown)
        target = store.read_state(name, before, rewritten)
        whole = _merged(target, source, keys, _no_more(target, source), update_when, None)
    whole = whole.withColumn(BUCKET, _address(_key_hash(whole, keys), grown))
    schema = before.schema if count else whole.drop(BUCKET).schema
    return store.write_buckets(whole, name, before, grown, schema, rewritten, notes)


def _folders(df: DataFrame) -> set[str]:
    """Folders of the files that a staged table is read from."""
    return {f.rsplit("/", 1)[0] for f in df.inputFiles()}


def table_changes(old: DataFrame, new: DataFrame, keys: str | Iterable[str], check: bool = True) -> DataFrame:
    """Changes that turn ``old`` into ``new``, with ``_change_type`` as
    insert, update_preimage, update_postimage or delete. Keys may not repeat."""
    keys = as_list(keys)
    if check:
        require_unique(old, keys, ignore_null_keys=False)
        require_unique(new, keys, ignore_null_keys=False)
    columns = list(old.columns) + [c for c in new.columns if c not in old.columns]
    types = {f.name: f.dataType for df in (old, new) for f in df.schema.fields}

    def side(df: DataFrame, name: str) -> DataFrame:
        values = [(col(c) if c in df.columns else F.lit(None).cast(types[c])).alias(c) for c in columns]
        return df.select(*[col(k).alias(f"__{name}_{k}") for k in keys], F.struct(*values).alias(f"__{name}"))

    joined = side(old, "o").join(
        side(new, "n"), _equal(((f"__o_{k}", f"__n_{k}") for k in keys), null_safe=True), "full"
    )
    was, now = F.col("__o"), F.col("__n")

    def change(kind: str, row: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), row.alias("row"))

    changes = (
        F.when(was.isNull(), F.array(change("insert", now)))
        .when(now.isNull(), F.array(change("delete", was)))
        .when(~was.eqNullSafe(now), F.array(change("update_preimage", was), change("update_postimage", now)))
    )
    return joined.select(F.explode(changes).alias("c")).select(F.col("c.kind").alias("_change_type"), "c.row.*")


# Columns a versioned dimension adds to its keys and attributes.
VERSION_COLUMNS = ["valid_from", "valid_to", "is_current"]


def start_versions(source: DataFrame, keys: str | Iterable[str], attributes: Iterable[str], at: Column, key_name: str = "version_key") -> DataFrame:
    """First load of a versioned dimension."""
    keys, attributes = as_list(keys), as_list(attributes)
    at = at.cast("timestamp_ntz")
    return source.select(
        key_hash(*[col(k) for k in keys], at).alias(key_name),
        *[col(c) for c in [*keys, *attributes]],
        at.alias("valid_from"),
        F.lit(None).cast("timestamp_ntz").alias("valid_to"),
        F.lit(True).alias("is_current"),
    )


def next_versions(
    dimension: DataFrame,
    source: DataFrame,
    keys: str | Iterable[str],
    attributes: Iterable[str],
    at: Column,
    key_name: str = "version_key",
    close_missing: bool = False,
    check: bool = True,
) -> DataFrame:
    """Apply a snapshot to a versioned dimension, be it newer than all it holds or late.

    Of each key the version that is valid at ``at`` is looked at. If its attributes
    differ it ends at ``at`` and what is left of its time goes to a new version,
    which is the current one where the old one was; a version that starts at ``at``
    itself is restated in place. A key without a version at that time starts one,
    which lasts until the key's next version, if it has a later one. With
    ``close_missing`` the version of a key that the snapshot lacks ends at ``at``.
    All other versions stay as they are, so the intervals of a key never overlap.
    """
    keys, attributes = as_list(keys), as_list(attributes)
    if check:
        require_unique(source, keys)
    moment = at.cast("timestamp_ntz")
    holds = (col("valid_from") <= moment) & (col("valid_to").isNull() | (col("valid_to") > moment))
    touched, others = dimension.filter(holds), dimension.filter(~F.coalesce(holds, F.lit(False)))
    started = start_versions(source.dropna(subset=keys), keys, attributes, at, key_name)
    columns = [key_name, *keys, *attributes, *VERSION_COLUMNS]
    # Of a snapshot that is not late this is empty, which Spark sees at run time and then leaves the join out.
    later = dimension.filter(col("valid_from") > moment).groupBy(*[col(k).alias(f"__l_{k}") for k in keys]).agg(F.min("valid_from").alias("__until"))

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*[col(k).alias(f"__{name}_{k}") for k in keys], F.struct(*[col(c) for c in columns]).alias(f"__{name}"))

    joined = side(touched, "c").join(side(started, "n"), _equal((f"__c_{k}", f"__n_{k}") for k in keys), "full")
    joined = joined.join(later, _equal((f"__n_{k}", f"__l_{k}") for k in keys), "left")
    was, now, until = F.col("__c"), F.col("__n"), F.col("__until")
    closed = was.withField("valid_to", moment).withField("is_current", F.lit(False))
    following = now.withField("valid_to", was["valid_to"]).withField("is_current", was["is_current"])
    fresh = now.withField("valid_to", until).withField("is_current", until.isNull())
    same = reduce(lambda x, y: x & y, [was[a].eqNullSafe(now[a]) for a in attributes], F.lit(True))
    begins = was["valid_from"] == moment
    rows = (
        F.when(was.isNull(), F.array(fresh))
        .when(now.isNull(), F.array(was) if not close_missing else F.when(~begins, F.array(closed)))
        .when(same, F.array(was))
        .when(begins, F.array(following))
        .otherwise(F.array(closed, following))
    )
    live = joined.select(F.explode(rows).alias("r")).select("r.*")
    return others.select(*columns).unionByName(live)
