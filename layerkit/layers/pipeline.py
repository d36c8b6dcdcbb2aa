"""Loads from layer to layer. Each step writes one table and reports its checks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from layerkit.functions.columns import as_list, col
from layerkit.functions.numbers import key_hash
from layerkit.operators.joins import lookup_dimensions
from layerkit.operators.ordered import dedup_latest
from layerkit.operators.project import add_load_lineage, to_clean_lineage
from layerkit.operators.recipe import run_recipe
from layerkit.quality import Check, referential, required_checks, run_checks
from layerkit.sources.changes import merge_table
from layerkit.sources.store import TableStore


def load_bronze(
    store: TableStore, name: str, df: DataFrame, load_id: str, source: str | Column | None = None,
    loaded_at: Column | None = None,
) -> DataFrame:
    """Append a source to a raw table as it is, with lineage. Cleaning belongs to the next layer."""
    store.write_bronze(add_load_lineage(df, load_id, source, loaded_at), name)
    return run_checks(store.read_bronze(name), name, required_checks("bronze"))


def build_silver(
    store: TableStore,
    name: str,
    source: str,
    steps: Iterable[tuple[str, Mapping]],
    keys: str | Sequence[str],
    order_by=("_load_timestamp",),
    mode: str = "refresh",
    load_id: str = "",
    checks: Iterable[Check] = (),
    built_at: Column | None = None,
    since=None,
) -> DataFrame:
    """Clean a raw table: steps, newest row per key, new lineage, then refresh or merge.

    A merge may read only what was loaded after ``since``: files of earlier loads are not opened.
    """
    keys = as_list(keys)
    if since is not None and mode != "merge":
        raise ValueError("since suits a merge: a refresh needs every row")
    raw = store.read_bronze(source) if since is None else store.read_since(source, "_load_timestamp", since)
    clean = run_recipe(raw, steps)
    clean = to_clean_lineage(dedup_latest(clean, keys, list(order_by)), load_id, built_at)
    if mode not in ("merge", "refresh"):
        raise ValueError(f"unknown mode: {mode}")
    written = merge_table(store, name, clean, keys, check=False) if mode == "merge" else store.write_silver(clean, name)
    return run_checks(written, name, [*required_checks("silver", keys), *checks])


def build_dimension(
    df: DataFrame, attributes: Iterable[str], business_keys: str | Iterable[str], order_by, key_name: str
) -> DataFrame:
    """One row per business key, the newest, under a hashed surrogate key."""
    keys = as_list(business_keys)
    newest = dedup_latest(df, keys, order_by)
    columns = [*keys, *[a for a in attributes if a not in keys]]
    return newest.select(key_hash(*[col(k) for k in keys]).alias(key_name), *[col(c) for c in columns])


def store_dimension(store: TableStore, name: str, dimension: DataFrame, key_name: str) -> DataFrame:
    """Merge a dimension into its stored table by surrogate key."""
    written = merge_table(store, name, dimension, key_name)
    return run_checks(written, name, required_checks("dimension", [key_name]))


def build_fact(
    df: DataFrame, dimensions: Iterable[tuple[DataFrame, str, str, str]], measures: Iterable[str]
) -> DataFrame:
    """Replace business keys by surrogate keys; unmatched keys stay null.

    Dimensions are ``(dimension, key in df, business key, surrogate key)``.
    """
    dimensions = list(dimensions)
    found = lookup_dimensions(df, [(d, key, business, {surrogate: surrogate}) for d, key, business, surrogate in dimensions])
    return found.select(*[col(s) for *_, s in dimensions], *[col(m) for m in measures])


def store_fact(store: TableStore, name: str, fact: DataFrame, links: Iterable[tuple[str, str]]) -> DataFrame:
    """Refresh a fact and check its surrogate keys; links are ``(surrogate key, dimension name)``."""
    written = store.write_silver(fact, name)
    report = run_checks(written, name, required_checks("fact"))
    return report.unionByName(referential(written, name, [(key, store.read(d), key, d) for key, d in links]))


def run_layers(spark: SparkSession, stages: Iterable[tuple[str, Callable[[], DataFrame]]], strict: bool = True) -> DataFrame:
    """Run stages in the order given and return all their check rows.

    With ``strict`` the first stage with a failed check is the last to run.
    """
    done = []
    for place, (stage_name, run) in enumerate(stages):
        rows = run().collect()  # one row per check
        done += [(place, stage_name, *r) for r in rows]
        if strict and not all(r["passed"] for r in rows):
            break
    return spark.createDataFrame(
        done,
        "place int, stage string, check string, table_name string, column_name string, "
        "passed boolean, observed double, expected string",
    )
