"""A table program as data: a list of (step, arguments) folded over a DataFrame."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame

from layerkit.operators import aggregate, joins, ordered, project, sets

# Step names of the source language and our operator for each.
STEPS = {
    "filter": project.select_rows,
    "add_column": project.add_column,
    "rename": project.rename,
    "remove_columns": project.remove_columns,
    "select_columns": project.select_columns,
    "change_types": project.cast_types,
    "sort": ordered.sort,
    "group_by": aggregate.group,
    "join": joins.merge_queries,
    "expand_join": joins.expand,
    "distinct": sets.distinct,
    "union": lambda df, tables: sets.combine([df, *tables]),
    "replace_value": project.replace_value,
    "fill_down": ordered.fill_down,
    "fill_up": ordered.fill_up,
    "pivot": aggregate.pivot,
    "unpivot": aggregate.unpivot,
    "unpivot_other": aggregate.unpivot_other,
    "duplicate_column": project.duplicate_column,
    "transform_columns": project.transform_columns,
    "first_n": ordered.first_n,
    "last_n": ordered.last_n,
    "skip": ordered.skip,
    "cache": project.buffer,
    "promote_headers": ordered.promote_headers,
    "remove_last_n": ordered.remove_last,
}


def run_recipe(df: DataFrame, steps: Iterable[tuple[str, Mapping]]) -> DataFrame:
    """Apply the steps in order; an unknown step raises."""

    def apply(table: DataFrame, step: tuple[str, Mapping]) -> DataFrame:
        name, arguments = step
        if name not in STEPS:
            raise ValueError(f"unknown step: {name}")
        return table.transform(STEPS[name], **arguments)

    return reduce(apply, steps, df)
