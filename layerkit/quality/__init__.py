"""Data-quality checks that report rows instead of stopping at the first failure."""

from layerkit.quality.checks import (
    Check,
    CheckFailed,
    accepted,
    assert_checks,
    batch_statistics,
    castable,
    duplicates,
    failing_rows,
    grain_kept,
    has_types,
    in_range,
    min_rows,
    non_negative,
    not_null,
    null_share,
    orphans,
    referential,
    required_checks,
    row_drift,
    rows_between,
    rule,
    run_checks,
    same_rows,
    table_status,
    totals_match,
    unique,
)

__all__ = [
    "Check", "CheckFailed", "accepted", "assert_checks", "batch_statistics", "castable", "duplicates",
    "failing_rows", "grain_kept", "has_types", "in_range", "min_rows", "non_negative", "not_null",
    "null_share", "orphans", "referential", "required_checks", "row_drift", "rows_between", "rule",
    "run_checks", "same_rows", "table_status", "totals_match", "unique",
]
