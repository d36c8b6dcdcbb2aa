"""Redaction of private values in texts, keeping their structure readable."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from layerkit.functions.columns import as_list, col, require, unused_name
from layerkit.session import spread

# Fixed values: (pattern, replacement), applied in this order.
REDACTIONS = [
    (r"https://[\w-]+\.blob\.core\.windows\.net/[\w-]+/", "<REDACTED_URL>/<REDACTED_CONTAINER>/"),
    (r"https://[\w-]+\.dfs\.core\.windows\.net/[\w-]+/", "<REDACTED_URL>/<REDACTED_CONTAINER>/"),
    (r"https://[\w-]+\.blob\.core\.windows\.net/", "<REDACTED_URL>/"),
    (r"https://[\w-]+\.dfs\.core\.windows\.net/", "<REDACTED_URL>/"),
    (r"abfss://[\w-]+@[\w-]+\.dfs\.core\.windows\.net/", "abfss://<REDACTED_CONTAINER>@<REDACTED_ACCOUNT>.dfs.core.windows.net/"),
    (r"wasbs://[\w-]+@[\w-]+\.blob\.core\.windows\.net/", "wasbs://<REDACTED_CONTAINER>@<REDACTED_ACCOUNT>.blob.core.windows.net/"),
    (r'https?://[a-zA-Z0-9.-]+(/[^"\s]*)?', "<REDACTED_URL>"),
    (r'Sql\.Database\("[^"]*"\s*,\s*"[^"]*"\)', 'Sql.Database("<REDACTED_SERVER>", "<REDACTED_DB>")'),
    (r'Sql\.Databases\("[^"]*"\)', 'Sql.Databases("<REDACTED_SERVER>")'),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<REDACTED_GUID>"),
    (r'"[^"]*\.(csv|xlsx|xls|json|parquet|tsv|txt)"', '"<REDACTED_PATH>"'),
    (r'Item\s*=\s*"[^"]*"', 'Item = "<REDACTED_SHEET>"'),
    (r"\[([^\[\]=]+)\]", "[<REDACTED_COL>]"),
    (r'#"[^"]+"', '#"<REDACTED_IDENT>"'),
    (r"\b(\d{3,})\b", "<REDACTED_NUMBER>"),
]
PLACEHOLDER, VALUE = "<REDACTED_", "<REDACTED_VALUE>"


# For each pattern, texts of which every match holds one, or a shorter pattern that every match begins with: both are
# far quicker to look for than the pattern, which only texts with a find meet.
_EXTENSIONS = ("csv", "xlsx", "xls", "json", "parquet", "tsv", "txt")
_HOLDS = [
    (".blob.core.windows.net/",), (".dfs.core.windows.net/",), (".blob.core.windows.net/",), (".dfs.core.windows.net/",),
    ("abfss://",), ("wasbs://",), ("http://", "https://"), ('Sql.Database("',), ('Sql.Databases("',),
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-", tuple(f'.{e}"' for e in _EXTENSIONS), ("Item",), ("[",), ('#"',), r"\p{Nd}{3}",
]


def _rules_applied(text: Column) -> list[Column]:
    """The rules as steps, each to be applied to what the one before has made of a text."""
    steps = []
    for (pattern, replacement), holds in zip(REDACTIONS, _HOLDS, strict=True):
        if isinstance(holds, str):
            found, ahead = text.rlike(holds), f"(?={holds})"
        else:
            found, ahead = reduce(lambda a, b: a | b, [text.contains(x) for x in holds]), ""
        # Words and digits in any script, as the patterns mean them.
        steps.append(F.when(found, F.regexp_replace(text, f"(?U){ahead}{pattern}", replacement)).otherwise(text))
    return steps


def _values_hidden(pieces: Column) -> Column:
    """Rejoin a text split at its quotes, with the quoted pieces replaced.

    Quotes pair from the left, so pieces at odd places are the quoted ones.
    Placeholders, pieces without a word character, and what follows an unclosed
    last quote are kept.
    """

    def piece(p: Column, i: Column) -> Column:
        quoted = (i % 2 == 1) & (i < F.size(pieces) - 1)
        return F.when(quoted & p.rlike(r"(?U)\w") & ~p.contains(PLACEHOLDER), VALUE).otherwise(p)

    return F.array_join(F.transform(pieces, piece), '"')


def redact(df: DataFrame, columns, tasks: int | None = None) -> DataFrame:
    """Apply all rules in order to text columns, then the pass over quoted values.

    A rule's pattern is tried on texts that hold what each of its matches holds.
    Each step is a projection of its own: were they one expression, every step
    would be worked out again by the next. ``tasks`` is for few texts that lie in
    fewer tasks than that.
    """
    names = as_list(columns)
    require(df, names)
    pieces = {n: unused_name(df, f"__pieces{i}") for i, n in enumerate(names)}
    out = spread(df, tasks)
    for step in zip(*[_rules_applied(col(n)) for n in names]):
        out = out.withColumns(dict(zip(names, step)))
    out = out.withColumns({p: F.split(col(n), '"', -1) for n, p in pieces.items()})
    return out.withColumns({n: _values_hidden(F.col(p)) for n, p in pieces.items()}).select(
        *[col(c) for c in df.columns]
    )
