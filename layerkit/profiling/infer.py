"""Types, date formats and header presence, found from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from layerkit.functions.columns import col
from layerkit.operators.project import cast_types
from layerkit.session import spread

# Date layouts in order of preference (regex, name), and the shares that decide.
DATE_LAYOUTS = [
    (r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}", "YYYY-MM-DD"),
    (r"^\d{1,2}/\d{1,2}/\d{4}", "D/M/YYYY"),
    (r"^\d{1,2}-\d{1,2}-\d{4}", "D-M-YYYY"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}", "D.M.YYYY"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "D/M/YY"),
    (r"^\d{8}$", "YYYYMMDD"),
]
LAYOUT_SHARE = 0.8
TYPE_SHARE = 0.9

# A plain number, as text.
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# Rewrites that bring a date to year-month-day, in order. Months and days that
# cannot exist stay as they are, so that the cast below rejects them cheaply.
_MONTH, _DAY = r"(0?[1-9]|1[0-2])", r"(0?[1-9]|[12]\d|3[01])"
_FIXED_ORDER = [(r"^(\d{4})/(\d{1,2})/", "$1-$2-"), (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")]
_MONTH_FIRST = [
    (rf"^{_MONTH}([/.-]){_DAY}\2(\d{{4}})", "$4-$1-$3"),
    # Two-digit years from 69 on are of the last century.
    (rf"^{_MONTH}/{_DAY}/(69|[7-9]\d)$", "19$3-$1-$2"),
    (rf"^{_MONTH}/{_DAY}/(\d\d)$", "20$3-$1-$2"),
]
_DAY_FIRST = [
    (rf"^{_DAY}([/.-]){_MONTH}\2(\d{{4}})", "$4-$3-$1"),
    (rf"^{_DAY}/{_MONTH}/(69|[7-9]\d)$", "19$3-$2-$1"),
    (rf"^{_DAY}/{_MONTH}/(\d\d)$", "20$3-$2-$1"),
]


def is_number(c: Column) -> Column:
    """Whether a text is a number. A pattern costs far less than a cast that fails."""
    return c.rlike(_NUMBER)


def layout_no(c: Column) -> Column:
    """Place of a text's layout in :data:`DATE_LAYOUTS`; null for texts without any."""
    out = None
    for i, (regex, _) in enumerate(DATE_LAYOUTS):
        out = F.when(c.rlike(regex), i) if out is None else out.when(c.rlike(regex), i)
    return F.when((c >= "0") & (c < ":"), out)


def parse_date(c: Column, day_first: bool, layout: Column | None = None) -> Column:
    """Read a date written in any known layout; null when none fits."""
    layout = layout_no(c) if layout is None else layout
    text = c
    for pattern, order in _FIXED_ORDER + (_DAY_FIRST if day_first else _MONTH_FIRST):
        text = F.regexp_replace(text, pattern, order)
    return F.when(layout.isNotNull(), text.try_cast("timestamp"))


def _per_column(df: DataFrame, steps, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregate every text column at once.

    The columns are stacked as (position, text), so the plan does not grow with
    their number. ``steps`` are rounds of values computed per text, each built
    on those before.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        raise ValueError("no text column to look at")
    texts = df.select(*[col(n) for n in names]).select(
        F.posexplode(F.array(*[col(n) for n in names])).alias("position", "text")
    )
    for values in steps:
        texts = texts.withColumns(values)
    found = texts.groupBy("position").agg(*[v.alias(n) for n, v in aggregates.items()])
    named = F.array(*[F.lit(n) for n in names])
    return found.select(F.element_at(named, F.col("position") + 1).alias("column_name"), *aggregates)


def _layout_aggregates() -> dict[str, Column]:
    layout, text = F.col("layout"), F.col("text")
    first = F.when(layout.between(1, 4), F.regexp_extract(text, r"^(\d{1,2})", 1).try_cast("int"))
    found = {"present": F.count(text)}
    found |= {f"layout_{i}_": F.count_if(layout == i) for i in range(len(DATE_LAYOUTS))}
    return found | {"first_field_": F.max(first), "sample_": F.min(text)}


def _layout_columns() -> list[Column]:
    """Detected layout, and whether day and month can be told apart."""
    layout = F.lit("unknown")
    for i, (_, name) in reversed(list(enumerate(DATE_LAYOUTS))):
        layout = F.when(F.col(f"layout_{i}_") > LAYOUT_SHARE * F.col("present"), F.lit(name)).otherwise(layout)
    day_first = layout.startswith("D") & (F.col("first_field_") > 12)
    return [
        F.when(day_first, F.concat(F.lit("D"), layout)).otherwise(layout).alias("pattern"),
        F.coalesce(day_first, F.lit(False)).alias("day_first_likely"),
        F.when(layout.startswith("YYYY"), False).otherwise(~F.coalesce(day_first, F.lit(False))).alias("ambiguous"),
        F.col("sample_").alias("sample"),
    ]


def date_formats(df: DataFrame) -> DataFrame:
    """Date layout of every text column, from all its values."""
    return _per_column(df, [{"layout": layout_no(F.col("text"))}], _layout_aggregates()).select("column_name", *_layout_columns())


# Shapes (digits as 9) of texts that are a date and nothing more, and the longest text whose shape tells that it is a whole number.
_DATE_SHAPES = [
    *[f"9999{x}{m}{x}{d}" for x in "-/" for m in ("9", "99") for d in ("9", "99")],
    *[f"{m}{x}{d}{x}{y}" for x in "/-." for m in ("9", "99") for d in ("9", "99") for y in ("9999", "99")], "99999999",
]
_SHAPED = 18


def _case(text: Column) -> Column:
    """What stands for a text when its type is inferred, the same for all texts that convert alike.

    A text that begins like no number and no date is one case. A short text without a date's
    beginning goes by its shape, its digits all being 9. Dates, and what begins like one, go by themselves:
    a column of dates has few.
    """
    shape = F.translate(text, "0123456789", "9" * 10)
    dated = shape.isin(_DATE_SHAPES) | (layout_no(text).isNotNull())
    plain = F.ltrim(text).rlike(r"^[0-9+.-]") | text.rlike(r"^\s")
    return F.when(~plain, F.lit("x")).when((F.length(text) <= _SHAPED) & ~dated, shape).otherwise(text)


def infer_types(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Type each text column could have: numeric, then date, if over 90 % of all rows convert.

    Cells are counted by case first (:func:`_case`), before and after the shuffle; conversions are
    tried once per case. ``tasks`` is for a table that lies in fewer tasks than that.
    """
    text, layout, n = F.col("text"), F.col("layout"), F.col("n")
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        raise ValueError("no text column to look at")
    cells = spread(df.select(*[col(c) for c in names]), tasks).select(F.posexplode(F.array(*[col(c) for c in names])).alias("position", "text"))
    cases = cells.groupBy("position", _case(text).alias("text")).agg(F.count(F.lit(1)).alias("n"))
    values = {
        "month_first_": parse_date(text, False, layout).isNotNull(),
        "day_first_": parse_date(text, True, layout).isNotNull(),
        "number_": is_number(text),
        "integer_": F.trim(text).try_cast("bigint").isNotNull(),
    }
    count_if = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    first = F.when(layout.between(1, 4), F.regexp_extract(text, r"^(\d{1,2})", 1).try_cast("int"))
    found = cases.withColumn("layout", layout_no(text)).withColumns(values).groupBy("position").agg(
        F.sum(n).alias("total"), count_if(text.isNotNull()).alias("present"),
        count_if(F.col("number_")).alias("numbers"), count_if(F.col("integer_")).alias("integers"),
        count_if(F.col("month_first_")).alias("month_first"), count_if(F.col("day_first_")).alias("day_first"),
        F.max(first).alias("first_field_"), F.lit(None).cast("string").alias("sample_"),
        *[count_if(layout == i).alias(f"layout_{i}_") for i in range(len(DATE_LAYOUTS))],
    )
    named = F.array(*[F.lit(c) for c in names])
    found = found.select(F.element_at(named, F.col("position") + 1).alias("column_name"), "*", *_layout_columns())
    best = F.greatest("month_first", "day_first")
    needed = TYPE_SHARE * F.col("total")
    return found.select(
        "column_name",
        "total",
        "numbers",
        best.alias("dates"),
        F.when(F.col("integers") == F.when(F.col("total") > 0, F.col("total")), "bigint")
        .when(F.col("numbers") > needed, "decimal")
        .when(best > needed, "datetime2")
        .otherwise("nvarchar")
        .alias("data_type"),
        (
            (F.col("day_first") > F.col("month_first"))
            | ((F.col("day_first") == F.col("month_first")) & F.col("day_first_likely"))
        ).alias("use_day_first"),
        "pattern",
        "ambiguous",
    )


def apply_inferred(df: DataFrame, inferred: DataFrame) -> DataFrame:
    """Convert the text columns as inferred; values that do not fit become null."""
    dates = {}
    types = {}
    for row in inferred.collect():  # one row per column
        if row["data_type"] in ("bigint", "decimal"):
            types[row["column_name"]] = "bigint" if row["data_type"] == "bigint" else "double"
        elif row["data_type"] == "datetime2":
            dates[row["column_name"]] = row["use_day_first"]
    out = df.withColumns({n: F.when(is_number(col(n)), F.trim(col(n))) for n in types}) if types else df
    out = cast_types(out, types, on_error="null") if types else out
    return out.withColumns({n: parse_date(col(n), day_first) for n, day_first in dates.items()}) if dates else out


# The statuses, and the numeric share of a first line that rules a header out.
PRESENT, MISSING, AMBIGUOUS = "present", "missing", "ambiguous"
HEADER_NUMERIC_SHARE = 0.5
# Share of a column's cells that makes it numeric, or of one length.
_COLUMN_SHARE = 0.9


def detect_headers(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """One row per delimited text file: ``file_path``, ``status``, ``reason`` and ``names``.

    The first line of a file is held against all its other lines. It is no
    header when half of its cells are numbers. Else each column has a vote: for a
    header where the cells below are numbers or all of one length and the first
    cell is not, against one where the first cell is like those below. Columns of
    mixed text have none, and without a majority the file is ambiguous.

    Lines are split and counted where they are read; only counts per file and
    column are shuffled. A quoted cell must not span lines. Files with blank lines
    only are missing a header; those of no bytes are not listed.
    """
    # A separator counts where an even number of quotes follows: of the pieces between quotes every other one, from the
    # last backwards. They are marked, and the line is split at the marks: one pass, however long the line is.
    mark, pieces = "\0", F.col("pieces")
    outside = F.transform(pieces, lambda p, i: F.when((F.size(pieces) - 1 - i) % 2 == 0, F.replace(p, F.lit(separator), F.lit(mark))).otherwise(p))
    lines = spark.read.text(path, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("file_path"), "value", F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at")
    )
    filled = lines.where(F.trim("value") != "").withColumn("pieces", F.split(F.translate("value", mark, ""), '"', -1))
    filled = filled.select("file_path", "at", F.split(F.array_join(outside, '"'), mark, -1).alias("cells"))
    cells = F.transform("cells", lambda c: F.trim(F.regexp_replace(F.trim(c), '^"|"$', "")))
    first = filled.groupBy("file_path").agg(F.min_by("cells", "at").alias("cells")).select("file_path", cells.alias("names"))
    number = is_number(F.col("cell"))
    columns = filled.select("file_path", F.posexplode(cells).alias("position", "cell")).groupBy("file_path", "position").agg(
        F.count_if(F.col("cell") != "").alias("n"), F.count_if(number).alias("numbers"), F.count(F.lit(1)).alias("lines"),
        F.min(F.when(F.col("cell") != "", F.length("cell"))).alias("shortest"), F.max(F.length("cell")).alias("longest"),
        F.sum(F.length("cell")).alias("chars"),
    )
    heads = first.select("file_path", F.posexplode("names").alias("position", "cell")).withColumn("is_number", number)
    both = heads.join(columns, ["file_path", "position"])
    below = F.col("n") - (F.col("cell") != "").cast("int")
    numeric = (F.col("numbers") - F.col("is_number").cast("int")) >= _COLUMN_SHARE * below
    # Lengths include the first line's; the others are of one length when the mean without it is the shortest or the longest.
    rest = F.col("chars") - F.length("cell")
    even = (rest == below * F.col("shortest")) | (rest == below * F.col("longest"))
    vote = (
        F.when(below <= 0, 0).when(numeric & ~F.col("is_number"), 1).when(numeric, -1)
        .when(even & (F.length("cell") * below != rest), 1).when(even, -1).otherwise(0)
    )
    votes = both.groupBy("file_path").agg(
        F.sum(vote).alias("votes"), F.avg(F.col("is_number").cast("double")).alias("share"), F.max("lines").alias("lines")
    )
    percent = F.format_string("%.0f%%", F.col("share") * 100)
    status = (
        F.when(F.col("share").isNull() | (F.col("share") >= HEADER_NUMERIC_SHARE) | (F.col("votes") < 0), MISSING)
        .when(F.col("votes") > 0, PRESENT).otherwise(AMBIGUOUS)
    )
    reason = (
        F.when(F.col("share").isNull(), "no line with text").when(F.col("share") >= HEADER_NUMERIC_SHARE, F.concat(F.lit("numbers make up "), percent, F.lit(" of the first line")))
        .when(F.col("votes") > 0, "the first line is unlike its columns").when(F.col("votes") < 0, "the first line is like its columns")
        .when(F.col("lines") <= 1, "one line only").otherwise("text columns only")
    )
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("_metadata.file_path").alias("file_path"))
    judged = files.join(votes, "file_path", "left").join(first, "file_path", "left")
    numbered = F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda c, i: F.concat(F.lit("col_"), i.cast("string")))
    return judged.select("file_path", status.alias("status"), reason.alias("reason"), F.when(status == PRESENT, F.col("names")).otherwise(numbered).alias("names"))
