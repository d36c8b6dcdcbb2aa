"""Rule scan over texts, its summary, unknown names, and the backlog they feed."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from layerkit.functions.columns import col
from layerkit.session import spread
from layerkit.sources.changes import merge


class Rule(NamedTuple):
    risk_id: str
    pattern_name: str
    regex: str
    severity: str
    marker: str
    # Patterns over several lines are looked for in the whole text; a hit is on the line where it begins.
    whole_text: bool = False
    # Texts of which every match holds one; only texts that do meet the pattern. Without any, all do.
    literals: tuple[str, ...] = ()


# Known risky patterns.
RISKS = [
    Rule("RISK-01", "AzureStorage.Blobs", r"AzureStorage\.Blobs\s*\(", "High", "marked", literals=("AzureStorage.Blobs",)),
    Rule("RISK-02", "Custom function", r"\([\w\s,]*\)\s*=>\s*let", "Medium", "marked", True, literals=("=>",)),
    Rule("RISK-03", "Excel.Workbook", r"Excel\.Workbook\s*\(", "High", "marked", literals=("Excel.Workbook",)),
    Rule("RISK-04", "Table.Skip", r"Table\.Skip\s*\(", "Low", "clean", literals=("Table.Skip",)),
    Rule("RISK-05", "Table.UnpivotOtherColumns", r"Table\.UnpivotOtherColumns\s*\(", "Medium", "clean", literals=("Table.UnpivotOtherColumns",)),
    Rule("RISK-06", "Table.Pivot", r"Table\.Pivot\s*\(", "Medium", "clean", literals=("Table.Pivot",)),
    Rule("RISK-07", "Splitter.SplitTextByEachDelimiter", r"Splitter\.SplitTextByEachDelimiter\b", "Low", "clean", literals=("Splitter.SplitTextByEachDelimiter",)),
    Rule("RISK-08", "Text.BeforeDelimiter / Text.AfterDelimiter", r"Text\.(Before|After)Delimiter\b", "Low", "clean", literals=("Text.BeforeDelimiter", "Text.AfterDelimiter")),
    Rule("RISK-09", "Table.TransformColumnTypes with 50+ columns",
         r'Table\.TransformColumnTypes\s*\([^{}]*\{\s*(?:\{[^{}]*\}\s*,?\s*){50}', "Low", "clean", True, literals=("Table.TransformColumnTypes",)),
    Rule("RISK-10", "Table.NestedJoin", r"Table\.NestedJoin\s*\(", "Low", "clean", literals=("Table.NestedJoin",)),
    Rule("RISK-11", "Table.AddColumn with a condition", r"Table\.AddColumn\s*\([^()]*each\s+if", "Low", "clean", True, literals=("Table.AddColumn",)),
    Rule("RISK-12", "Replacer.ReplaceText chain",
         r"(?s)Table\.ReplaceValue\s*\(.*Table\.ReplaceValue\s*\(", "Low", "clean", True, literals=("Table.ReplaceValue",)),
    Rule("RISK-13", "Table.AddIndexColumn", r"Table\.AddIndexColumn\s*\(", "High", "marked", literals=("Table.AddIndexColumn",)),
    Rule("RISK-14", "Optional record access", r"\[Attributes\]\?\s*\[Hidden\]\?", "Low", "clean", literals=("[Attributes]?",)),
    Rule("RISK-15", "Hardcoded storage path", r"https://[\w]+\.blob\.core\.windows\.net/|abfss://", "Medium", "clean", literals=(".blob.core.windows.net/", "abfss://")),
]

# Function names a text may use without being reported as unknown.
KNOWN_FUNCTIONS = [
    "Table.SelectRows", "Table.AddColumn", "Table.RenameColumns", "Table.RemoveColumns", "Table.SelectColumns",
    "Table.TransformColumnTypes", "Table.Sort", "Table.Group", "Table.NestedJoin", "Table.ExpandTableColumn",
    "Table.Distinct", "Table.Combine", "Table.ReplaceValue", "Table.FillDown", "Table.FillUp", "Table.Pivot",
    "Table.Unpivot", "Table.UnpivotOtherColumns", "Table.DuplicateColumn", "Table.TransformColumns",
    "Table.FirstN", "Table.LastN", "Table.Skip", "Table.Buffer", "Table.PromoteHeaders", "Table.RemoveFirstN",
    "Table.RemoveLastN", "Table.AddIndexColumn",
    "Sql.Database", "Sql.Databases", "Oracle.Database", "Odbc.DataSource", "OleDb.DataSource", "Csv.Document",
    "Excel.Workbook", "Excel.CurrentWorkbook", "Json.Document", "Xml.Document", "Web.Contents",
    "SharePoint.Files", "SharePoint.Contents", "Folder.Files", "File.Contents", "AzureStorage.Blobs",
    "Sql.Server", "Lakehouse.Contents",
    "Text.Upper", "Text.Lower", "Text.Trim", "Text.TrimStart", "Text.TrimEnd", "Text.Length", "Text.Start",
    "Text.End", "Text.Contains", "Text.StartsWith", "Text.EndsWith", "Text.Replace", "Text.Combine",
    "Text.Split", "Text.PadStart", "Text.PadEnd", "Text.Reverse", "Text.From", "Text.BeforeDelimiter",
    "Text.AfterDelimiter", "Splitter.SplitTextByEachDelimiter",
    "Date.Year", "Date.Month", "Date.Day", "Date.DayOfWeek", "Date.DayOfYear", "Date.From", "DateTime.From",
    "Date.AddDays", "Date.AddMonths", "Date.AddYears", "DateTime.LocalNow", "Date.FromText", "DateTime.FromText",
    "Number.Round", "Number.RoundDown", "Number.RoundUp", "Number.Abs", "Number.From", "Int64.From",
    "Number.IsEven", "Number.IsOdd",
    "List.Sum", "List.Average", "List.Min", "List.Max", "List.Count", "List.Distinct", "List.First", "List.Last",
]

_LINE_END = r"\r\n|\r|\n"
# Put before a match; a text's own signs of this kind are left out of excerpts.
_MARK = "\0"
_CALL = r"\b([A-Za-z_][\w.]*)\s*\("


def _hit(rule: Rule, line_number: Column, excerpt: Column) -> Column:
    return F.struct(
        F.lit(rule.risk_id).alias("risk_id"),
        F.lit(rule.pattern_name).alias("pattern_name"),
        F.lit(rule.severity).alias("severity"),
        line_number.alias("line_number"),
        F.trim(excerpt).alias("match_excerpt"),
    )


def _may_match(text: Column, rules: Iterable[Rule]) -> Column:
    """Whether a text holds a literal of one of the rules, or one of them has none."""
    rules = list(rules)
    if any(not r.literals for r in rules):
        return F.lit(True)
    return reduce(lambda a, b: a | b, [text.contains(x) for r in rules for x in r.literals], F.lit(False))


def scan_rules(docs: DataFrame, rules: Sequence[Rule], file: str = "file_path", text: str = "text", tasks: int | None = None) -> DataFrame:
    """Lines that match a rule: ``(file_path, risk_id, pattern_name, severity, line_number, match_excerpt)``.

    One scan of the texts serves all rules. A text, then each of its lines, is
    first searched for the rules' literals; patterns are tried where one is
    found. Rules over several lines mark where their matches begin. Nothing is
    joined, and large corpora are not shuffled; ``tasks`` is for few texts that
    lie in fewer tasks than that.
    """
    by_line = [r for r in rules if not r.whole_text]
    whole = [r for r in rules if r.whole_text]
    base = spread(docs.select(col(file).alias("file_path"), col(text).alias("__text")), tasks)
    base = base.where(F.col("__text").isNotNull() & _may_match(F.col("__text"), rules))
    # A mark before each match says on which lines matches begin, and how many.
    marked = {
        f"__marked{i}": F.when(
            _may_match(F.col("__text"), [rule]),
            F.split(F.regexp_replace(F.translate("__text", _MARK, ""), rule.regex, f"{_MARK}$0"), _LINE_END),
        )
        for i, rule in enumerate(whole)
    }
    lines = F.when(_may_match(F.col("__text"), by_line), F.split("__text", _LINE_END))
    split = base.select("file_path", lines.alias("__lines"), *[c.alias(n) for n, c in marked.items()])

    def numbered(name: str, no: int) -> Column:
        return F.transform(name, lambda line, i: F.struct((i + 1).alias("at"), line.alias("line"), F.lit(no).alias("no")))

    items = [numbered("__lines", -1)]
    items += [F.filter(numbered(name, no), lambda x: x["line"].contains(_MARK)) for no, name in enumerate(marked)]
    kind = "array<struct<at:int,line:string,no:int>>"
    each = split.select("file_path", F.explode(F.concat(*[F.coalesce(x, F.array().cast(kind)) for x in items])).alias("x")).select("file_path", "x.*")
    at, line, no = F.col("at"), F.col("line"), F.col("no")
    hits = [F.when((no == -1) & _may_match(line, [r]) & line.rlike(r.regex), _hit(r, at, line)) for r in by_line]
    out = F.array_compact(F.array(*hits)) if hits else None
    for i, rule in enumerate(whole):
        n = F.length(line) - F.length(F.translate(line, _MARK, ""))
        again = F.array_repeat(_hit(rule, at, F.translate(line, _MARK, "")), n)
        out = again if out is None else F.when(no == i, again).otherwise(out)
    return each.select("file_path", F.inline(out))


def rule_summary(hits: DataFrame) -> DataFrame:
    """Files and occurrences of each rule."""
    return hits.groupBy("risk_id", "pattern_name", "severity").agg(
        F.count_distinct("file_path").alias("files_affected"), F.count(F.lit(1)).alias("occurrences")
    )


def severity_summary(hits: DataFrame) -> DataFrame:
    return hits.groupBy("severity").agg(F.count(F.lit(1)).alias("occurrences"))


def unknown_names(
    docs: DataFrame, known: Iterable[str] | DataFrame = KNOWN_FUNCTIONS, file: str = "file_path",
    text: str = "text", pattern: str = _CALL,
) -> DataFrame:
    """Names that match ``pattern`` but are not known, with files, occurrences and a sample line.

    ``known`` is a list, or a DataFrame with a ``name`` column for long ones.
    """
    texts = docs.select(col(file).alias("file_path"), col(text).alias("__text"))
    lines = texts.select("file_path", F.explode(F.split("__text", _LINE_END)).alias("line"))
    names = lines.select(
        "file_path", "line", F.explode(F.regexp_extract_all("line", F.lit(pattern), 1)).alias("pattern")
    )
    if not isinstance(known, DataFrame):
        names = names.filter(~F.col("pattern").isin(list(known)))
    found = names.groupBy("pattern").agg(
        F.count_distinct("file_path").alias("files_affected"),
        F.count(F.lit(1)).alias("occurrences"),
        F.min(F.trim("line")).alias("sample"),
    )
    if isinstance(known, DataFrame):
        # One row per name by now, however often it occurs.
        found = found.join(known.select(F.col("name").alias("pattern")).distinct(), "pattern", "left_anti")
    return found


def update_backlog(backlog: DataFrame, unknown: DataFrame, seen_on: Column) -> DataFrame:
    """Add unknown names to the backlog with status Backlog; known rows get fresh counts and keep their status."""
    rows = unknown.select(
        "pattern", "files_affected", "occurrences", "sample",
        seen_on.alias("first_seen"), F.lit("Backlog").alias("status"),
    )
    return merge(
        backlog, rows, "pattern", set={c: c for c in ("files_affected", "occurrences")}
    )


def set_status(backlog: DataFrame, pattern: str, status: str) -> DataFrame:
    return backlog.withColumn("status", F.when(F.col("pattern") == pattern, status).otherwise(F.col("status")))
