"""Source type, role, dependencies and target layer of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from layerkit.corpus.extract import NO_QUERIES, PARSE_ERROR, line_count
from layerkit.functions.text import quote
from layerkit.operators.joins import join_on

# Source type by the calls a text contains; the first match wins, else "derived".
SOURCE_TYPES = [
    (["sql.database", "sql.databases"], "sql_server"),
    (["analysisservices.database"], "analysis_services"),
    (["sharepoint.files", "sharepoint.tables"], "sharepoint"),
    (["excel.workbook"], "excel"),
    (["csv.document"], "csv"),
    (["web.contents", "web.browsercontents"], "web"),
    (["odata.feed"], "odata"),
    (["azurestorage.blobs", "azurestorage.datalake"], "azure_storage"),
    (["powerbi.dataflows"], "linked_dataflow"),
    (["table.fromrecords", "table.fromlist"], "static_table"),
    (["json.document"], "json"),
    (["mysql.database"], "mysql"),
    (["postgresql.database"], "postgresql"),
    (["oracle.database"], "oracle"),
    (["odbc.datasource", "odbc.query"], "odbc"),
    (["activedirectory.domains"], "active_directory"),
    (["exchange.contents"], "exchange"),
    (["facebook.graph"], "facebook"),
    (["salesforce.data"], "salesforce"),
    (["googlebigquery.database"], "bigquery"),
]

# Calls that read a source directly, and names that mark helpers and parameters.
DIRECT_SOURCES = [
    "sql.database", "sharepoint.", "excel.workbook", "csv.document", "web.contents", "odata.feed",
    "azurestorage.blobs", "azurestorage.datalake", "json.document", "mysql.database", "postgresql.database",
]
HELPER_NAMES = ["source", "connection", "parameter", "sample file", "transform sample file", "transform file"]
PARAMETER_PREFIXES = ["param_", "parameter", "fn_", "func_"]

# A quoted identifier, a text literal (skipped), or a bare identifier.
_TOKEN = r'(?U)#"([^"]+)"|"[^"]*"|([\w.]+)'


def _any(c: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


def _calls(c: Column, parts: list[str]) -> Column:
    """Whether a text holds one of some names, not as the end of a longer name."""

    def found(part: str) -> Column:
        # Looking for the plain text first spares most texts the pattern.
        return c.contains(part) & c.rlike((r"(?<![a-z0-9_])" if part[0].isalpha() else "") + quote(part))

    return reduce(lambda a, b: a | b, map(found, parts))


def source_type(code: Column, rules=SOURCE_TYPES) -> Column:
    """First source type whose calls appear in the text."""
    text = F.lower(code)
    out = F.lit("derived")
    for parts, name in reversed(rules):
        out = F.when(_calls(text, parts), F.lit(name)).otherwise(out)
    return out


def role(name: Column, code: Column, referenced: Column) -> Column:
    """What a query is for, from its name, its sources, and whether others use it."""
    lowered = F.lower(name)
    direct = _any(F.lower(code), DIRECT_SOURCES)
    return (
        F.when(lowered.isin(HELPER_NAMES), "helper")
        .when(reduce(lambda a, b: a | b, [lowered.startswith(p) for p in PARAMETER_PREFIXES]), "parameter_or_function")
        .when(direct & ~referenced, "output_entity")
        .when(direct, "staging")
        .otherwise("transformation")
    )


def _tokens(code: Column) -> Column:
    """Identifiers of a text, quoted or bare; text literals are passed over."""
    return F.array_distinct(F.concat(F.regexp_extract_all(code, F.lit(_TOKEN), 1), F.regexp_extract_all(code, F.lit(_TOKEN), 2)))


def linked_queries(found: DataFrame) -> DataFrame:
    """Add to each query of a document's array the names it depends on, and to the document those used.

    Queries refer to others of their document only, so all is found inside its
    row. Names are matched whole: ``Sales`` is not found inside ``SalesTotal``.
    """

    def link(names: Column):
        def linked(q: Column) -> Column:
            others = F.array_except(F.array_intersect(_tokens(q["code"]), names), F.array(q["name"]))
            return F.struct(q["name"].alias("name"), q["code"].alias("code"), F.array_sort(others).alias("depends_on"))

        return linked

    # Separate projections: each array is computed once, not once per element.
    out = found.withColumn("__names", F.transform("queries", lambda q: q["name"]))
    out = out.withColumn("queries", F.transform("queries", link(F.col("__names"))))
    return out.withColumn("used", F.array_distinct(F.flatten(F.transform("queries", lambda q: q["depends_on"])))).drop("__names")


def dependency_edges(found: DataFrame) -> DataFrame:
    """Edges ``from_query`` -> ``to_query`` of documents with an array of queries; no shuffle."""
    rows = linked_queries(found).select("dataflow_name", F.explode_outer("queries").alias("q"))
    return rows.select(
        "dataflow_name", F.col("q.name").alias("from_query"), F.explode_outer("q.depends_on").alias("to_query")
    ).filter(F.col("to_query").isNotNull())


def query_edges(queries: DataFrame, salt: int = 8) -> DataFrame:
    """The same edges from a table with one row per query.

    Identifiers are matched to the document's query names by an equi-join; a
    name that most queries use is matched in ``salt`` tasks.
    """
    used = queries.select(
        "dataflow_name", F.col("query_name").alias("from_query"), F.explode(_tokens(F.col("code"))).alias("token")
    ).filter((F.col("token") != "") & (F.col("token") != F.col("from_query")))
    names = queries.select(F.col("dataflow_name").alias("d"), F.col("query_name").alias("to_query")).distinct()
    return join_on(used, names, ["dataflow_name", "token"], ["d", "to_query"], "inner", salt=salt).select(
        "dataflow_name", "from_query", "to_query"
    )


def link_edges(sources: DataFrame, known: DataFrame, salt: int = 8) -> DataFrame:
    """Edges ``(from_id, to_name)`` with a flag telling whether the target is known by name."""
    names = known.select(F.col("name").alias("__name"), F.lit(True).alias("__hit")).distinct()
    return join_on(sources, names, "to_name", "__name", "left", salt=salt).select(
        "from_id", "to_name", F.col("__hit").isNotNull().alias("resolved")
    )


def inventory(found: DataFrame) -> DataFrame:
    """One row per query of documents with an array of queries: type, role, size and dependencies."""
    kept = [c for c in found.columns if c not in ("dataflow_name", "queries")]
    rows = linked_queries(found).select("dataflow_name", *kept, "used", F.explode_outer("queries").alias("q")).filter(
        F.col("q").isNotNull()
    )
    name, code = F.col("q.name"), F.col("q.code")
    kind = F.when(name == PARSE_ERROR, "error").when(name == NO_QUERIES, "unknown")
    return rows.select(
        "dataflow_name",
        name.alias("query_name"),
        line_count(code).alias("line_count"),
        code.startswith("let").alias("starts_with_let"),
        kind.otherwise(source_type(code)).alias("source_type"),
        kind.otherwise(role(name, code, F.array_contains("used", name))).alias("role"),
        F.col("q.depends_on").alias("depends_on"),
        *kept,
    )


def inventory_summary(inventoried: DataFrame) -> DataFrame:
    """Number of documents and queries by source type and role; rows standing for failures are left out."""
    valid = inventoried.filter(~F.col("query_name").isin(PARSE_ERROR, NO_QUERIES))
    return valid.groupBy("source_type", "role").agg(
        F.count(F.lit(1)).alias("queries"),
        F.count_distinct("dataflow_name").alias("documents"),
        F.count_if("starts_with_let").alias("let_queries"),
    )


def target_layer(role: Column, split_staging: bool = False) -> Column:
    """Layer a query's table belongs to; helpers and parameters get none."""
    return (
        F.when(role == "output_entity", "bronze")
        .when(role == "transformation", "silver")
        .when(role == "staging", "bronze" if split_staging else "silver")
        .otherwise("skip")
    )
