"""Queries out of exported documents.

A document is JSON holding query texts in one of four places; the first place
that yields any query counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from layerkit.functions.columns import col

# Fixed value: how a section document introduces a query.
SHARED = r'(?U)shared\s+(#?"[^"]+"|[\w.]+)\s*=\s*'

# Names of the places in a document, and of the rows that stand for none.
MASHUP_KEY, MASHUP_ANNOTATION = "pbi:mashup", "pbi:mashup.document"
METHODS = ["pbi_mashup_document", "annotation_pqm_document", "entities", "root_document", "root_document_pqm"]
PARSE_ERROR, NO_QUERIES = "PARSE_ERROR", "NO_QUERIES_FOUND"

_DOCUMENT = f"""
    `{MASHUP_KEY}` struct<document: string>,
    annotations array<struct<name: string, value: string>>,
    entities array<struct<name: string, partitions: array<struct<source: struct<expression: string>>>>>,
    document string
"""


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _body(piece: Column) -> Column:
    return _strip(F.regexp_replace(_strip(piece), r";$", ""))


def _with_queries(df: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """Add for each section text an array of its queries (name, code), in their order.

    Names and pieces are projections of their own, so that each text is matched
    once. A name given twice counts as its last query.
    """
    df = df.withColumns(
        {f"__n_{k}": F.regexp_extract_all(text, F.lit(SHARED), 1) for k, text in texts.items()}
        | {f"__c_{k}": F.split(text, SHARED) for k, text in texts.items()}
    )
    df = df.withColumns(
        {f"__n_{k}": F.transform(f"__n_{k}", lambda n: F.regexp_replace(n, r'^#?"|"$', "")) for k in texts}
        | {f"__c_{k}": F.transform(F.slice(f"__c_{k}", 2, F.size(f"__n_{k}")), _body) for k in texts}
    )
    df = df.withColumns({
        k: F.filter(
            F.zip_with(f"__n_{k}", f"__c_{k}", lambda n, c: F.struct(n.alias("name"), c.alias("code"))),
            lambda q: F.length(q["code"]) > 0,
        )
        for k in texts
    })
    return _last_of_name(df, list(texts)).drop(*[f"__{x}_{k}" for x in "nc" for k in texts])


def _last_of_name(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keep of every name in arrays of queries the last entry."""
    df = df.withColumns({f"__names_{k}": F.transform(k, lambda q: q["name"]) for k in columns})

    def later(names: Column):
        return lambda q, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), q["name"])

    return df.withColumns({k: F.filter(k, later(F.col(f"__names_{k}"))) for k in columns}).drop(
        *[f"__names_{k}" for k in columns]
    )


def _text_or_lines(c: Column) -> Column:
    """An expression given as one text, or as an array of lines."""
    lines = F.from_json(c, "array<string>")
    return F.when(c.startswith("[") & lines.isNotNull(), F.array_join(lines, "\n")).otherwise(c)


def _entity_queries(entities: Column) -> Column:
    def per_entity(entity: Column) -> Column:
        name = F.coalesce(entity["name"], F.lit("unknown"))
        return F.transform(
            F.coalesce(entity["partitions"], F.array()),
            lambda p: F.struct(name.alias("name"), _strip(_text_or_lines(p["source"]["expression"])).alias("code")),
        )

    found = F.flatten(F.transform(F.coalesce(entities, F.array()), per_entity))
    return F.filter(found, lambda q: F.length(q["code"]) > 0)


def section_queries(docs: DataFrame, name: str = "dataflow_name", text: str = "text") -> DataFrame:
    """One row per section text, with the array of its queries (name, code)."""
    base = docs.select(col(name).alias("dataflow_name"), col(text).alias("__text"))
    return _with_queries(base, {"queries": F.col("__text")}).select("dataflow_name", "queries")


def _exploded(found: DataFrame, *kept: str) -> DataFrame:
    """One row per query.

    The outer form is used because an inner explode makes the optimizer repeat
    the whole extraction in a filter that drops empty arrays early.
    """
    return found.select("dataflow_name", *kept, F.posexplode_outer("queries").alias("position", "q")).filter(
        F.col("position").isNotNull()
    )


def extract_queries(docs: DataFrame, name: str = "dataflow_name", text: str = "text") -> DataFrame:
    """Queries of section texts: (dataflow_name, position, query_name, code)."""
    return _exploded(section_queries(docs, name, text)).select(
        "dataflow_name", "position", F.col("q.name").alias("query_name"), F.col("q.code").alias("code")
    )


def line_count(code: Column) -> Column:
    return F.when(code == "", 0).otherwise(F.size(F.split(code, r"\r\n|\r|\n")))


def document_queries(docs: DataFrame, name: str = "dataflow_name", json: str = "json") -> DataFrame:
    """One row per JSON document: the array of its queries and the place they came from.

    A document that is not JSON, or holds no query, has one entry saying so.
    """
    raw = col(json)
    parsed = docs.select(
        col(name).alias("dataflow_name"),
        F.try_parse_json(raw).isNull().alias("__bad"),
        F.from_json(raw, _DOCUMENT).alias("d"),
    )
    annotation = F.try_element_at(
        F.filter(
            "d.annotations",
            lambda a: (a["name"] == MASHUP_ANNOTATION) & (F.coalesce(F.length(a["value"]), F.lit(0)) > 0),
        ),
        F.lit(1),
    )
    pqm = F.when(F.col("d.document").startswith("{"), F.get_json_object("d.document", "$.pqm"))
    found = parsed.select(
        "dataflow_name", "__bad",
        F.col(f"d.`{MASHUP_KEY}`.document").alias("__t0"),
        annotation["value"].alias("__t1"),
        _entity_queries(F.col("d.entities")).alias("p2"),
        F.when(pqm.isNull(), F.col("d.document")).alias("__t3"),
        pqm.alias("__t4"),
    )
    found = _last_of_name(_with_queries(found, {f"p{i}": F.col(f"__t{i}") for i in (0, 1, 3, 4)}), ["p2"])
    queries = F.array(F.struct(F.when(F.col("__bad"), PARSE_ERROR).otherwise(NO_QUERIES).alias("name"), F.lit("").alias("code")))
    method = F.when(F.col("__bad"), "failed").otherwise("none")
    for i, place in reversed(list(enumerate(METHODS))):
        hit = F.coalesce(F.size(f"p{i}"), F.lit(0)) > 0
        queries = F.when(hit, F.col(f"p{i}")).otherwise(queries)
        method = F.when(hit, place).otherwise(method)
    return found.select("dataflow_name", method.alias("extraction_method"), queries.alias("queries"))


def read_documents(docs: DataFrame, name: str = "dataflow_name", json: str = "json") -> DataFrame:
    """One row per query of every JSON document, with the place it came from."""
    code = F.col("q.code")
    return _exploded(document_queries(docs, name, json), "extraction_method").select(
        "dataflow_name",
        F.col("q.name").alias("query_name"),
        code.alias("code"),
        line_count(code).alias("line_count"),
        code.startswith("let").alias("starts_with_let"),
        "extraction_method",
    )
