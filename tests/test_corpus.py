import json
import re

import pytest
from pyspark.sql import functions as F

from layerkit.corpus import classify as C, extract as E, redact as D, rules as R


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


SECTION = (
    'section Section1;\r\nshared Base = let\r\n  Source = Sql.Database("srv", "db")\r\nin\r\n  Source;\r\n'
    'shared #"Base Total" = let\r\n  s = Base,\r\n  note = "Param_X and Unused",\r\n  t = Table.Skip(s, 4)\r\nin\r\n  t;\r\n'
    'shared Param_X = "v" meta [IsParameterQuery=true];\r\nshared Empty = ;\r\nshared Unused = Csv.Document("x.csv");\r\n'
)


@pytest.fixture(scope="module")
def section(spark):
    return spark.createDataFrame([("flow", SECTION)], "dataflow_name string, text string")


def test_queries_of_a_section(section):
    got = {r["query_name"]: r["code"] for r in E.extract_queries(section).collect()}
    assert list(sorted(got)) == ["Base", "Base Total", "Param_X", "Unused"]
    assert got["Param_X"] == '"v" meta [IsParameterQuery=true]'
    assert got["Base"].startswith("let\r\n") and got["Base"].endswith("Source")


def test_a_name_given_twice_counts_once(spark):
    df = spark.createDataFrame([("f", "shared A = 1;\nshared B = 2;\nshared A = 3;"), ("g", "nothing"), ("h", None)], "dataflow_name string, text string")
    assert rows(E.extract_queries(df).select("dataflow_name", "query_name", "code")) == [("f", "A", "3"), ("f", "B", "2")]


@pytest.mark.parametrize(
    "document, method, names",
    [
        ({"pbi:mashup": {"document": SECTION}, "document": "shared No = 1;"}, "pbi_mashup_document", 4),
        ({"annotations": [{"name": "x", "value": "shared No = 1;"}, {"name": "pbi:mashup.document", "value": SECTION}]}, "annotation_pqm_document", 4),
        ({"pbi:mashup": {"document": "no queries"}, "entities": [{"name": "E", "partitions": [{"source": {"expression": ["let", "in"]}}]}, {"partitions": [{"source": {"expression": "1"}}]}]}, "entities", 2),
        ({"document": SECTION}, "root_document", 4),
        ({"document": {"pqm": SECTION}}, "root_document_pqm", 4),
        ({"name": "x", "entities": [{"name": "E"}]}, "none", 1),
        ("{broken", "failed", 1),
    ],
)
def test_documents(spark, document, method, names):
    text = document if isinstance(document, str) else json.dumps(document)
    found = E.read_documents(spark.createDataFrame([("f", text)], "dataflow_name string, json string")).collect()
    assert {r["extraction_method"] for r in found} == {method} and len(found) == names
    if method == "entities":
        assert {(r["query_name"], r["code"], r["line_count"], r["starts_with_let"]) for r in found} == {("E", "let\nin", 2, True), ("unknown", "1", 1, False)}
    if method in ("none", "failed"):
        assert (found[0]["query_name"], found[0]["line_count"]) == ({"none": "NO_QUERIES_FOUND", "failed": "PARSE_ERROR"}[method], 0)


def test_inventory_and_edges(section):
    found = E.section_queries(section)
    got = {r["query_name"]: (r["source_type"], r["role"], r["depends_on"]) for r in C.inventory(found).collect()}
    # "Base" is not found inside "Base Total", nor names inside a text literal.
    assert got == {
        "Base": ("sql_server", "staging", []), "Base Total": ("derived", "transformation", ["Base"]),
        "Param_X": ("derived", "parameter_or_function", []), "Unused": ("csv", "output_entity", []),
    }
    edges = [("flow", "Base Total", "Base")]
    assert rows(C.dependency_edges(found)) == edges
    assert rows(C.query_edges(E.extract_queries(section))) == edges
    assert "Exchange hashpartitioning" not in C.inventory(found)._jdf.queryExecution().executedPlan().toString()


def test_failures_stay_in_the_inventory(spark):
    df = spark.createDataFrame([("a", "{broken"), ("b", "{}")], "dataflow_name string, json string")
    found = C.inventory(E.document_queries(df))
    assert rows(found.select("dataflow_name", "source_type", "role")) == [("a", "error", "error"), ("b", "unknown", "unknown")]
    assert C.inventory_summary(found).count() == 0


@pytest.mark.parametrize(
    "code, expected",
    [
        ("Sql.Database(x)", "sql_server"), ("Json.Document(Web.Contents(x))", "web"), ("Excel.Workbook(Csv.Document())", "excel"),
        ("PostgreSQL.Database()", "postgresql"), ("x = MySQL.Database()", "mysql"), ("#shared[Sql.Databases]", "sql_server"), ("Table.FromRecords({})", "static_table"), ("1 + 1", "derived"),
        ("GoogleBigQuery.Database()", "bigquery"), ("Odbc.Query(x)", "odbc"),
    ],
)
def test_source_type_first_match_wins(spark, code, expected):
    assert spark.range(1).select(C.source_type(F.lit(code))).collect()[0][0] == expected


def test_layers(spark):
    df = spark.createDataFrame([(r,) for r in ("output_entity", "transformation", "staging", "helper")], "role string")
    assert [r[0] for r in df.select(C.target_layer(F.col("role"))).collect()] == ["bronze", "silver", "silver", "skip"]
    assert [r[0] for r in df.select(C.target_layer(F.col("role"), split_staging=True)).collect()][2] == "bronze"


def test_rule_scan_lines_and_whole_texts(spark):
    text = (
        "let\n  a = Table.Skip(x, 4),\n  f = (a, b) =>\n  let c = 1 in c,\n  r = Table.ReplaceValue(a, 1, 2),\n"
        '  q = Table.ReplaceValue(r, 2, 3),\n  i = Table.AddColumn(q, "c",\n   each if [x] = 1 then 2 else 3)\nin i'
    )
    wide = "Table.TransformColumnTypes(a, {" + ", ".join(f'{{"c{i}", type text}}' for i in range(50)) + "})"
    narrow = "Table.TransformColumnTypes(a, {" + ", ".join(f'{{"c{i}", type text}}' for i in range(49)) + "})"
    df = spark.createDataFrame([("a", text), ("wide", wide), ("narrow", narrow), ("none", None)], "file_path string, text string")
    hits = R.scan_rules(df, R.RISKS)
    assert rows(hits.select("file_path", "risk_id", "line_number")) == [
        ("a", "RISK-02", 3), ("a", "RISK-04", 2), ("a", "RISK-11", 7), ("a", "RISK-12", 5), ("wide", "RISK-09", 1),
    ]
    assert rows(R.severity_summary(hits)) == [("Low", 4), ("Medium", 1)]
    assert ("RISK-04", "Table.Skip", "Low", 1, 1) in rows(R.rule_summary(hits))


@pytest.mark.parametrize("rule", R.RISKS, ids=lambda r: r.risk_id)
def test_every_rule_is_a_pattern_both_engines_read(spark, rule):
    re.compile(rule.regex)
    assert spark.range(1).select(F.lit("").rlike(rule.regex)).collect()[0][0] is False


def test_unknown_names_and_backlog(spark):
    df = spark.createDataFrame([("a", "x = Odd.Call(1)\ny = Text.Upper(Odd.Call(2))"), ("b", "  Odd.Call(3)\nOther(1)")], "file_path string, text string")
    found = R.unknown_names(df)
    assert rows(found) == [("Odd.Call", 2, 3, "Odd.Call(3)"), ("Other", 1, 1, "Other(1)")]
    known = spark.createDataFrame([("Other",), ("Text.Upper",)], "name string")
    assert rows(R.unknown_names(df, known)) == [("Odd.Call", 2, 3, "Odd.Call(3)")]

    backlog = spark.createDataFrame(
        [("Odd.Call", 1, 1, "old", "2023-01-01", "Documented")],
        "pattern string, files_affected long, occurrences long, sample string, first_seen string, status string",
    )
    out = R.update_backlog(backlog, found, F.lit("2024-01-01"))
    assert rows(out) == [("Odd.Call", 2, 3, "old", "2023-01-01", "Documented"), ("Other", 1, 1, "Other(1)", "2024-01-01", "Backlog")]
    assert rows(R.set_status(out, "Other", "Planned"))[1][-1] == "Planned"


@pytest.mark.parametrize(
    "before, after",
    [
        ('AzureStorage.Blobs("https://acme.blob.core.windows.net/box/a")', 'AzureStorage.Blobs("<REDACTED_URL>/<REDACTED_CONTAINER>/a")'),
        ('Csv.Document("https://acme.blob.core.windows.net/box/a.csv")', 'Csv.Document("<REDACTED_PATH>")'),
        ("https://acme.blob.core.windows.net/", "<REDACTED_URL>/"),
        ("abfss://box@acme.dfs.core.windows.net/x", "abfss://<REDACTED_CONTAINER>@<REDACTED_ACCOUNT>.dfs.core.windows.net/x"),
        ('Web.Contents("http://example.com/a?b=1")', 'Web.Contents("<REDACTED_URL>")'),
        ('Sql.Database("srv", "db")', 'Sql.Database("<REDACTED_SERVER>", "<REDACTED_DB>")'),
        ("id 12345678-abcd-ABCD-1234-1234567890ab.", "id <REDACTED_GUID>."),
        ('File.Contents("C:\\x\\y.xlsx")', 'File.Contents("<REDACTED_PATH>")'),
        ('{[Item = "Sheet 1", Kind = "Sheet"]}', '{[Item = "<REDACTED_SHEET>", Kind = "<REDACTED_VALUE>"]}'),
        ("each [Net Amount] > 12345", "each [<REDACTED_COL>] > <REDACTED_NUMBER>"),
        ('#"Filtered Rows"', '#"<REDACTED_IDENT>"'),
        ("Table.Skip(x, 42)", "Table.Skip(x, 42)"),
        ('f("a", ",", "b c")', 'f("<REDACTED_VALUE>", ",", "<REDACTED_VALUE>")'),
        ('f("é")', 'f("<REDACTED_VALUE>")'),
        ('say "open', 'say "open'),
        ('""', '""'),
        ("plain", "plain"),
        ("x123 é456 789", "x123 é456 <REDACTED_NUMBER>"),
    ],
)
def test_redaction(spark, before, after):
    assert D.redact(spark.createDataFrame([(before,)], "t string"), "t").collect()[0][0] == after


def test_redaction_of_two_columns_keeps_nulls_and_order(spark):
    df = spark.createDataFrame([(1, "[a b]", None)], "id int, x string, y string")
    assert rows(D.redact(df, ["x", "y"])) == [(1, "[<REDACTED_COL>]", None)]


def test_links(spark):
    edges = spark.createDataFrame([(1, "/a"), (1, "/b"), (2, "/a")], "from_id int, to_name string")
    known = spark.createDataFrame([("/a",), ("/a",)], "name string")
    assert rows(C.link_edges(edges, known)) == [(1, "/a", True), (1, "/b", False), (2, "/a", True)]


def test_whole_text_rules_give_every_hit(spark):
    line = 'x = Table.AddColumn(t, "n",\n  each if [a] then 1 else 2)'
    docs = spark.createDataFrame([("f", "\n".join([line] * 3)), ("g", line + " " + line.replace("\n", " ")), ("h", "nothing\0"), ("i", None)], "file string, text string")
    hits = R.scan_rules(docs, [r for r in R.RISKS if r.risk_id == "RISK-11"], "file")
    got = sorted((r.file_path, r.line_number, r.match_excerpt) for r in hits.collect())
    first = 'x = Table.AddColumn(t, "n",'
    assert got == [("f", 1, first), ("f", 3, first), ("f", 5, first), ("g", 1, first), ("g", 2, 'each if [a] then 1 else 2) x = Table.AddColumn(t, "n",   each if [a] then 1 else 2)')]
