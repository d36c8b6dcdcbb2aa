"""Corpus jobs."""

from pyspark.sql import functions as F

from layerkit.corpus import classify as C, extract as E, redact as D, rules as R
from layerkit.plans.base import query
from layerkit.session import spread

# Tasks for heavy work on texts that lie in few row groups.
TASKS = 32

# --- A corpus of section documents, one per part, whose content follows from its columns ---

_SOURCES = ["Csv.Document", "Sql.Database", "Excel.Workbook", "Web.Contents"]


def _source_call():
    out = F.lit(_SOURCES[0])
    for i, name in list(enumerate(_SOURCES))[1:]:
        out = F.when(F.col("p_size") % len(_SOURCES) == i, name).otherwise(out)
    return out


def _section():
    """Three queries: one reading a source, one using it (for odd sizes only by a text literal), a parameter."""
    used = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('#"'), "p_name", F.lit('"')))
    return F.concat(
        F.lit('section Section1;\r\nshared #"'), "p_name", F.lit('" = let\r\n  Source = '), _source_call(),
        F.lit('("'), "p_type", F.lit('.csv"),\r\n  Kept = Table.SelectRows(Source, each [Size] > '),
        F.col("p_size").cast("string"), F.lit(')\r\nin\r\n  Kept;\r\nshared Clean = let\r\n  s = '),
        F.coalesce(used, F.concat(F.lit('"'), "p_name", F.lit('"'))),
        F.lit(",\r\n  t = Table.Skip(s, "), F.col("p_size").cast("string"),
        F.lit(')\r\nin\r\n  Odd.Call(t);\r\nshared Parameter = "'), "p_brand", F.lit('" meta [IsParameterQuery = true];\r\n'),
    )


def _sections(t):
    return spread(t.part, TASKS).select(F.concat(F.lit("flow "), F.col("p_partkey").cast("string")).alias("dataflow_name"), _section().alias("text"))


_FLOW = "'flow ' || p_partkey"
_CALL = "case p_size % 4 when 1 then 'Sql.Database' when 2 then 'Excel.Workbook' when 3 then 'Web.Contents' else 'Csv.Document' end"
_NL = "chr(13) || chr(10)"
_CODE_1 = f"""'let' || {_NL} || '  Source = ' || {_CALL} || '("' || p_type || '.csv"),' || {_NL}
    || '  Kept = Table.SelectRows(Source, each [Size] > ' || p_size || ')' || {_NL} || 'in' || {_NL} || '  Kept'"""
_CODE_2 = f"""'let' || {_NL} || '  s = ' || case when p_size % 2 = 0 then '#"' else '"' end || p_name || '",' || {_NL}
    || '  t = Table.Skip(s, ' || p_size || ')' || {_NL} || 'in' || {_NL} || '  Odd.Call(t)'"""
_CODE_3 = """'"' || p_brand || '" meta [IsParameterQuery = true]'"""
_QUERIES = f"""(
    select {_FLOW} as dataflow_name, 0 as position, p_name as query_name, {_CODE_1} as code, * from part
    union all select {_FLOW}, 1, 'Clean', {_CODE_2}, * from part
    union all select {_FLOW}, 2, 'Parameter', {_CODE_3}, * from part)"""


@query(f"select dataflow_name, position, query_name, code from {_QUERIES}")
def extract_queries(t):
    return E.extract_queries(_sections(t))


_LINES = "case query_name when 'Parameter' then 1 else 5 end"
_STATUS = """
    union all select {flow}, 'PARSE_ERROR', 0, false, 'failed' from part where p_partkey % 7 = 5
    union all select {flow}, 'NO_QUERIES_FOUND', 0, false, 'none' from part where p_partkey % 7 = 6
""".format(flow=_FLOW)


def _documents(t):
    """The same texts inside JSON documents, in each place a document may hold them."""
    key = F.col("p_partkey") % 7
    text = _section()
    lines = F.array(F.lit("let"), F.concat(F.lit("  Source = "), _source_call(), F.lit('("x")')), F.lit("in"), F.lit("  Source"))
    partition = F.struct(F.struct(lines.alias("expression")).alias("source"))
    flat = F.struct(F.struct(F.array_join(lines, "\n").alias("expression")).alias("source"))
    name = F.col("p_name").alias("name")
    json = (
        F.when(key == 0, F.to_json(F.struct(F.struct(text.alias("document")).alias("pbi:mashup"))))
        .when(key == 1, F.to_json(F.struct(F.array(
            F.struct(F.lit("other").alias("name"), F.lit("shared No = 1;").alias("value")),
            F.struct(F.lit("pbi:mashup.document").alias("name"), text.alias("value")),
        ).alias("annotations"))))
        .when((key == 2) & (F.col("p_size") % 2 == 0), F.to_json(F.struct(F.array(F.struct(name, F.array(partition).alias("partitions"))).alias("entities"))))
        .when(key == 2, F.to_json(F.struct(F.array(F.struct(name, F.array(flat).alias("partitions"))).alias("entities"))))
        .when(key == 3, F.to_json(F.struct(F.struct(F.lit("").alias("document")).alias("pbi:mashup"), text.alias("document"))))
        .when(key == 4, F.to_json(F.struct(F.struct(text.alias("pqm")).alias("document"))))
        .when(key == 5, F.concat(F.lit('{"document": "'), F.col("p_name")))
        .otherwise(F.to_json(F.struct(name)))
    )
    return t.part.select(F.concat(F.lit("flow "), F.col("p_partkey").cast("string")).alias("dataflow_name"), json.alias("json"))


_FOUND = f"""
    select dataflow_name, query_name, {_LINES} as line_count, query_name <> 'Parameter' as starts_with_let,
           case p_partkey % 7 when 0 then 'pbi_mashup_document' when 1 then 'annotation_pqm_document'
             when 3 then 'root_document' else 'root_document_pqm' end as extraction_method
    from {_QUERIES} where p_partkey % 7 in (0, 1, 3, 4)
    union all select {_FLOW}, p_name, 4, true, 'entities' from part where p_partkey % 7 = 2
    {_STATUS}
"""


@query(_FOUND)
def read_documents(t):
    return E.read_documents(_documents(t)).drop("code")


@query(
    f"""
    select dataflow_name, query_name as from_query, p_name as to_query from {_QUERIES}
    where query_name = 'Clean' and p_size % 2 = 0
    """
)
def query_dependencies(t):
    """Edges between queries; a name inside a text literal is no reference."""
    return C.dependency_edges(E.section_queries(_sections(t)))


@query(
    f"""
    select dataflow_name, query_name as from_query, p_name as to_query from {_QUERIES}
    where query_name = 'Clean' and p_size % 2 = 0
    """
)
def query_dependencies_joined(t):
    """The same edges from a table with one row per query."""
    return C.query_edges(E.extract_queries(_sections(t)))


_KIND = """case when query_name = 'Parameter' then 'helper' when query_name = 'Clean' then 'transformation'
    when p_size % 2 = 0 then 'staging' else 'output_entity' end"""
_TYPE = """case when query_name in ('Parameter', 'Clean') then 'derived' else
    case p_size % 4 when 1 then 'sql_server' when 2 then 'excel' when 3 then 'web' else 'csv' end end"""


@query(
    f"""
    select dataflow_name, query_name, case query_name when 'Parameter' then 1 else 5 end as line_count, source_type, role,
      case when query_name = 'Clean' and p_size % 2 = 0 then p_name else '' end as depends_on,
      case role when 'output_entity' then 'bronze' when 'transformation' then 'silver' when 'staging' then 'silver' else 'skip' end as layer
    from (select *, {_TYPE} as source_type, {_KIND} as role from {_QUERIES})
    """
)
def query_inventory(t):
    found = C.inventory(E.section_queries(_sections(t)))
    depends = F.array_join("depends_on", ", ").alias("depends_on")
    return found.select("dataflow_name", "query_name", "line_count", "source_type", "role", depends, C.target_layer(F.col("role")).alias("layer"))


@query(
    f"""
    select source_type, role, count(*) as queries, count(distinct dataflow_name) as documents,
           count(case when query_name <> 'Parameter' then 1 end) as let_queries
    from (select *, {_TYPE} as source_type, {_KIND} as role from {_QUERIES}) group by 1, 2
    """
)
def inventory_summary(t):
    return C.inventory_summary(C.inventory(E.section_queries(_sections(t))))


_LOCATED = f"""
    select extraction_method, case when query_name in ('PARSE_ERROR', 'NO_QUERIES_FOUND') then
        case extraction_method when 'failed' then 'error' else 'unknown' end
        when extraction_method = 'entities' then 'output_entity' when query_name = 'Parameter' then 'helper'
        when query_name = 'Clean' then 'transformation' when even then 'staging' else 'output_entity' end as role,
      count(*) as queries
    from (select f.*, p.p_size % 2 = 0 as even from ({_FOUND}) f join part p on f.dataflow_name = 'flow ' || p.p_partkey)
    group by 1, 2
"""


@query(_LOCATED)
def document_inventory(t):
    """Inventory straight from JSON documents, failures included."""
    found = C.inventory(E.document_queries(_documents(t)))
    return found.groupBy("extraction_method", "role").agg(F.count(F.lit(1)).alias("queries"))


@query(
    f"""
    select {_FLOW} as file_path, 'RISK-03' as risk_id, 'High' as severity, 3 as line_number,
           'Source = Excel.Workbook("' || p_type || '.csv"),' as match_excerpt from part where p_size % 4 = 2
    union all
    select {_FLOW}, 'RISK-04', 'Low', 9, 't = Table.Skip(s, ' || p_size || ')' from part
    """
)
def risk_scan(t):
    """The known risks, over the derived corpus."""
    hits = R.scan_rules(_sections(t), R.RISKS, "dataflow_name")
    return hits.drop("pattern_name")


# One text that each known risk finds, in the order of the risks.
_RISKY = [
    'x = AzureStorage.Blobs("a")', "f = (a, b) => let", "Excel.Workbook (File)", "Table.Skip(t)", "Table.UnpivotOtherColumns(t)", "Table.Pivot(t)",
    "Splitter.SplitTextByEachDelimiter", "Text.BeforeDelimiter(a)", "Table.TransformColumnTypes(t, {" + '{"c", type text}, ' * 50 + "})",
    "Table.NestedJoin(a)", 'Table.AddColumn(t, "n", each if a then b', "Table.ReplaceValue(a) Table.ReplaceValue(b)", "Table.AddIndexColumn(t)",
    "[Attributes]?[Hidden]?", "abfss://store",
]
_RISK_ROWS = ", ".join(f"({i}, 'RISK-{i + 1:02}', '{r.severity}', '{text}')" for i, (text, r) in enumerate(zip(_RISKY, R.RISKS)))


@query(
    f"""
    select {_FLOW} as file_path, risk_id, severity, (unnest(generate_series(1, case when no = 11 then 1 else 1 + p_size % 3 end)) + 1)::int as line_number,
           trim(excerpt) as match_excerpt
    from part join (values {_RISK_ROWS}) as risks(no, risk_id, severity, excerpt) on p_partkey % {len(_RISKY)} = no
    """
)
def all_risks(t):
    """Every known risk over texts made from parts: one to three hits in a text, each on its line."""
    text = F.element_at(F.array(*map(F.lit, _RISKY)), (F.col("p_partkey") % len(_RISKY) + 1).cast("int"))
    lines = F.concat(F.array("p_name"), F.array_repeat(text, (F.col("p_size") % 3 + 1).cast("int")), F.array(F.lit("in"), F.col("p_type")))
    docs = t.part.select(F.concat(F.lit("flow "), F.col("p_partkey").cast("string")).alias("file"), F.array_join(lines, "\n").alias("text"))
    return R.scan_rules(docs, R.RISKS, "file").drop("pattern_name")


@query(
    f"select 'Odd.Call' as pattern, count(*) as files_affected, count(*) as occurrences, 'Odd.Call(t);' as sample from part"
)
def unknown_functions(t):
    return R.unknown_names(_sections(t), file="dataflow_name")


@query(
    """
    select 'Odd.Call' as pattern, count(*) as files_affected, count(*) as occurrences, 'Odd.Call(t);' as sample,
           date '2024-05-01' as first_seen, 'Backlog' as status from part
    union all
    select p_brand, count(*), 0, 'kept', date '2023-01-01', 'Documented' from part group by p_brand
    """
)
def backlog_update(t):
    old = t.part.groupBy(F.col("p_brand").alias("pattern")).agg(F.count(F.lit(1)).alias("files_affected")).select(
        "pattern", "files_affected", F.lit(0).cast("bigint").alias("occurrences"), F.lit("kept").alias("sample"),
        F.lit("2023-01-01").cast("date").alias("first_seen"), F.lit("Documented").alias("status"),
    )
    found = R.unknown_names(_sections(t), file="dataflow_name")
    return R.update_backlog(old, found, F.lit("2024-05-01").cast("date"))


# --- Texts of the documents and pages tables ---

# License lines, mail addresses, long numbers, tokens.
_TEXT_RULES = [
    R.Rule("TEXT-01", "license", r"(?i)licen[sc]e", "Low", "clean"),
    R.Rule("TEXT-02", "mail address", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", "High", "marked", literals=("@",)),
    R.Rule("TEXT-03", "long number", r"\b[0-9]{9,}\b", "Medium", "marked"),
    R.Rule("TEXT-04", "token", r'token = "[0-9a-f]+"', "High", "marked", literals=('token = "',)),
]
_TEXT_HITS = "(" + " union all ".join(
    f"select cast(doc_id as varchar) as file_path, '{r.risk_id}' as risk_id, '{r.pattern_name}' as pattern_name, "
    f"'{r.severity}' as severity, i as line_number, trim(line, ' ') as match_excerpt "
    f"from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1)::int as i from documents) "
    f"where regexp_matches(line, '{r.regex}')"
    for r in _TEXT_RULES
) + ")"


def _texts(t):
    return t.documents.select(F.col("doc_id").cast("string").alias("file_path"), "text")


@query(f"select * from {_TEXT_HITS}")
def rule_scan(t):
    return R.scan_rules(_texts(t), _TEXT_RULES, tasks=TASKS)


@query(
    f"""
    select risk_id, pattern_name, severity, count(distinct file_path) as files_affected, count(*) as occurrences
    from {_TEXT_HITS} group by 1, 2, 3
    """
)
def rule_summary(t):
    return R.rule_summary(R.scan_rules(_texts(t), _TEXT_RULES, tasks=TASKS))


@query(f"select severity, count(*) as occurrences from {_TEXT_HITS} group by 1")
def severity_summary(t):
    return R.severity_summary(R.scan_rules(_texts(t), _TEXT_RULES, tasks=TASKS))




@query(
    """
    with w as (select doc_id, line, unnest(regexp_extract_all(line, '@([A-Za-z0-9]+)[.]', 1)) as pattern
               from (select doc_id, unnest(string_split(text, chr(10))) as line from documents))
    select pattern, count(distinct doc_id) as files_affected, count(*) as occurrences, min(trim(line, ' ')) as sample
    from w where pattern not in (select 'mail' || r_regionkey from region) group by 1
    """
)
def unknown_tokens(t):
    """Mail hosts that are not in a table of known names."""
    known = t.region.select(F.concat(F.lit("mail"), F.col("r_regionkey").cast("string")).alias("name"))
    return R.unknown_names(_texts(t), known, pattern=r"@([A-Za-z0-9]+)\.")


def _for_twin(pattern: str, replacement: str) -> list[tuple[str, str]]:
    """A redaction rule in the dialect of an engine whose word classes are ASCII only and that has no word ends of other scripts.

    Word characters and digits are spelled as classes. A match between word ends takes in the signs beside it and
    puts them back; as neighbours share one, it is looked for twice.
    """
    word = r"\p{L}\p{N}_"
    out = pattern.replace(r"[\w-]", f"[{word}-]").replace(r'[^"\s]', r'[^"\s\p{Z}]').replace(r"\d", r"\p{Nd}")
    if not (out.startswith(r"\b") and out.endswith(r"\b")):
        return [(out, replacement)]
    inner = out[2:-2]
    groups = inner.count("(") - inner.count("(?")
    return [(f"(^|[^{word}]){inner}($|[^{word}])", f"\\1{replacement}\\{groups + 2}")] * 2


def _redact_sql(column: str, source: str, keep: str) -> str:
    """All redaction rules, then the pass over quoted values."""
    out = column
    for pattern, replacement in (step for rule in D.REDACTIONS for step in _for_twin(*rule)):
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
    return f"""
    with r as (select {keep}, string_split({out}, '"') as p from {source})
    select {keep}, array_to_string(list_transform(p, lambda x, i: case when i % 2 = 0 and i < len(p)
        and regexp_matches(x, '[\\p{{L}}\\p{{N}}_]') and not contains(x, '<REDACTED_') then '<REDACTED_VALUE>' else x end), '"') as {column}
    from r"""


@query(_redact_sql("text", "documents", "doc_id"))
def redact_text(t):
    return D.redact(t.documents.select("doc_id", "text"), "text", tasks=TASKS)


@query(_redact_sql("html", "pages", "page_id"))
def redact_pages(t):
    return D.redact(t.pages.select("page_id", "html"), "html", tasks=TASKS)


@query(
    """
    with k as (select distinct regexp_extract(url, '^https?://[^/]+(/[^/?#]*)', 1) as name from pages),
    e as (select page_id as from_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as to_name from pages)
    select from_id, to_name, to_name in (select name from k) as resolved, count(*) as links from e group by all
    """
)
def dependency_edges(t):
    """Links between pages, and whether the target is the first path part of a known page."""
    known = t.pages.select(F.regexp_extract("url", r"^https?://[^/]+(/[^/?#]*)", 1).alias("name"))
    edges = t.pages.select(
        F.col("page_id").alias("from_id"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("to_name")
    )
    return C.link_edges(edges, known).groupBy("from_id", "to_name", "resolved").agg(F.count(F.lit(1)).alias("links"))


@query(
    """
    select page_id, case when contains(lower(url), 'https://m.') then 'mobile'
        when contains(lower(url), '.example.org') or contains(lower(url), '.example.net') then 'other' else 'derived' end as source_type
    from pages
    """
)
def url_source_type(t):
    """First-match classification with a caller's own rules."""
    rules = [(["https://m."], "mobile"), ([".example.org", ".example.net"], "other")]
    return t.pages.select("page_id", C.source_type(F.col("url"), rules).alias("source_type"))
