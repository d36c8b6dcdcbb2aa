"""Registered queries of this subpackage, and SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from layerkit.llm import (
    bpe, mixing, nbsvm, packing, simhash, token_files, tool_calls, topk, toxicity, url_filter, vector_codes, weak_rules, whitening,
)
from layerkit.llm.common import held_out, table
from layerkit.session import scratch_path, stage

# Score from which a document counts as label 1.
QUALITY_CUT, TOXIC_CUT = 0.3, 0.5

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql.strip()
        return fn

    return register


@query()
def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Token files of all documents, written and read back: start, length and digest of each document's ids."""
    docs = table(spark, folder, "documents")
    shards = stage(token_files.write_token_files(docs, scratch_path(spark, "token-files")), "token-shards")
    return token_files.read_token_files(shards, "ids_crc32 long", token_files.ids_crc32)


# Tools that the derived calls name, with the schemas of their arguments.
TOOLS = {
    "search": {
        "type": "object", "required": ["query"], "additionalProperties": False,
        "properties": {"query": {"type": "string", "minLength": 1, "maxLength": 400}, "limit": {"type": "integer", "minimum": 1, "maximum": 10}},
    },
    "lookup": {
        "type": "object", "required": ["key", "exact"],
        "properties": {"key": {"type": "string", "pattern": "^[a-z]"}, "exact": {"type": "boolean"}},
    },
}


def derived_messages(conversations: DataFrame) -> DataFrame:
    """Messages with tool calls, made from the turns of real conversations.

    Each turn of the user makes a call whose arguments come from its whole text,
    and each answer holds the result. Four calls in seven wait for the one two turns
    later, which may wait again, so chains of waits for later calls form; the
    others wait for the ones two and four turns before, unless those wait for them. Some
    calls break their schema, name an unknown tool, or have no result.
    """
    text, turn = F.coalesce(F.col("text"), F.lit("")), F.col("turn")
    pick_of = lambda t: F.pmod(F.xxhash64("conv_id", t), F.lit(7))
    pick, later = pick_of(turn), lambda t: pick_of(t) < 4
    id_ = lambda t: F.concat(F.lit("call-"), t.cast("string"))
    search = F.to_json(F.struct(F.pmod(F.length(text), F.lit(13)).alias("limit"), text.alias("query")))
    exact = F.when(pick == 3, F.lit('"yes"')).otherwise(F.lit("true"))
    key = F.to_json(F.struct(F.lower(text).alias("key")))
    lookup = F.concat(F.left(key, F.length(key) - 1), F.lit(',"exact":'), exact, F.lit("}"))
    before = F.array_compact(F.array(
        F.when(~later(turn - 2), id_(turn - 2)), F.when(~(later(turn - 4) & later(turn - 2)), id_(turn - 4)),
    ))
    waits = F.when(later(turn), F.array(id_(turn + 2))).otherwise(before)
    name = F.when(pick % 3 == 0, "search").when(pick % 3 == 1, "lookup").otherwise("browse")
    call = F.concat(
        F.lit('<tool_call>{"id":"'), id_(turn), F.lit('","name":"'), name, F.lit('","arguments":'),
        F.when(name == "lookup", lookup).otherwise(search), F.lit(',"after":'), F.to_json(waits), F.lit("}</tool_call>"),
    )
    result = F.concat(F.lit("<tool_response>"), F.to_json(F.struct(id_(turn - 1).alias("id"), text.alias("content"))), F.lit("</tool_response>"))
    said = F.when(F.col("role") == "user", call).when(F.col("role") == "assistant", result).otherwise(text)
    return conversations.select("conv_id", "turn", said.alias("text"))


@query()
def op2_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls derived from all conversations: linked, ordered, validated, arguments as canonical JSON."""
    found = tool_calls.tool_calls(derived_messages(table(spark, folder, "conversations")), TOOLS)
    return found.select(
        "conv_id", "turn", "call_id", "name", "status", "result_turn", F.expr("step >> 20").alias("step_turn"), "depth",
        F.length("content").cast("long").alias("content_chars"), F.sha2("canonical", 256).alias("canonical_sha256"), F.concat_ws("; ", "faults").alias("faults"),
    )


def _scored(scored: DataFrame, cut: float) -> DataFrame:
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"),
    )


@query()
def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Probability of good quality of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = nbsvm.fit(docs, table(spark, folder, "labels"), "quality")
    return _scored(nbsvm.score(docs, model), QUALITY_CUT)


@query()
def op4_toxicity_grammar(spark: SparkSession, folder: str) -> DataFrame:
    """Probability of toxicity of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels"), "toxic")
    return _scored(toxicity.score(docs, model), TOXIC_CUT)


@query()
def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("""
with v as (
    select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
    where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), scored as (
    select q.r, q.vec_id as query_id, c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score
    from v q join v c on q.r <> c.r where q.vec_id % 100 = 0
), ranked as (
    select query_id, row_number() over (partition by r order by score desc, vec_id)::integer as rank, vec_id, score from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 10
""")
def op6_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The ten vectors with the highest integer inner product for every hundredth vector."""
    return topk.top_k(topk.integer_vectors(table(spark, folder, "embeddings")))


@query()
def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Place of every piece of every document."""
    return packing.pack(table(spark, folder, "documents"))


@query()
def op8_weak_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base measures of every document, and whether it is kept."""
    judged = weak_rules.judge(table(spark, folder, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


@query()
def op9_pair_index_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    return bpe.encode_decode(table(spark, folder, "documents"), digests=True)


URL_RULES = [
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
]


@query("""
with rules(rule, rule_host, rule_path, verdict) as (values
    ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
    ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
), cut as (
    select page_id, coalesce(case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end, '') as rest from pages
), parts as (
    select page_id, row_number() over () as n, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path,
        translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host from cut
), fits as (
    select n, rule, verdict, row_number() over (partition by n order by length(rule) desc, length(rule_host) desc) as place
    from parts join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict
from parts left join (select * from fits where place = 1) using (n)
""")
def op10_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page's URL."""
    return url_filter.judge_urls(table(spark, folder, "pages"), URL_RULES)


@query()
def op11_whitened_components(spark: SparkSession, folder: str) -> DataFrame:
    """Every sound vector projected on the four leading components of the distinct ones."""
    return whitening.whitened_components(table(spark, folder, "embeddings"))


def _codes_sql() -> str:
    """Two rounds of assignment and means, and a last assignment, over all parts and entries."""
    step = """
), a{n} as (
    select p.r, p.part, arg_min(b.entry, (list_sum(list_transform(list_zip(p.c, b.c), lambda z: (z[1] - z[2]) ** 2))::bigint, b.entry)) as entry,
        min(list_sum(list_transform(list_zip(p.c, b.c), lambda z: (z[1] - z[2]) ** 2))::bigint) as gap
    from p join b{n} b using (part) group by p.r, p.part"""
    means = """
), m{n} as (
    select part, entry, list(mean order by i) as c from (
        select a.part, a.entry, i, floor(sum(p.c[i]) / count(*))::bigint as mean
        from a{n} a join p using (r, part) cross join width cross join unnest(range(1, w + 1)) as t(i) group by a.part, a.entry, i
    ) group by part, entry
), b{next} as (
    select part, entry, coalesce(m.c, b.c) as c from b{n} b left join m{n} m using (part, entry)"""
    rounds = "".join(step.format(n=n) + (means.format(n=n, next=n + 1) if n < 2 else "") for n in range(3))
    return f"""
with v as (
    select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as x from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), width as (
    select max(len(x)) // 16 as w from v
), p as (
    select r, part, x[part * w + 1 : part * w + w] as c from v cross join width cross join unnest(range(16)) as t(part)
), seeds as (
    select row_number() over (order by vec_id) - 1 as entry, x from (select vec_id, min(x) as x from v where vec_id is not null group by vec_id order by vec_id limit 64)
), b0 as (
    select part, entry, x[part * w + 1 : part * w + w] as c from seeds cross join width cross join unnest(range(16)) as t(part){rounds}
), coded as (
    select v.vec_id, v.label, string_agg(lpad(lower(to_hex(a.entry)), 2, '0'), '' order by a.part) as code, sum(a.gap)::bigint as error
    from a2 a join v using (r) group by v.r, v.vec_id, v.label
), books as (
    select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) as codebooks_sha256 from b2
)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from coded cross join books
"""


@query(_codes_sql())
def op12_orchard_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Code and error of every sound vector, and the digest of the codebooks."""
    return vector_codes.compress(table(spark, folder, "embeddings"))


@query("""
with recursive sized as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
        ('0x' || substr(md5(coalesce(doc_id::varchar, text, '')), 1, 13))::bigint % 2147483647 as bits from documents
), sources as (
    select source, sum(size)::bigint as source_size from sized group by source
), placed as (
    select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 3 when 1 then 1 else 2 end as weight from sources
), whole as (
    select 3 * sum(source_size)::hugeint as over_words from placed
), rounds as (
    select 0 as step, 0::hugeint as stopped, sum(weight)::hugeint as free from placed
    union all
    select step + 1, (select coalesce(sum(source_size), 0)::hugeint from placed where weight * (over_words - 4 * stopped) >= 4 * source_size * free),
        (select coalesce(sum(weight), 0)::hugeint from placed where weight * (over_words - 4 * stopped) < 4 * source_size * free)
    from rounds, whole where step < 40 and free > 0
), last as (
    select (over_words - 4 * stopped) as num, 2 * free as den, free from rounds, whole order by step desc limit 1
), targets as (
    select source, source_size, case when free > 0 and weight * num < 4 * source_size * free
        then weight::double * num::double / den::double else (2 * source_size)::double end as target from placed, last
), rated as (
    select *, case when source_size > 0 then target / source_size else 0 end as rate from targets
), drawn as (
    select s.source, j, sum(case when (s.bits * (j * 15485863 + 1) % 2147483647)::double < (rate - floor(rate)) * 2147483647 then size else 0 end) as drawn_words
    from sized s join rated r on s.source is not distinct from r.source cross join (select unnest(range(64)) as j) group by s.source, j
), chosen as (
    select d.source, arg_min(j, (abs((floor(rate) * source_size + drawn_words)::double - target), j)) as draw
    from drawn d join rated r on d.source is not distinct from r.source group by d.source
)
select s.doc_id, s.source, s.size, r.source_size, r.target,
    (s.size * (floor(r.rate) + case when (s.bits * (c.draw * 15485863 + 1) % 2147483647)::double < (r.rate - floor(r.rate)) * 2147483647 then 1 else 0 end))::bigint as taken
from sized s join rated r on s.source is not distinct from r.source join chosen c on s.source is not distinct from c.source
""")
def op13_mixed_sources(spark: SparkSession, folder: str) -> DataFrame:
    """How many words the mix takes of every document, by targets of their sources."""
    sizes = stage(mixing.sized(table(spark, folder, "documents")), "sizes")
    rates = stage(mixing.mixing_rates(sizes), "mixing-rates")
    return mixing.copies(sizes, rates).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
