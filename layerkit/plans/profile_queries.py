"""Table profiler."""

import datetime

from pyspark.sql import functions as F

from layerkit.functions.columns import col
from layerkit.plans.base import query
from layerkit.profiling import findings as G, infer as I, profile as P, relations as R, state as V
from layerkit.session import scratch_path

# A view of orders with nulls, few values, negative amounts, and names that hint at keys.
_SALES = """(select o_orderkey as order_id, o_custkey as customer_id, o_orderstatus as status,
    nullif(o_orderpriority, '5-LOW') as priority, o_totalprice - 5000 as amount, o_orderdate as ordered_at,
    case when o_orderkey % 16 = 0 then null else 'user' || o_custkey || '@example.com' end as email,
    '+44 20 ' || (1000 + o_custkey) as phone, 'https://example.com/o/' || o_orderkey as link,
    o_totalprice > 100000 as large from orders)"""

_SALES_TYPES = {
    "order_id": "bigint", "customer_id": "bigint", "status": "nvarchar", "priority": "nvarchar",
    "amount": "decimal", "ordered_at": "datetime2", "email": "nvarchar", "phone": "nvarchar",
    "link": "nvarchar", "large": "bit",
}


def _sales(t):
    key, customer = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    return t.orders.select(
        key.alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("status"),
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("priority"),
        (F.col("o_totalprice") - 5000).alias("amount"),
        F.col("o_orderdate").alias("ordered_at"),
        F.when(key % 16 == 0, None).otherwise(F.concat(F.lit("user"), customer, F.lit("@example.com"))).alias("email"),
        F.concat(F.lit("+44 20 "), (1000 + F.col("o_custkey")).cast("string")).alias("phone"),
        F.concat(F.lit("https://example.com/o/"), key.cast("string")).alias("link"),
        (F.col("o_totalprice") > 100000).alias("large"),
    )


def _profile_sql(table: str, source: str, types: dict[str, str]) -> str:
    """Profile of a table written out column by column."""
    parts = []
    for i, (name, kind) in enumerate(types.items()):
        numeric, text, dated = kind in ("bigint", "decimal"), kind == "nvarchar", kind == "datetime2"
        parts.append(f"""
        select '{table}' as table_name, {i} as position, '{name}' as column_name, '{kind}' as data_type,
          count(*) as total_count, count({name}) as non_null_count, count(*) - count({name}) as null_count,
          (count(*) - count({name})) / count(*) * 100 as null_percentage,
          count(distinct {name}) as distinct_count, count(distinct {name}) / count({name}) * 100 as cardinality_percentage,
          {f"min({name})::double" if numeric else "null::double"} as min_value,
          {f"max({name})::double" if numeric else "null::double"} as max_value,
          {f"round(avg({name}::double), 4)" if numeric else "null::double"} as avg_value,
          {f"min({name})::varchar" if dated else "null::varchar"} as min_date,
          {f"max({name})::varchar" if dated else "null::varchar"} as max_date,
          {f"min(length({name}))" if text else "null::bigint"} as min_length,
          {f"max(length({name}))" if text else "null::bigint"} as max_length,
          {f"round(avg(length({name})), 4)" if text else "null::double"} as avg_length,
          {f'''case when count_if(regexp_matches({name}, '@.+[.].+')) > 0.8 * count({name}) then 'email'
               when count_if(regexp_matches({name}, '^[+]?[0-9][0-9 ()-]+$')) > 0.8 * count({name}) then 'phone'
               when count_if(regexp_matches({name}, '^https?://|^www[.]')) > 0.8 * count({name}) then 'url' end'''
             if text else "null::varchar"} as pattern,
          case when count(distinct {name}) between 1 and 10 then (
            select string_agg(v || '=' || n, '; ' order by n desc, v) from (
              select {name}::varchar as v, count(*) as n from {source} where {name} is not null
              group by 1 order by 2 desc, 1 limit 5)) end as top_values
        from {source}""")
    return "\nunion all ".join(parts)


def _flat(profile):
    """Profile with rounded averages and top values as text, for comparison."""
    top = F.array_join(F.transform("top_values", lambda v: F.concat(v["value"], F.lit("="), v["count"].cast("string"))), "; ")
    return profile.withColumns(
        {"avg_value": F.round("avg_value", 4), "avg_length": F.round("avg_length", 4), "top_values": top}
    ).drop("min_exact", "max_exact")


@query(_profile_sql("sales", _SALES, _SALES_TYPES))
def profile_table(t):
    """Every column of a table with nulls, patterns, dates and few-valued columns."""
    return _flat(P.profile(_sales(t), "sales"))


@query(
    """
    select 'big_key' as column_name, min(9007199254740992 + o_orderkey)::varchar as min_exact, max(9007199254740992 + o_orderkey)::varchar as max_exact from orders
    union all select 'price', min(o_totalprice::decimal(20, 4))::varchar, max(o_totalprice::decimal(20, 4))::varchar from orders
    """
)
def profile_exact_ends(t):
    """Ends of whole numbers beyond 2^53, and of decimals, to the last digit."""
    orders = t.orders.select((F.lit(9007199254740992) + F.col("o_orderkey")).alias("big_key"), F.col("o_totalprice").cast("decimal(20,4)").alias("price"))
    return P.profile(orders, "orders").select("column_name", "min_exact", "max_exact")


_LINE_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "bigint",
    "l_quantity": "decimal", "l_extendedprice": "decimal", "l_discount": "decimal", "l_tax": "decimal",
    "l_returnflag": "nvarchar", "l_linestatus": "nvarchar", "l_shipdate": "datetime2",
}


@query(_profile_sql("lineitem", "lineitem", _LINE_TYPES))
def profile_lineitem(t):
    return _flat(P.profile(t.lineitem, "lineitem"))


_EVENT_TYPES = {
    "event_id": "bigint", "ts": "datetime2", "user_id": "bigint", "event_type": "nvarchar",
    "value": "decimal", "props": "nvarchar",
}
_CUSTOMER_TYPES = {
    "c_custkey": "bigint", "c_name": "nvarchar", "c_nationkey": "bigint", "c_acctbal": "decimal",
    "c_mktsegment": "nvarchar",
}


@query(_profile_sql("events", "events", _EVENT_TYPES) + "\nunion all " + _profile_sql("customer", "customer", _CUSTOMER_TYPES))
def profile_tables(t):
    return _flat(P.profile_all({"events": t.events, "customer": t.customer}))


@query(
    "select table_name, position, column_name, data_type, total_count, null_count, min_value, max_value, pattern, top_values "
    f"from ({_profile_sql('sales', _SALES, {n: k for n, k in _SALES_TYPES.items()})}) where column_name in ('status', 'amount', 'large')"
)
def profile_subset(t):
    """Chosen columns, distinct values estimated in the first pass."""
    wanted = ["status", "amount", "large"]
    return _flat(P.profile(_sales(t), "sales", wanted, distinct_error=0.02)).select(
        "table_name", "position", "column_name", "data_type", "total_count", "null_count",
        "min_value", "max_value", "pattern", "top_values",
    )


@query(
    """
    select * from (
      select 'orders' as table_name, name as column_name, value, count(*) as count
      from (unpivot (select columns(*)::varchar from orders) on columns(*) into name name value value) group by all
    ) qualify count(*) over (partition by column_name) <= 10 and row_number() over (partition by column_name order by count desc, value) <= 5
    """
)
def profile_top_values(t):
    found = P.profile(t.orders, "orders")
    return found.select("table_name", "column_name", F.inline("top_values"))


_SALES_PROFILE = f"({_profile_sql('sales', _SALES, _SALES_TYPES)})"
_IS_KEY = "cardinality_percentage >= 99 and null_percentage <= 1 and data_type in ('bigint', 'nvarchar')"


@query(f"select table_name, column_name, cardinality_percentage from {_SALES_PROFILE} where {_IS_KEY}")
def profile_keys(t):
    return G.pk_candidates(P.profile(_sales(t), "sales")).select("table_name", "column_name", "cardinality_percentage")


@query(
    f"""
    select column_name, array_to_string(list_filter([
      case when k then 'unique' end,
      case when k or null_percentage < 5 then 'not_null' end,
      case when distinct_count between 1 and 10 then 'accepted_values: [''' ||
        regexp_replace(replace(top_values, '; ', ''', '''), '=[0-9]+', '', 'g') || ''']' end,
      case when not k and (column_name like '%\\_id' escape '\\' or column_name like '%\\_key' escape '\\')
        then 'relationships to dim_' || p || ' or fct_' || p end,
      case when pattern is not null then pattern || '_format (custom test)' end,
      case when min_value < 0 and contains(column_name, 'amount') then 'non_negative (custom test)' end
    ], lambda x: x is not null), ' | ') as tests
    from (select *, ({_IS_KEY}) as k, replace(replace(column_name, '_id', ''), '_key', '') as p from {_SALES_PROFILE})
    """
)
def profile_tests(t):
    tests = G.recommended_tests(P.profile(_sales(t), "sales"))
    return tests.select("column_name", F.array_join("tests", " | ").alias("tests"))


@query(
    f"""
    with p as (select * from {_SALES_PROFILE}),
    n as (select *, column_name || ' has ' || format('{{:,}}', null_count) || ' nulls (' || printf('%.1f', null_percentage) || '%) - ' as text from p)
    select column_name, 'many_nulls' as kind, text || 'Consider if column is needed' as message from n where null_percentage > 20
    union all select column_name, 'nulls', text || 'Handle in staging model' from n where null_percentage > 5 and null_percentage <= 20
    union all select column_name, 'few_values', column_name || ' has only ' || distinct_count || ' distinct values - Use accepted_values test'
      from p where distinct_count <= 3 and cardinality_percentage < 1
    union all select column_name, 'negative', column_name || ' has negative values (min: ' || min_value || ') - Verify business logic'
      from p where min_value < 0 and column_name = 'amount'
    """
)
def profile_findings(t):
    return G.quality_findings(P.profile(_sales(t), "sales")).select("column_name", "kind", "message")


@query(
    f"""
    with p as (select *, ({_IS_KEY}) as k from {_SALES_PROFILE}),
    a as (select string_agg(column_name, ', ' order by position) filter (not k and null_percentage < 5) as required,
                 string_agg(column_name, ', ' order by position) filter (distinct_count between 1 and 10) as categorical,
                 string_agg(column_name, ', ' order by position) filter (null_percentage > 5) as nullable,
                 string_agg(column_name, ', ' order by position) filter (pattern is not null) as patterned,
                 arg_min(column_name, position) filter (k) as key from p)
    select 0 as position, 'Use ' || key || ' as primary key' as recommendation from a
    union all select 1, 'Add unique + not_null tests to ' || key from a
    union all select 2, 'Add not_null tests to: ' || array_to_string(string_split(required, ', ')[1:5], ', ') from a
    union all select 3, 'Add accepted_values tests to: ' || categorical from a
    union all select 4, 'Handle nulls in: ' || nullable from a
    union all select 5, 'Consider format validation tests for: ' || patterned from a
    """
)
def profile_recommendations(t):
    return G.recommendations(P.profile(_sales(t), "sales")).select("position", "recommendation")


@query(
    """
    with b as (select count(*) as n, count(distinct o_orderpriority) as d, count(distinct o_totalprice) as p from orders),
         a as (select count(*) as n, count(distinct nullif(o_orderpriority, '5-LOW')) as d,
                      count(*) - count(nullif(o_orderpriority, '5-LOW')) as e
               from (select * from orders union all select * from orders where o_orderstatus = 'P'))
    select 'o_orderpriority' as column_name, 'kept' as change, 'nvarchar' as data_type_before, 'nvarchar' as data_type_after,
           a.n - b.n as rows_delta, a.e / a.n * 100 as null_percentage_delta, a.d - b.d as distinct_delta from a, b
    union all select 'o_totalprice', 'removed', 'decimal', null, null, null, null from a, b
    union all select 'price_text', 'added', null, 'nvarchar', null, null, null from a, b
    union all select 'o_custkey', 'retyped', 'bigint', 'nvarchar', a.n - b.n, 0.0,
      0 from a, b
    """
)
def profile_diff(t):
    """Profiles before and after a transformation that repeats some rows and changes columns."""
    before = t.orders.select("o_orderpriority", "o_totalprice", "o_custkey")
    after = t.orders.union(t.orders.filter(F.col("o_orderstatus") == "P")).select(
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("o_orderpriority"),
        F.col("o_totalprice").cast("string").alias("price_text"),
        F.col("o_custkey").cast("string").alias("o_custkey"),
    )
    return P.profile_diff(P.profile(before, "before"), P.profile(after, "after"))


_RAW = """(select cast(o_orderkey as varchar) as code, ' ' || cast(o_totalprice as varchar) as price,
    case when o_orderkey % 20 = 0 then 'n/a' else cast(o_custkey as varchar) end as mostly_number,
    case when o_orderkey % 8 = 0 then 'n/a' else cast(o_custkey as varchar) end as too_few_numbers,
    strftime(o_orderdate, '%d/%m/%Y') as day_first, strftime(o_orderdate, '%Y-%m-%d') as iso,
    strftime(date '2020-01-01' + cast(31 * (o_orderkey % 12) + 1 as int), '%m.%d.%Y') as dotted,
    o_orderstatus as status from orders)"""


def _raw(t):
    key, customer = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    dotted = F.date_add(F.lit(datetime.date(2020, 1, 1)), (31 * (key % 12) + 1).cast("int"))
    return t.orders.select(
        key.cast("string").alias("code"),
        F.concat(F.lit(" "), F.col("o_totalprice").cast("string")).alias("price"),
        F.when(key % 20 == 0, "n/a").otherwise(customer).alias("mostly_number"),
        F.when(key % 8 == 0, "n/a").otherwise(customer).alias("too_few_numbers"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("day_first"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"),
        F.date_format(dotted, "MM.dd.yyyy").alias("dotted"),
        F.col("o_orderstatus").alias("status"),
    )


@query(
    f"""
    select column_name, total, numbers, dates, data_type, use_day_first, pattern, ambiguous from (
      select 'code' as column_name, count(*) as total, count(try_cast(code as double)) as numbers, 0 as dates,
             'bigint' as data_type, false as use_day_first, 'unknown' as pattern, true as ambiguous from {_RAW}
      union all select 'price', count(*), count(try_cast(price as double)), 0, 'decimal', false, 'unknown', true from {_RAW}
      union all select 'mostly_number', count(*), count(try_cast(mostly_number as double)), 0, 'decimal', false, 'unknown', true from {_RAW}
      union all select 'too_few_numbers', count(*), count(try_cast(too_few_numbers as double)), 0, 'nvarchar', false, 'unknown', true from {_RAW}
      union all select 'day_first', count(*), 0, count(day_first), 'datetime2', true, 'DD/M/YYYY', false from {_RAW}
      union all select 'iso', count(*), 0, count(iso), 'datetime2', false, 'YYYY-MM-DD', false from {_RAW}
      union all select 'dotted', count(*), 0, count(dotted), 'datetime2', false, 'D.M.YYYY', true from {_RAW}
      union all select 'status', count(*), 0, 0, 'nvarchar', false, 'unknown', true from {_RAW}
    )
    """
)
def infer_types(t):
    return I.infer_types(_raw(t), tasks=32)


@query(
    f"""
    select column_name, pattern, day_first_likely, ambiguous, sample from (
      select 'day_first' as column_name, 'DD/M/YYYY' as pattern, true as day_first_likely, false as ambiguous, min(day_first) as sample from {_RAW}
      union all select 'iso', 'YYYY-MM-DD', false, false, min(iso) from {_RAW}
      union all select 'dotted', 'D.M.YYYY', false, true, min(dotted) from {_RAW}
      union all select 'status', 'unknown', false, true, min(status) from {_RAW}
    )
    """
)
def date_format(t):
    return I.date_formats(_raw(t).select("day_first", "iso", "dotted", "status"))


@query(
    f"""
    select cast(code as bigint) as code, cast(trim(price) as double) as price,
           try_cast(mostly_number as double) as mostly_number, too_few_numbers,
           strptime(day_first, '%d/%m/%Y') as day_first, cast(iso as timestamp) as iso, status from {_RAW}
    """
)
def apply_inferred_types(t):
    raw = _raw(t).drop("dotted")
    typed = I.apply_inferred(raw, I.infer_types(raw, tasks=32))
    return typed.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("day_first", "iso")})


@query(
    """
    select 'o_totalprice' as column_name, unnest([0.25::double, 0.5, 0.75]) as percentile,
           unnest(quantile_disc(o_totalprice, [0.25, 0.5, 0.75])) as value from orders
    union all
    select 'o_custkey', unnest([0.25::double, 0.5, 0.75]),
           unnest(quantile_disc(o_custkey, [0.25, 0.5, 0.75]))::double from orders
    """
)
def percentiles(t):
    return R.percentiles(t.orders, ["o_totalprice", "o_custkey"])



@query(
    """
    with q as (select quantile_disc(v, 0.25) as q1, quantile_disc(v, 0.75) as q3 from (select value * value as v from events))
    select 'squared' as column_name, q1 - 1.5 * (q3 - q1) as low_fence, q3 + 1.5 * (q3 - q1) as high_fence,
           (select count(*) from events where value * value < q1 - 1.5 * (q3 - q1)) as below,
           (select count(*) from events where value * value > q3 + 1.5 * (q3 - q1)) as above
    from q
    """
)
def outliers(t):
    return R.outliers(t.events.select((F.col("value") * F.col("value")).alias("squared")), ["squared"])


@query(
    """
    with moved as (select case when month(o_orderdate) = 3 then o_orderdate::date + interval 1 month else o_orderdate end::date as day from orders)
    select unnest(generate_series(min(day), max(day), interval 1 day))::date as day from moved
    except select day from moved
    """
)
def date_gaps(t):
    """Orders of March are dated a month later, which leaves that month empty."""
    on = F.col("o_orderdate").cast("date")
    return R.date_gaps(t.orders.select(F.when(F.month(on) == 3, F.add_months(on, 1)).otherwise(on).alias("day")), "day")


@query(
    """
    select 'o_orderdate' as column_name, max(o_orderdate)::date as latest,
           (date '2002-01-01' - max(o_orderdate)::date)::int as age_days from orders
    """
)
def recency(t):
    return R.recency(t.orders, ["o_orderdate"], datetime.date(2002, 1, 1))


@query(
    """
    select 'text' as column_name, count(case when regexp_matches(text, '^[0-9]+$') then 1 end) as digits_only,
           count(case when regexp_matches(text, '^[A-Za-z]+$') then 1 end) as letters_only,
           count(case when regexp_matches(text, '^[A-Za-z0-9]+$') then 1 end) as alphanumeric,
           count(case when regexp_matches(text, '[^\\x00-\\x7F]') then 1 end) as non_ascii,
           count(case when regexp_matches(text, '^\\s|\\s$') then 1 end) as outer_space, count(case when text = '' then 1 end) as empty from documents
    union all
    select 'lang', count(case when regexp_matches(lang, '^[0-9]+$') then 1 end), count(case when regexp_matches(lang, '^[A-Za-z]+$') then 1 end),
           count(case when regexp_matches(lang, '^[A-Za-z0-9]+$') then 1 end), count(case when regexp_matches(lang, '[^\\x00-\\x7F]') then 1 end),
           count(case when regexp_matches(lang, '^\\s|\\s$') then 1 end), count(case when lang = '' then 1 end) from documents
    """
)
def character_classes(t):
    return R.character_classes(t.documents, ["text", "lang"])


_LINKS = [
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
]


def _link_sql(child, column, parent, key):
    return f"""
    select '{child}' as child_table, '{column}' as child_column, '{parent}' as parent_table, '{key}' as parent_column,
      count(distinct {column}) as distinct_keys, count(distinct {column}) filter (hit) as matched_keys,
      count(distinct {column}) filter (hit) / count(distinct {column}) * 100 as match_percentage, count(case when not hit then 1 end) as orphan_rows
    from (select {column}, {column} in (select {key} from {parent}) as hit from {child})"""


@query(
    "with customers as (select * replace (case when c_mktsegment = 'BUILDING' then -1 - c_custkey else c_custkey end as c_custkey) from customer) "
    + "\nunion all ".join(_link_sql(*(x.replace("customer", "customers") if x == "customer" and i == 2 else x for i, x in enumerate(link))) for link in _LINKS).replace("'customers'", "'customer'")
)
def relationships(t):
    """Foreign keys found by name and type among key candidates, over whole tables, and how well they hold."""
    names = ("customer", "nation", "orders", "region", "lineitem", "part", "supplier", "events")
    tables = {n: getattr(t, n) for n in names}
    links = R.named_links(tables)
    key = F.col("c_custkey")
    kept = t.customer.withColumn("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", -1 - key).otherwise(key))
    return R.relationships({**tables, "customer": kept}, links, min_match=50.0)


_STATE_COLUMNS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "decimal", "o_orderpriority": "nvarchar"}


def _state_sql(column, kind, source, load):
    number = f"{column}::double" if kind != "nvarchar" else "null::double"
    text = column if kind == "nvarchar" else "null::varchar"
    length = "null::int" if kind == "decimal" else "{}" + f"(length({column}::varchar))::int"
    return f"""
    select '{load}' as profiled, '{column}' as column_name, '{kind}' as data_type, count(*) as total_count, count({column}) as non_null_count,
      min({number}) as min_value, max({number}) as max_value, round(avg({number}), 4) as avg_value, min({text}) as min_text, max({text}) as max_text,
      {length.format("min")} as min_length, {length.format("max")} as max_length, true as distinct_within_bound
    from {source}"""


@query(" union all ".join(
    _state_sql(c, kind, source, load)
    for source, load in (("orders", "all"), ("(select * from orders where o_orderstatus = 'O')", "open"), ("(select * from orders where o_orderstatus <> 'O')", "rest"))
    for c, kind in _STATE_COLUMNS.items()
))
def profile_loads(t):
    """Two loads profiled apart, and as one from their states alone; distinct values are estimated within a bound."""
    path = scratch_path(t.spark, "states")
    is_open = F.col("o_orderstatus") == "O"
    loads = {"open": t.orders.filter(is_open), "rest": t.orders.filter(~is_open)}
    for name, df in loads.items():
        V.add_load(df, "orders", name, path, list(_STATE_COLUMNS))
    states = V.load_states(t.spark, path)
    exact = {name: df.agg(*[F.count_distinct(col(c)).alias(c) for c in _STATE_COLUMNS]).first() for name, df in {**loads, "all": t.orders}.items()}
    out = None
    for name, part in (("all", states), ("open", states.filter("load = 'open'")), ("rest", states.filter("load = 'rest'"))):
        want = F.element_at(F.create_map(*[x for c in _STATE_COLUMNS for x in (F.lit(c), F.lit(exact[name][c]))]), F.col("column_name"))
        # Of numbers with fractions the text's length is each engine's own.
        length = lambda c: F.when(F.col("data_type") != "decimal", F.col(c)).alias(c)
        one = V.merged_profile(part).select(
            F.lit(name).alias("profiled"), "column_name", "data_type", "total_count", "non_null_count", "min_value", "max_value", F.round("avg_value", 4).alias("avg_value"),
            "min_text", "max_text", length("min_length"), length("max_length"),
            (F.abs(F.col("distinct_estimate") - want) <= F.greatest(want * V.DISTINCT_ERROR, F.lit(1))).alias("distinct_within_bound"),
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    """
    select * exclude (place) from (
      select c_nationkey, c_custkey, c_mktsegment, row_number() over (partition by c_nationkey order by md5('sample|' || c_custkey), c_custkey) as place from customer)
    where place <= 7
    """
)
def sample_per_nation(t):
    """Seven customers of each nation, those with the smallest hashes."""
    return P.sample_rows(t.customer.select("c_nationkey", "c_custkey", "c_mktsegment"), 7, "c_nationkey", "c_custkey")


_BUYERS = {
    "orders": ("orders", {"buyer": "o_custkey", "no": "o_orderkey"}), "customer": ("customer", {"id": "c_custkey", "country": "c_nationkey"}),
    "nation": ("nation", {"code": "n_nationkey", "part_of": "n_regionkey"}), "region": ("region", {"number": "r_regionkey"}),
    "line": ("lineitem", {"order_ref": "l_orderkey", "article": "l_partkey"}), "article_list": ("part", {"key": "p_partkey", "width": "p_size"}),
}
_UNIQUE = [("orders", "no"), ("customer", "id"), ("nation", "code"), ("region", "number"), ("article_list", "key")]


def _inclusion_sql():
    held = " union all ".join(f"select '{t}' as t, '{c}' as c, {old}::bigint as v from {table}" for t, (table, columns) in _BUYERS.items() for c, old in columns.items())
    unique = ", ".join(f"('{t}', '{c}')" for t, c in _UNIQUE)
    return f"""
    with held as ({held}), counted as (select t, c, v, count(*) as n from held group by all),
    sizes as (select t, c, count(*) as keys from counted group by all),
    met as (
      select a.t as child_table, a.c as child_column, p.t as parent_table, p.c as parent_column, count(*) as distinct_keys, count(b.v) as matched_keys,
        count(b.v) / count(*) * 100 as match_percentage, coalesce(sum(a.n) filter (b.v is null), 0)::bigint as orphan_rows
      from counted a join (values {unique}) as p(t, c) on p.t <> a.t left join counted b on b.t = p.t and b.c = p.c and b.v = a.v group by all
    )
    select met.*, keys as parent_keys, matched_keys / keys * 100 as coverage_percentage from met join sizes on sizes.t = parent_table and sizes.c = parent_column
    where match_percentage >= 90 and matched_keys / keys * 100 >= 50"""


@query(_inclusion_sql())
def inclusions(t):
    """Foreign keys between columns of unlike names, found by signatures of their values and counted exactly."""
    tables = {name: getattr(t, table).select(*[F.col(old).alias(c) for c, old in columns.items()]) for name, (table, columns) in _BUYERS.items()}
    return R.inclusions(tables, min_match=90.0, min_coverage=50.0)


@query(
    """
    with p as (select 'o_orderstatus' as column_name, count(*) as total_count, count(distinct o_orderstatus) as distinct_count, max(length(o_orderstatus))::bigint as max_length from orders
               union all select 'o_orderkey', count(*), count(distinct o_orderkey), null from orders)
    select 'json' as form, * from p union all select 'csv', * from p
    """
)
def saved_profile(t):
    """A profile written as JSON and as CSV, and read back."""
    found, path = P.profile(t.orders, "orders", ["o_orderstatus", "o_orderkey"]), scratch_path(t.spark, "profile")
    for form in ("json", "csv"):
        P.save_profile(found, f"{path}/{form}", form)
    back = [t.spark.read.json(f"{path}/json").withColumn("form", F.lit("json")), t.spark.read.option("header", True).csv(f"{path}/csv").withColumn("form", F.lit("csv"))]
    shown = ["form", "column_name", *[F.col(c).cast("bigint").alias(c) for c in ("total_count", "distinct_count", "max_length")]]
    return back[0].select(*shown).unionByName(back[1].select(*shown))
