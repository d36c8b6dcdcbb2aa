"""Text, date, number and key functions."""

from pyspark.sql import functions as F

from layerkit.functions import dates as D, numbers as N, text as T
from layerkit.operators import aggregate as A
from layerkit.plans.base import exact_sum, query


@query(
    """
    select c_custkey, upper(c_name) as upper, lower(c_name) as lower, trim('  ' || c_name || ' ') as trimmed,
           ltrim('  ' || c_name || ' ') as ltrimmed, rtrim('  ' || c_name || ' ') as rtrimmed,
           cast(length(c_name) as int) as len, left(c_name, 4) as head, right(c_name, 3) as tail,
           contains(c_name, '12') as has_12, starts_with(c_name, 'Cust') as starts, ends_with(c_name, '7') as ends_7,
           replace(c_name, '#0', '.*') as replaced, concat_ws(', ', c_name, c_mktsegment) as combined,
           c_name || '/' || c_mktsegment as joined,
           c_name || nullif(c_mktsegment, 'BUILDING') as null_joined,
           concat_ws('-', c_name, nullif(c_mktsegment, 'BUILDING')) as null_combined,
           string_split(c_name, '#')[2] as second_part, cast(len(string_split(c_name, '0')) as int) as parts,
           lpad(cast(c_custkey as varchar), greatest(3, length(cast(c_custkey as varchar)))::int, '*') as padded,
           rpad(cast(c_custkey as varchar), greatest(3, length(cast(c_custkey as varchar)))::int, '*') as rpadded,
           reverse(c_name) as reversed, cast(c_custkey as varchar) as as_text,
           upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) as proper
    from customer
    """
)
def text_functions(t):
    name, segment, key = F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey")
    spaced = T.concat(F.lit("  "), name, F.lit(" "))
    no_building = F.nullif(segment, F.lit("BUILDING"))
    return t.customer.select(
        "c_custkey",
        T.upper(name).alias("upper"),
        T.lower(name).alias("lower"),
        T.trim(spaced).alias("trimmed"),
        T.trim_start(spaced).alias("ltrimmed"),
        T.trim_end(spaced).alias("rtrimmed"),
        T.length(name).alias("len"),
        T.start(name, 4).alias("head"),
        T.end(name, 3).alias("tail"),
        name.contains("12").alias("has_12"),
        name.startswith("Cust").alias("starts"),
        name.endswith("7").alias("ends_7"),
        T.replace(name, "#0", ".*").alias("replaced"),
        T.combine([name, segment], ", ").alias("combined"),
        T.concat(name, F.lit("/"), segment).alias("joined"),
        T.concat(name, no_building).alias("null_joined"),
        T.combine([name, no_building], "-").alias("null_combined"),
        T.split(name, "#").getItem(1).alias("second_part"),
        F.size(T.split(name, "0")).alias("parts"),
        T.pad_start(T.to_text(key), 3, "*").alias("padded"),
        T.pad_end(T.to_text(key), 3, "*").alias("rpadded"),
        T.reverse(name).alias("reversed"),
        T.to_text(key).alias("as_text"),
        T.proper(segment).alias("proper"),
    )


@query(
    """
    with named as (select p_partkey, p_name || '_' || p_type || '_' || cast(2000 + p_size as varchar) as n from part)
    select p_partkey, string_split(n, '_')[1] as before_first,
           regexp_extract(n, '^(.*)_[^_]*$', 1) as before_last,
           regexp_extract(n, '^[^_]*_(.*)$', 1) as after_first,
           n as before_absent, '' as after_absent,
           regexp_extract(n, '^(.+)_(\\d+)$', 1) as metric, regexp_extract(n, '^(.+)_(\\d+)$', 2) as year
    from named
    """
)
def delimiter_functions(t):
    n = T.concat(F.col("p_name"), F.lit("_"), F.col("p_type"), F.lit("_"), T.to_text(F.col("p_size") + 2000))
    metric, year = T.split_on_last(n, "_")
    return t.part.select(
        "p_partkey",
        T.before_delimiter(n, "_").alias("before_first"),
        T.before_delimiter(n, "_", from_end=True).alias("before_last"),
        T.after_delimiter(n, "_").alias("after_first"),
        T.before_delimiter(n, "|", from_end=True).alias("before_absent"),
        T.after_delimiter(n, "|").alias("after_absent"),
        metric.alias("metric"),
        year.alias("year"),
    )


@query(
    """
    select o_orderkey, cast(year(o_orderdate) as int) as y, cast(month(o_orderdate) as int) as m,
           cast(day(o_orderdate) as int) as d, cast(dayofweek(o_orderdate) + 1 as int) as dow,
           cast(isodow(o_orderdate) - 1 as int) as monday_zero, cast(dayofyear(o_orderdate) as int) as doy,
           cast(o_orderdate as date) as as_date, cast(o_orderdate as date) + 45 as plus_days,
           cast(cast(o_orderdate as date) + interval 2 month as date) as plus_months,
           cast(cast(o_orderdate as date) + interval 36 month as date) as plus_years,
           cast(o_orderdate as date) as parsed,
           case when day(o_orderdate) <= 12 then make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) end
             as misread
    from orders
    """
)
def date_functions(t):
    at = F.col("o_orderdate")
    on = D.to_date(at)
    text = F.date_format(at, "dd/MM/yyyy")
    return t.orders.select(
        "o_orderkey",
        D.year(at).alias("y"),
        D.month(at).alias("m"),
        D.day(at).alias("d"),
        D.day_of_week(at).alias("dow"),
        D.day_of_week(at, first_day=1, zero_based=True).alias("monday_zero"),
        D.day_of_year(at).alias("doy"),
        on.alias("as_date"),
        D.add_days(on, 45).alias("plus_days"),
        D.add_months(on, 2).alias("plus_months"),
        D.add_years(on, 3).alias("plus_years"),
        D.to_date(text, "dd/MM/yyyy").alias("parsed"),
        D.to_date(text, "MM/dd/yyyy", on_error="null").alias("misread"),
    )


@query(
    """
    select event_id, ts as plain, date_trunc('second', ts) as formatted,
           case when event_id % 9 <> 0 then date_trunc('second', ts) end as readable, date_trunc('day', ts)::timestamp as from_date
    from events
    """
)
def timestamp_functions(t):
    """Instants read from texts: by the usual form, by a layout, with unreadable ones as null, and from dates."""
    at, key = F.col("ts"), F.col("event_id")
    text = F.date_format(at, "dd.MM.yyyy HH:mm:ss")
    odd = F.when(key % 9 == 0, F.concat(F.lit("about "), text)).otherwise(text)
    read = {
        "plain": D.to_datetime(at.cast("string")), "formatted": D.to_datetime(text, "dd.MM.yyyy HH:mm:ss"),
        "readable": D.to_datetime(odd, "dd.MM.yyyy HH:mm:ss", on_error="null"), "from_date": D.to_datetime(D.to_date(at).cast("string"), on_error="null"),
    }
    return t.events.select("event_id", *[c.cast("timestamp_ntz").alias(n) for n, c in read.items()])


@query(
    """
    select l_orderkey, l_linenumber, l_partkey, l_quantity, round(l_quantity / 2) as half_up,
           round_even(l_quantity / 2, 0) as half_even, cast(floor(l_quantity / 4) as bigint) as down,
           cast(ceil(l_quantity / 4) as bigint) as up, abs(25 - l_quantity) as gap,
           cast(cast(l_quantity as varchar) as double) as from_text, try_cast(l_returnflag as double) as not_number,
           cast(l_quantity as bigint) as whole, l_linenumber % 2 = 0 as even, l_linenumber % 2 <> 0 as odd,
           l_quantity + l_linenumber as added, l_quantity - l_linenumber as taken, l_quantity * l_linenumber as times,
           l_quantity / l_linenumber as ratio,
           case when l_discount <> 0 then l_quantity / l_discount end as safe_ratio,
           coalesce(nullif(l_tax, 0), nullif(l_discount, 0), -1) as first_present,
           'x' as text_literal, 7 as number_literal, cast(null as varchar) as null_literal
    from lineitem
    """
)
def number_functions(t):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    zero = F.lit(0.0)
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
        N.round_to(q / 2).alias("half_up"),
        N.round_to(q / 2, mode="half_even").alias("half_even"),
        N.round_down(q / 4).alias("down"),
        N.round_up(q / 4).alias("up"),
        N.absolute(25 - q).alias("gap"),
        N.to_number(q.cast("string")).alias("from_text"),
        N.to_number(F.col("l_returnflag"), on_error="null").alias("not_number"),
        N.to_int64(q).alias("whole"),
        N.is_even(n).alias("even"),
        N.is_odd(n).alias("odd"),
        (q + n).alias("added"),
        (q - n).alias("taken"),
        (q * n).alias("times"),
        (q / n).alias("ratio"),
        N.divide(q, F.col("l_discount")).alias("safe_ratio"),
        N.first_present(F.nullif(F.col("l_tax"), zero), F.nullif(F.col("l_discount"), zero), F.lit(-1.0)).alias(
            "first_present"
        ),
        F.lit("x").alias("text_literal"),
        F.lit(7).alias("number_literal"),
        F.lit(None).cast("string").alias("null_literal"),
    )


@query(
    """
    select c_custkey, sha256(cast(c_custkey as varchar)) as customer_key,
           sha256(concat_ws('||', c_name, coalesce(nullif(c_mktsegment, 'BUILDING'), chr(0)))) as pair_key
    from customer
    """
)
def key_hash(t):
    return t.customer.select(
        "c_custkey",
        N.key_hash(F.col("c_custkey")).alias("customer_key"),
        N.key_hash(F.col("c_name"), F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))).alias("pair_key"),
    )


@query(
    """
    select cast(l_shipdate as date) as ship_day, count(*) as lines,
           cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as price
    from lineitem where cast(l_shipdate as date) >= date '1996-01-01' and cast(l_shipdate as date) < date '1999-01-01'
    group by 1
    """
)
def daily_totals(t):
    """A date condition on the raw column, so that it reaches the scan."""
    kept = t.lineitem.filter(
        (F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
        & (F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    )
    return A.group(
        kept.withColumn("ship_day", D.to_date(F.col("l_shipdate"))),
        "ship_day",
        {"lines": ("rows",), "price": exact_sum(F.col("l_extendedprice"))},
    )
