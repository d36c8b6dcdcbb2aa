"""Operators that depend on row order."""

from pyspark.sql import functions as F

from layerkit.operators import ordered as O
from layerkit.plans.base import query


@query(
    """
    select o_orderkey, o_orderdate, 1000 + 5 * (row_number() over (order by o_orderdate, o_orderkey) - 1) as idx
    from orders
    """
)
def index_column(t):
    return O.add_index(t.orders.select("o_orderkey", "o_orderdate"), "idx", ["o_orderdate", "o_orderkey"], 1000, 5)


@query(
    """
    select e.event_id, e.user_id,
           row_number() over (order by user_id desc, ts, event_id) as key_no
    from events e
    """
)
def sequential_key(t):
    df = O.sequential_key(t.events.select("event_id", "user_id", "ts"), "key_no", [("user_id", "desc"), "ts", "event_id"])
    return df.drop("ts")


@query(
    """
    select user_id, event_id, ts, event_type, value from (
      select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events
    ) where r = 1
    """
)
def dedup_latest(t):
    df = t.events.select("user_id", "event_id", "ts", "event_type", "value")
    return O.dedup_latest(df, "user_id", ["ts", "event_id"])


_GAPS = """
    (select user_id, event_id, ts, nullif(event_type, 'error') as kind,
            case when event_type in ('click', 'view') then null else value end as reading from events)
"""


def _gaps(t):
    return t.events.select(
        "user_id", "event_id", "ts",
        F.nullif(F.col("event_type"), F.lit("error")).alias("kind"),
        F.when(F.col("event_type").isin("click", "view"), None).otherwise(F.col("value")).alias("reading"),
    )


@query(
    f"""
    select user_id, event_id, last_value(kind ignore nulls) over w as kind, last_value(reading ignore nulls) over w as reading
    from {_GAPS}
    window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)
    """
)
def fill_down(t):
    return O.fill_down(_gaps(t), ["kind", "reading"], ["ts", "event_id"], "user_id").drop("ts")


@query(
    f"""
    select user_id, event_id, first_value(kind ignore nulls) over w as kind, first_value(reading ignore nulls) over w as reading
    from {_GAPS}
    window w as (partition by user_id order by ts, event_id rows between current row and unbounded following)
    """
)
def fill_up(t):
    return O.fill_up(_gaps(t), ["kind", "reading"], ["ts", "event_id"], "user_id").drop("ts")


@query(
    """
    select o_orderkey, last_value(p ignore nulls) over (
      order by o_totalprice desc, o_orderkey rows between unbounded preceding and current row) as priority
    from (select *, case when o_orderpriority = '1-URGENT' then o_orderpriority end as p from orders)
    """
)
def fill_down_whole_table(t):
    """No groups: one run of rows over the whole table."""
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority"))
    df = t.orders.select("o_orderkey", "o_totalprice", urgent.alias("priority"))
    return O.fill_down(df, "priority", [("o_totalprice", "desc"), "o_orderkey"]).drop("o_totalprice")


_ORDERS = ["o_orderkey", "o_custkey", "o_totalprice"]
_BY_PRICE = [("o_totalprice", "desc"), "o_orderkey"]
_PLACED = """
    (select o_orderkey, o_custkey, o_totalprice,
            row_number() over (order by o_totalprice desc, o_orderkey) as place,
            row_number() over (order by o_totalprice, o_orderkey desc) as back from orders)
"""


@query(f"select o_orderkey, o_custkey, o_totalprice from {_PLACED} where place <= 25")
def first_rows(t):
    return O.first_n(t.orders.select(*_ORDERS), 25, _BY_PRICE)


@query(f"select o_orderkey, o_custkey, o_totalprice from {_PLACED} where back <= 25")
def last_rows(t):
    return O.last_n(t.orders.select(*_ORDERS), 25, _BY_PRICE)


@query(f"select o_orderkey, o_custkey, o_totalprice from {_PLACED} where place > 40")
def skip_rows(t):
    return O.skip(t.orders.select(*_ORDERS), 40, _BY_PRICE)


@query(f"select o_orderkey, o_custkey, o_totalprice from {_PLACED} where back > 40")
def remove_last_rows(t):
    return O.remove_last(t.orders.select(*_ORDERS), 40, _BY_PRICE)


@query(
    """
    select o_orderkey, o_orderstatus, o_totalprice from orders
    order by o_orderstatus desc, o_totalprice, o_orderkey
    """
)
def sort_rows(t):
    return O.sort(
        t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"),
        [("o_orderstatus", "desc"), "o_totalprice", "o_orderkey"],
    )


@query(
    """
    select * from (select 'o_orderpriority' as column_name, o_orderpriority as value, count(*) as count
                   from orders group by 2 order by 3 desc, 2 limit 5)
    union all
    select * from (select 'p_brand', p_brand, count(*) as c from part group by 2 order by 3 desc, 2 limit 5)
    """
)
def top_values(t):
    def top(df, name):
        return O.top_values(df, name).select(F.lit(name).alias("column_name"), "value", "count")

    return top(t.orders, "o_orderpriority").union(top(t.part, "p_brand"))


@query(
    """
    select part, count(*) as rows, count(distinct o_orderkey) as orders from (
      select o_orderkey, case when row_number() over (order by o_orderstatus) <= 100 then 'first' else 'rest' end as part from orders
    ) group by part
    union all select 'both', count(*), count(distinct o_orderkey) from orders
    """
)
def first_and_rest_on_ties(t):
    """The order is one column of three values; what first_n leaves is what skip gives, and both make up the table."""
    orders = t.orders.select("o_orderkey", "o_orderstatus")
    first = O.first_n(orders, 100, "o_orderstatus").withColumn("part", F.lit("first"))
    both = first.union(O.skip(orders, 100, "o_orderstatus").withColumn("part", F.lit("rest")))
    counts = [F.count(F.lit(1)).alias("rows"), F.count_distinct("o_orderkey").alias("orders")]
    return both.groupBy("part").agg(*counts).union(both.agg(*counts).select(F.lit("both"), "rows", "orders"))


@query("select o_orderkey::varchar as orderkey, o_orderstatus as status from orders")
def header_promoted(t):
    """The header is the first line of a table of texts."""
    orders = t.orders.select(F.col("o_orderkey").alias("n"), F.col("o_orderkey").cast("string").alias("a"), F.col("o_orderstatus").alias("b"))
    header = t.spark.range(1).select(F.lit(-1).cast("bigint").alias("n"), F.lit("orderkey").alias("a"), F.lit("status").alias("b"))
    return O.promote_headers(orders.union(header), "n").select("orderkey", "status")
