"""Filters, projections, joins, grouping, reshaping and set operators."""

from pyspark.sql import functions as F

from layerkit.functions import predicates as P
from layerkit.functions.columns import col
from layerkit.operators import aggregate as A, joins as J, ordered as O, project as X, sets as S
from layerkit.operators.recipe import run_recipe
from layerkit.plans.base import exact_sum, query
from layerkit.session import stage


@query(
    """
    select n_name as nation,
           case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'high'
                when o_orderpriority = '3-MEDIUM' then 'medium' else 'low' end as band,
           cast(sum(cast(o_totalprice as decimal(18,2))) as double) as revenue,
           count(*) as orders
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
    where o_orderstatus <> 'P'
    group by 1, 2 order by 1, 2
    """
)
def nation_priority_revenue(t):
    """Revenue and order count by nation and priority band."""
    priority = F.col("o_orderpriority")
    orders = X.select_rows(t.orders, F.col("o_orderstatus") != "P")
    orders = X.add_column(
        orders,
        "band",
        X.case([(priority.isin("1-URGENT", "2-HIGH"), "high"), (priority == "3-MEDIUM", "medium")], "low"),
    )
    placed = J.merge_queries(orders, t.customer, "o_custkey", "c_custkey", "inner", {"c_nationkey": "nationkey"})
    named = J.merge_queries(placed, t.nation, "nationkey", "n_nationkey", "inner", {"n_name": "nation"})
    totals = A.group(
        named, ["nation", "band"], {"revenue": exact_sum(F.col("o_totalprice")), "orders": ("rows",)}
    )
    return O.sort(totals, ["nation", "band"])


@query(
    """
    select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority
    from orders
    where o_totalprice > 100000 and o_totalprice <= 400000 and o_orderstatus <> 'P'
      and nullif(o_orderpriority, '5-LOW') is not null
      and (o_orderpriority like '%HIGH%' or starts_with(o_orderpriority, '1-') or ends_with(o_orderpriority, 'IUM'))
      and not (o_orderkey < 100)
    """
)
def filter_predicates(t):
    priority = F.col("o_orderpriority")
    return X.select_rows(
        t.orders,
        P.all_of(
            P.compare(F.col("o_totalprice"), ">", 100000),
            P.compare(F.col("o_totalprice"), "<=", 400000),
            P.compare(F.col("o_orderstatus"), "<>", "P"),
            P.compare(F.nullif(priority, F.lit("5-LOW")), "<>", None),
            P.any_of(P.contains(priority, "HIGH"), P.starts_with(priority, "1-"), P.ends_with(priority, "IUM")),
            P.negate(P.compare(F.col("o_orderkey"), "<", 100)),
        ),
    ).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query(
    """
    select p_partkey, p_name, p_brand, p_size from part
    where p_brand in ('Brand#1', 'Brand#7', 'Brand#12') and p_size between 5 and 30
      and not regexp_matches(p_name, '(?i)^RED')
    """
)
def filter_sets_and_patterns(t):
    """Membership, range and pattern conditions."""
    return X.select_rows(
        t.part,
        P.one_of(F.col("p_brand"), ["Brand#1", "Brand#7", "Brand#12"])
        & P.in_range(F.col("p_size"), 5, 30)
        & ~P.matches(F.col("p_name"), "(?i)^RED"),
    ).select("p_partkey", "p_name", "p_brand", "p_size")


@query(
    """
    select case when o_totalprice < 100000 then 'small' when o_totalprice < 250000 then 'medium'
                when o_totalprice < 400000 then 'large' end as band,
           count(*) as orders, min(o_totalprice) as low, max(o_totalprice) as high
    from orders group by 1
    """
)
def conditional_band(t):
    price = F.col("o_totalprice")
    banded = X.add_column(
        t.orders, "band", X.case([(price < 100000, "small"), (price < 250000, "medium"), (price < 400000, "large")])
    )
    return A.group(banded, "band", {"orders": ("rows",), "low": ("min", "o_totalprice"), "high": ("max", "o_totalprice")})


@query(
    """
    select cast(p_partkey as varchar) as "Part ID", p_name as "Part Name",
           try_cast(p_name as bigint) as "As Number", cast(p_size as bigint) as p_size,
           cast(p_retailprice as decimal(19,4)) as price, p_name as "Part Name_copy", p_brand as label
    from part
    """
)
def rename_select_cast(t):
    df = X.rename(t.part, {"p_partkey": "Part ID", "p_name": "Part Name", "p_retailprice": "price"})
    df = X.duplicate_column(df, "Part Name", "As Number")
    df = X.duplicate_column(df, "Part Name")
    df = X.duplicate_column(df, "p_brand", "label")
    df = X.remove_columns(df, ["p_type", "p_brand"], strict=True)
    df = X.cast_types(df, {"Part ID": "type text", "p_size": "Int64.Type", "price": "Currency.Type"})
    df = X.cast_types(df, {"As Number": "Int64.Type"}, on_error="null")
    return X.select_columns(
        df, ["Part ID", "Part Name", "As Number", "p_size", "price", "Part Name_copy", "label"]
    )


@query(
    """
    select p_partkey, upper(p_name) as p_name, round(p_retailprice / 10) as p_retailprice,
           lower(trim(p_type)) as p_type
    from part
    """
)
def transform_columns(t):
    df = X.transform_columns(
        t.part, {"p_name": F.upper, "p_retailprice": lambda c: F.round(c / 10), "p_type": lambda c: F.lower(F.trim(c))}
    )
    return X.select_columns(df, ["p_partkey", "p_name", "p_retailprice", "p_type"])


@query(
    """
    select o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), 'none') as filled,
           replace(o_orderpriority, '-', '.') as dotted,
           replace(replace(o_orderpriority, '-', '.'), '.', '::') as literal_dot,
           case when o_orderpriority = '1-URGENT' then 'now' else o_orderpriority end as whole,
           case o_orderstatus when 'O' then 'Open' when 'F' then 'Finished' else o_orderstatus end as status,
           case o_orderstatus when 'O' then 'Open' else 'Unknown' end as status_or_unknown,
           coalesce(nullif(o_totalprice, o_totalprice), 0) as zeroed
    from orders
    """
)
def replace_and_map_values(t):
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    df = t.orders.select(
        "o_orderkey",
        F.nullif(priority, F.lit("5-LOW")).alias("filled"),
        priority.alias("dotted"),
        priority.alias("literal_dot"),
        priority.alias("whole"),
        status.alias("status"),
        status.alias("status_or_unknown"),
        F.nullif(F.col("o_totalprice"), F.col("o_totalprice")).alias("zeroed"),
    )
    df = X.replace_value(df, None, "none", "filled")
    df = X.replace_value(df, "-", ".", ["dotted", "literal_dot"], "text")
    df = X.replace_value(df, ".", "::", "literal_dot", "text")
    df = X.replace_value(df, "1-URGENT", "now", "whole")
    df = X.map_values(df, "status", {"O": "Open", "F": "Finished"})
    df = X.map_values(df, "status_or_unknown", {"O": "Open"}, default="Unknown")
    return X.fill_nulls(df, {"zeroed": 0.0})


@query(
    """
    select n_nationkey as nation_key, n_name as nation_name, n_regionkey as region_id, length(n_name) as namelen
    from nation
    """
)
def snake_case_columns(t):
    df = t.nation.select(
        F.col("n_nationkey").alias("NationKey"),
        F.col("n_name").alias("Nation  Name"),
        F.col("n_regionkey").alias("Region ID"),
        F.length("n_name").cast("bigint").alias("name-len%"),
    )
    return X.snake_case(df)


@query(
    """
    select c_custkey as customer_key, c_acctbal as acct_bal_dollar, c_acctbal / 2 as _2nd_pct_share,
           c_mktsegment from customer
    """
)
def safe_column_names(t):
    """Database-safe names for columns whose names hold spaces, symbols and leading digits."""
    return X.safe_names(
        t.customer.select(
            F.col("c_custkey").alias("Customer Key"),
            F.col("c_acctbal").alias("Acct. Bal ($)"),
            (F.col("c_acctbal") / 2).alias("2nd % share"),
            "c_mktsegment",
        )
    )


@query(
    """
    select c_custkey, upper(left(trim(c_name), 1)) || lower(substr(trim(c_name), 2)) as c_name,
           lower(trim(c_mktsegment)) as c_mktsegment, cast(c_acctbal as decimal(18,2)) as c_acctbal
    from customer where nullif(c_custkey, 0) is not null
    """
)
def tidy_customers(t):
    """Title-case names, lower-case texts, decimal money, no null keys."""
    df = t.customer.select(F.nullif("c_custkey", F.lit(0)).alias("c_custkey"), "c_name", "c_mktsegment", "c_acctbal")
    return X.tidy(df, names=["c_name"], emails=["c_mktsegment"], money=["c_acctbal"], keys=["c_custkey"])


@query(
    """
    select o_orderpriority, count(*) as orders, (select count(*) from orders) as all_orders,
           (select max(o_totalprice) from orders) - max(o_totalprice) as below_top
    from orders group by 1
    """
)
def buffered_orders(t):
    """A table kept in memory and on disk while it is used twice."""
    kept = X.buffer(t.orders.select("o_orderpriority", "o_totalprice"))
    whole = kept.agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top")).first()
    by_priority = kept.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), (F.lit(whole.top) - F.max("o_totalprice")).alias("below_top"))
    out = stage(by_priority.withColumn("all_orders", F.lit(whole.n).cast("bigint")), "buffered")
    kept.unpersist()
    return out


# All rows take part. Customers of one segment have a shifted key, which leaves
# their orders unmatched; so have cheap orders, which leaves customers unmatched.
_KEPT = "(select * replace (case when c_mktsegment = 'BUILDING' then -1 - c_custkey else c_custkey end as c_custkey) from customer)"
_SOME = "(select * replace (case when o_totalprice > 300000 then o_custkey else 1000000000 + o_custkey end as o_custkey) from orders)"


def _sides(t):
    building, dear = F.col("c_mktsegment") == "BUILDING", F.col("o_totalprice") > 300000
    customers = t.customer.withColumn("c_custkey", F.when(building, -1 - F.col("c_custkey")).otherwise(F.col("c_custkey")))
    orders = t.orders.withColumn("o_custkey", F.when(dear, F.col("o_custkey")).otherwise(1000000000 + F.col("o_custkey")))
    return orders.select("o_orderkey", "o_custkey", "o_totalprice"), customers.select("c_custkey", "c_name", "c_mktsegment")


def _register_joins():
    columns = "o_orderkey, o_custkey, o_totalprice, c_custkey, c_name, c_mktsegment"
    for name, kind, word in [
        ("join_left", "JoinKind.LeftOuter", "left"),
        ("join_inner", "JoinKind.Inner", "inner"),
        ("join_right", "JoinKind.RightOuter", "right"),
        ("join_full", "JoinKind.FullOuter", "full"),
    ]:
        sql = f"select {columns} from {_SOME} o {word} join {_KEPT} c on o_custkey = c_custkey"

        def run(t, kind=kind):
            orders, customers = _sides(t)
            return J.join_on(orders, customers, "o_custkey", "c_custkey", kind)

        query(sql, name)(run)

    @query(f"select o_orderkey, o_custkey, o_totalprice from {_SOME} where o_custkey not in (select c_custkey from {_KEPT})")
    def join_left_anti(t):
        orders, customers = _sides(t)
        return J.join_on(orders, customers, "o_custkey", "c_custkey", "JoinKind.LeftAnti")

    @query(f"select c_custkey, c_name, c_mktsegment from {_KEPT} where c_custkey not in (select o_custkey from {_SOME})")
    def join_right_anti(t):
        orders, customers = _sides(t)
        return J.join_on(orders, customers, "o_custkey", "c_custkey", "JoinKind.RightAnti")

    @query(f"select {columns} from {_SOME} o left join {_KEPT} c on o_custkey = c_custkey")
    def join_salted(t):
        """Left join with every key of the left side spread over eight tasks."""
        orders, customers = _sides(t)
        return J.join_on(orders, customers, "o_custkey", "c_custkey", "left", salt=8)


_register_joins()


@query(
    """
    select l.l_orderkey as orderkey, l.l_suppkey as suppkey, l.n, o.price
    from (select l_orderkey, l_suppkey, count(*) as n from lineitem group by all) l
    left join (select o_orderkey, o_orderkey % 100 as s, o_totalprice as price from orders) o
      on l.l_orderkey = o.o_orderkey and l.l_suppkey = o.s
    """
)
def join_two_keys(t):
    """Two key columns with differing names, one of them text on one side."""
    lines = A.group(t.lineitem, ["l_orderkey", "l_suppkey"], {"n": ("rows",)}).withColumnsRenamed(
        {"l_orderkey": "orderkey", "l_suppkey": "suppkey"}
    )
    orders = t.orders.select(
        F.col("o_orderkey").cast("string").alias("ok"),
        (F.col("o_orderkey") % 100).cast("string").alias("s"),
        F.col("o_totalprice").alias("price"),
    )
    joined = J.join_on(lines, orders, ["orderkey", "suppkey"], ["ok", "s"], "left", key_type="bigint")
    return X.remove_columns(joined, ["ok", "s"])


# All lines take part; those not returned have a shifted key, so no order finds them.
_RETURNED = "(select * replace (case when l_returnflag = 'R' then l_orderkey else -1 - l_orderkey end as l_orderkey) from lineitem)"


def _returned(t):
    key = F.col("l_orderkey")
    return t.lineitem.withColumn("l_orderkey", F.when(F.col("l_returnflag") == "R", key).otherwise(-1 - key))


@query(
    f"""
    select o_orderkey, o_totalprice, l_partkey as "Part", l_quantity as "Quantity"
    from orders left join {_RETURNED} on o_orderkey = l_orderkey
    """
)
def nested_join_expand(t):
    orders = X.select_columns(t.orders, ["o_orderkey", "o_totalprice"])
    return J.merge_queries(
        orders, _returned(t), "o_orderkey", "l_orderkey", "left", {"l_partkey": "Part", "l_quantity": "Quantity"}
    )


@query(
    f"""
    select o_orderkey, o_custkey, n_lines, quantity
    from orders left join (
      select l_orderkey, count(*) as n_lines, sum(l_quantity) as quantity
      from {_RETURNED} group by 1
    ) on o_orderkey = l_orderkey
    """
)
def nested_join_totals(t):
    """Size and sum of each order's nested lines, aggregated before the join."""
    orders = X.select_columns(t.orders, ["o_orderkey", "o_custkey"])
    return J.merge_queries(
        orders, _returned(t), "o_orderkey", "l_orderkey", "left",
        aggregate={"n_lines": F.count(F.lit(1)), "quantity": F.sum("l_quantity")},
    )


@query(
    """
    select p_partkey, 'size' as measure, cast(p_size as double) as amount from part where p_size > 10
    union all select p_partkey, 'price', p_retailprice from part where p_size > 10
    union all select p_partkey, null, null from part where not (p_size > 10)
    """
)
def expand_nested_column(t):
    """Expand a nested column; rows with nothing nested are kept."""
    nested = F.array(
        F.struct(F.lit("size").alias("Name"), F.col("p_size").cast("double").alias("Value")),
        F.struct(F.lit("price").alias("Name"), F.col("p_retailprice").alias("Value")),
    )
    df = t.part.select("p_partkey", F.when(F.col("p_size") > 10, nested).alias("Measures"))
    return J.expand(df, "Measures", {"Name": "measure", "Value": "amount"})


@query(
    """
    select s_nationkey as nationkey, s_suppkey, s_name, n_name from supplier left join nation on s_nationkey = n_nationkey
    """
)
def enrichment_join(t):
    suppliers = t.supplier.select(F.col("s_nationkey").alias("nationkey"), "s_suppkey", "s_name")
    return J.enrich(suppliers, t.nation.select(F.col("n_nationkey").alias("nationkey"), "n_name"), "nationkey")


@query(
    """
    select c_mktsegment as segment, p_brand as brand, n_name as supplier_nation, count(*) as lines,
           sum(l_quantity) as quantity
    from lineitem
    left join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey
    left join part on l_partkey = p_partkey left join supplier on l_suppkey = s_suppkey
    left join nation on s_nationkey = n_nationkey
    group by all
    """
)
def dimension_lookup(t):
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    df = J.lookup_dimensions(
        lines,
        [
            (t.orders, "l_orderkey", "o_orderkey", {"o_custkey": "custkey"}),
            (t.customer, "custkey", "c_custkey", {"c_mktsegment": "segment"}),
            (t.part, "l_partkey", "p_partkey", {"p_brand": "brand"}),
            (t.supplier, "l_suppkey", "s_suppkey", {"s_nationkey": "nationkey"}),
            (t.nation, "nationkey", "n_nationkey", {"n_name": "supplier_nation"}),
        ],
    )
    return A.group(
        df, ["segment", "brand", "supplier_nation"], {"lines": ("rows",), "quantity": ("sum", "l_quantity")}
    )


@query(
    """
    select l_returnflag, l_linestatus, sum(l_quantity) as quantity,
           sum(l_quantity) / count(l_quantity) as avg_quantity,
           min(l_shipdate) as first_ship, max(l_extendedprice) as top_price,
           count(nullif(l_discount, 0.05)) as discounts, count(*) as lines,
           count(distinct l_suppkey) as suppliers,
           arg_min(l_orderkey, (l_shipdate, l_orderkey)) as first_order,
           arg_max(l_orderkey, (l_shipdate, l_orderkey)) as last_order
    from lineitem group by 1, 2
    """
)
def group_all_aggregates(t):
    df = X.add_column(t.lineitem, "discount_or_null", F.nullif(F.col("l_discount"), F.lit(0.05)))
    order = ["l_shipdate", "l_orderkey"]
    return A.group(
        df,
        ["l_returnflag", "l_linestatus"],
        {
            "quantity": ("List.Sum", "l_quantity"),
            "avg_quantity": ("List.Average", "l_quantity"),
            "first_ship": ("List.Min", "l_shipdate"),
            "top_price": ("List.Max", "l_extendedprice"),
            "discounts": ("List.Count", "discount_or_null"),
            "lines": ("Table.RowCount",),
            "suppliers": ("List.Distinct", "l_suppkey"),
            "first_order": ("List.First", "l_orderkey", order),
            "last_order": ("List.Last", "l_orderkey", order),
        },
    )


@query("select event_type, count(*) as count from events group by 1")
def group_row_count(t):
    return A.group(t.events, "event_type")


@query("select cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total, count(*) as orders, max(o_orderdate) as latest from orders")
def whole_table_aggregate(t):
    return A.group(
        t.orders,
        (),
        {"total": exact_sum(F.col("o_totalprice")), "orders": ("rows",), "latest": ("max", "o_orderdate")},
    )


@query(
    """
    select l_returnflag, l_shipmonth, sum(l_quantity) filter (l_linestatus = 'O') as "O",
           sum(l_quantity) filter (l_linestatus = 'F') as "F"
    from (select *, month(l_shipdate)::int as l_shipmonth from lineitem) group by 1, 2
    """
)
def pivot_static(t):
    df = t.lineitem.select("l_returnflag", F.month("l_shipdate").alias("l_shipmonth"), "l_linestatus", "l_quantity")
    return A.pivot(df, "l_linestatus", "l_quantity", ["O", "F"], how="List.Sum")


@query(
    """
    select o_custkey,
      arg_min(o_totalprice, (o_orderdate, o_orderkey)) filter (o_orderpriority = '1-URGENT') as "1-URGENT",
      arg_min(o_totalprice, (o_orderdate, o_orderkey)) filter (o_orderpriority = '2-HIGH') as "2-HIGH",
      arg_min(o_totalprice, (o_orderdate, o_orderkey)) filter (o_orderpriority = '3-MEDIUM') as "3-MEDIUM",
      arg_min(o_totalprice, (o_orderdate, o_orderkey)) filter (o_orderpriority = '4-NOT SPECIFIED') as "4-NOT SPECIFIED",
      arg_min(o_totalprice, (o_orderdate, o_orderkey)) filter (o_orderpriority = '5-LOW') as "5-LOW"
    from orders group by 1
    """
)
def pivot_dynamic(t):
    """Values found by the query; each cell holds its first value in time."""
    return A.pivot(
        t.orders, "o_orderpriority", "o_totalprice", keys=["o_custkey"], how="first",
        order_by=["o_orderdate", "o_orderkey"],
    )


_UNPIVOT_SQL = """
    select p_partkey, p_brand, 'p_size' as measure, cast(p_size as double) as amount from part
    union all select p_partkey, p_brand, 'p_retailprice', p_retailprice from part
"""


@query(_UNPIVOT_SQL)
def unpivot_named(t):
    df = X.select_columns(t.part, ["p_partkey", "p_brand", "p_size", "p_retailprice"])
    df = X.cast_types(df, {"p_size": "type number"})
    return A.unpivot(df, ["p_size", "p_retailprice"], "measure", "amount")


@query(
    """
    select l_orderkey, l_linenumber, l_partkey, attribute, amount from (
      select l_orderkey, l_linenumber, l_partkey, 'l_discount' as attribute, nullif(l_discount, 0.05) as amount from lineitem
      union all select l_orderkey, l_linenumber, l_partkey, 'l_tax', l_tax from lineitem
    ) where amount is not null
    """
)
def unpivot_other(t):
    """All columns but the keys, with empty cells dropped."""
    df = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.nullif(F.col("l_discount"), F.lit(0.05)).alias("l_discount"), "l_tax"
    )
    return A.unpivot_other(df, ["l_orderkey", "l_linenumber", "l_partkey"], "attribute", "amount", drop_nulls=True)


@query(
    """
    select nationkey, name, balance, segment from (
      select distinct c_nationkey as nationkey, c_name as name, c_acctbal as balance, c_mktsegment as segment from customer
      union all select distinct s_nationkey, s_name, s_acctbal, null from supplier
    )
    """
)
def distinct_and_combine(t):
    """Stack two tables of which one lacks a column."""
    customers = t.customer.select(
        F.col("c_nationkey").alias("nationkey"), F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"),
    )
    suppliers = t.supplier.select(
        F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("balance")
    )
    return S.combine([S.distinct(customers), S.distinct(suppliers)])


@query(
    """
    select l_returnflag, l_linestatus, l_suppkey, true as is_a_row from lineitem group by all
    """
)
def distinct_by_keys(t):
    """One whole row per key, whichever it is; that it is one row of the table is checked against the table."""
    keys = ["l_returnflag", "l_linestatus", "l_suppkey"]
    lines = t.lineitem.select(*keys, "l_orderkey", "l_linenumber", "l_extendedprice")
    one = S.distinct_by(lines, keys)
    there = lines.distinct().withColumn("is_a_row", F.lit(True))
    return one.join(there, one.columns, "left").select(*keys, F.coalesce("is_a_row", F.lit(False)).alias("is_a_row"))


@query(
    """
    select o_orderkey, case o_orderpriority when '5-LOW' then 'none' when '1-URGENT' then 'urgent' else o_orderpriority end as priority,
           coalesce(s_name, 'nobody') as customer
    from orders left join supplier on o_custkey = s_suppkey
    """
)
def mapped_by_table(t):
    """Values mapped by a table: a null is a key like any other, and a long mapping is a join."""
    orders = t.orders.select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"), F.col("o_custkey").cast("string").alias("customer"))
    pairs = t.orders.select(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("old")).where("old is null or old = '1-URGENT'").distinct()
    short = pairs.select("old", F.when(F.col("old").isNull(), "none").otherwise("urgent").alias("new"))
    long = t.supplier.select(F.col("s_suppkey").cast("string").alias("old"), F.col("s_name").alias("new"))
    return X.map_values(X.map_values(orders, "priority", short), "customer", long, default="nobody")


_COUNTED = [
    "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels",
    "lineitem", "nation", "orders", "pages", "part", "region", "supplier",
]


@query("\nunion all ".join(f"select '{n}' as table_name, count(*) as row_count from {n}" for n in _COUNTED))
def row_count_report(t):
    return S.row_counts({name: getattr(t, name) for name in _COUNTED})


@query(
    """
    select segment, year, count(*) as orders, cast(sum(cast(price as decimal(18,2))) as double) as total
    from (select c_mktsegment as segment, cast(year(o_orderdate) as int) as year, o_totalprice as price
          from orders join customer on o_custkey = c_custkey
          where o_orderstatus = 'F')
    group by 1, 2
    """
)
def recipe_orders(t):
    """A table program given as a list of steps."""
    return run_recipe(
        t.orders,
        [
            ("filter", {"condition": F.col("o_orderstatus") == "F"}),
            ("join", {"right": t.customer, "left_keys": "o_custkey", "right_keys": "c_custkey", "kind": "inner",
                      "expand": {"c_mktsegment": "segment"}}),
            ("add_column", {"name": "year", "value": F.year("o_orderdate"), "type": "Int32.Type"}),
            ("rename", {"pairs": {"o_totalprice": "price"}}),
            ("select_columns", {"names": ["segment", "year", "price"]}),
            ("group_by", {"keys": ["segment", "year"],
                          "aggregates": {"orders": ("rows",), "total": exact_sum(col("price"))}}),
        ],
    )
