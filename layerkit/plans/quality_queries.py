"""Data-quality checks."""

import datetime

from pyspark.sql import functions as F

from layerkit import quality as Q
from layerkit.operators import sets as S
from layerkit.plans.base import query


def _row(check, table, column, observed, passed, expected, source):
    return (
        f"select '{check}' as \"check\", '{table}' as table_name, '{column}' as column_name, "
        f"({passed}) as passed, observed, '{expected}' as expected "
        f"from (select cast({observed} as double) as observed from {source})"
    )


def _all(*rows):
    return "\nunion all ".join(rows)


# Orders with nulls and texts that do not cast, derived so that SQL can do the same.
_HOLED = """(select *, nullif(o_orderpriority, '5-LOW') as priority,
    case when o_custkey % 50 = 0 then null else o_custkey end as custkey,
    case when o_orderkey % 9 = 0 then 'n/a' else cast(o_orderkey as varchar) end as code,
    o_totalprice - 5000 as net from orders)"""


def _holed(t):
    return t.orders.withColumns(
        {
            "priority": F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")),
            "custkey": F.when(F.col("o_custkey") % 50 == 0, None).otherwise(F.col("o_custkey")),
            "code": F.when(F.col("o_orderkey") % 9 == 0, "n/a").otherwise(F.col("o_orderkey").cast("string")),
            "net": F.col("o_totalprice") - 5000,
        }
    )


@query(
    _all(
        _row("not_null", "orders", "o_orderkey", "count_if(o_orderkey is null)", "observed = 0", "0 nulls", _HOLED),
        _row("not_null", "orders", "custkey", "count_if(custkey is null)", "observed = 0", "0 nulls", _HOLED),
        _row("null_share", "orders", "custkey", "count_if(custkey is null) / count(*)", "observed <= 0.1", "<= 0.1", _HOLED),
        _row("null_share", "orders", "priority", "count_if(priority is null) / count(*)", "observed <= 0.1", "<= 0.1", _HOLED),
    )
)
def dq_nulls(t):
    return Q.run_checks(
        _holed(t),
        "orders",
        [Q.not_null("o_orderkey"), Q.not_null("custkey"), Q.null_share("custkey"), Q.null_share("priority")],
    )


@query(
    """
    select count(*) as total_rows, count(case when custkey is null then 1 end) as null_custkey,
           count(case when priority is null then 1 end) as null_priority,
           count(case when net is null then 1 end) as null_net from """ + _HOLED
)
def null_analysis(t):
    return _holed(t).agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ("custkey", "priority", "net")],
    )


@query(
    _all(
        _row("unique", "orders", "o_orderkey", "count(*) - count(distinct o_orderkey)", "observed = 0", "0 duplicates", "orders"),
        _row(
            "unique", "lineitem", "l_orderkey, l_linenumber",
            "count(*) - count(distinct (l_orderkey, l_linenumber))", "observed = 0", "0 duplicates", "lineitem",
        ),
    )
)
def dq_unique(t):
    return Q.run_checks(t.orders, "orders", [Q.unique("o_orderkey")]).unionByName(
        Q.run_checks(t.lineitem, "lineitem", [Q.unique("l_orderkey", "l_linenumber")])
    )


@query("select l_orderkey, l_linenumber, count(*) as row_count from lineitem group by 1, 2 having count(*) > 1")
def dq_duplicates(t):
    return Q.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


# All customers take part; those of one segment have a shifted key, which makes their orders orphans.
_FEW = "(select * replace (case when c_mktsegment = 'BUILDING' then -1 - c_custkey else c_custkey end as c_custkey) from customer)"


def _few(t):
    key = F.col("c_custkey")
    return t.customer.withColumn("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", -1 - key).otherwise(key))


@query(
    _all(
        _row("referential", "orders", "o_custkey", f"count_if(o_custkey not in (select c_custkey from {_FEW}))", "observed = 0", "in customer.c_custkey", "orders"),
        _row("referential", "lineitem", "l_orderkey", "count_if(l_orderkey not in (select o_orderkey from orders))", "observed = 0", "in orders.o_orderkey", "lineitem"),
        _row("referential", "lineitem", "l_suppkey", "count_if(l_suppkey not in (select s_suppkey from supplier))", "observed = 0", "in supplier.s_suppkey", "lineitem"),
    )
)
def dq_referential(t):
    return Q.referential(t.orders, "orders", [("o_custkey", _few(t), "c_custkey", "customer")]).unionByName(
        Q.referential(
            t.lineitem, "lineitem",
            [("l_orderkey", t.orders, "o_orderkey", "orders"), ("l_suppkey", t.supplier, "s_suppkey", "supplier")],
        )
    )


@query(f"select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from {_FEW})")
def dq_orphans(t):
    return Q.orphans(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", _few(t), "c_custkey")


@query(
    _all(
        _row("min_rows", "orders", "", "count(*)", "observed >= 1", ">= 1", _HOLED),
        _row("rows_between", "orders", "", "count(*)", "observed between 100 and 14000", "100..14000", _HOLED),
        _row("non_negative", "orders", "net", "count_if(net < 0)", "observed = 0", ">= 0", _HOLED),
        _row("in_range", "orders", "o_orderdate", "count_if(o_orderdate < timestamp '1995-06-01' or o_orderdate > timestamp '2001-01-01')", "observed = 0", "1995-06-01..2001-01-01", _HOLED),
        _row("accepted", "orders", "o_orderstatus", "count_if(o_orderstatus not in ('O', 'F'))", "observed = 0", "in (O, F)", _HOLED),
        _row("castable", "orders", "code", "count_if(code is not null and try_cast(code as bigint) is null)", "observed = 0", "bigint", _HOLED),
        _row("urgent_is_big", "orders", "o_totalprice", "count_if(o_orderpriority = ''1-URGENT'' and o_totalprice < 20000)".replace("''", "'"), "observed = 0", "0 rows", _HOLED),
    )
)
def dq_rules(t):
    """Seven kinds of check in one pass over the table."""
    return Q.run_checks(
        _holed(t),
        "orders",
        [
            Q.min_rows(),
            Q.rows_between(100, 14000),
            Q.non_negative("net"),
            Q.in_range("o_orderdate", datetime.date(1995, 6, 1), datetime.date(2001, 1, 1)),
            Q.accepted("o_orderstatus", ["O", "F"]),
            Q.castable("code", "Int64.Type"),
            Q.rule(
                "urgent_is_big", "o_totalprice",
                (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") < 20000),
            ),
        ],
    )


@query(f"select o_orderkey, o_orderstatus, net from {_HOLED} where net < 0")
def dq_failing_rows(t):
    return Q.failing_rows(_holed(t), Q.non_negative("net")).select("o_orderkey", "o_orderstatus", "net")


@query(
    _all(
        _row("totals_match", "lineitem", "l_quantity", "abs(sum(l_quantity) - sum(case when l_returnflag <> 'R' then l_quantity end))", "observed < 0.01", "< 0.01", "lineitem"),
        _row("totals_match", "lineitem", "l_tax", "0", "observed < 0.01", "< 0.01", "(select count(*) from lineitem)"),
        _row("same_rows", "lineitem", "", "count_if(l_returnflag <> 'R') - count(*)", "observed = 0", "as many rows as the source", "lineitem"),
        _row("grain_kept", "customer", "", "count(*) - count(distinct (c_nationkey, c_mktsegment))", "observed = 0", "one row per source key", "customer"),
    )
)
def dq_totals(t):
    """Checks between two tables."""
    kept = t.lineitem.filter(F.col("l_returnflag") != "R")
    parts = [
        Q.totals_match(t.lineitem, "l_quantity", kept, "l_quantity", "lineitem"),
        Q.totals_match(t.lineitem, "l_tax", t.lineitem, "l_tax", "lineitem"),
        Q.same_rows(t.lineitem, kept, "lineitem"),
        Q.grain_kept(t.customer, t.customer, ["c_nationkey", "c_mktsegment"], "customer"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    _all(
        _row("row_drift", "orders", "", "count(*)", "observed between 12000 and 18000", "12000..18000", "orders"),
        _row("row_drift", "lineitem", "", "count(*)", "observed between 99 and 121", "99..121", "lineitem"),
    )
)
def dq_drift(t):
    return Q.run_checks(t.orders, "orders", [Q.row_drift(15000)]).unionByName(
        Q.run_checks(t.lineitem, "lineitem", [Q.row_drift(110, 0.1)])
    )


@query(
    """
    select count(*) as total_rows, count(distinct id) as load_batches, min(o_orderdate) as earliest_load,
           max(o_orderdate) as latest_load
    from (select 'load-' || year(o_orderdate) as id, o_orderdate from orders)
    """
)
def load_batches(t):
    return Q.batch_statistics(
        t.orders.select(
            F.concat(F.lit("load-"), F.year("o_orderdate").cast("string")).alias("_load_id"),
            F.col("o_orderdate").alias("_load_timestamp"),
        )
    )


@query(
    """
    select table_name, row_count,
      case when row_count = 0 then 'FAIL' when table_name = 'silver_orders' and row_count < 1000000000 then 'WARN' else 'PASS' end as status
    from (select 'bronze_orders' as table_name, count(*) as row_count from orders
          union all select 'silver_orders', count(*) from orders where o_orderstatus = 'F'
          union all select 'silver_empty', count(*) from orders where o_orderstatus = 'none')
    """
)
def layer_status(t):
    counts = S.row_counts(
        {
            "bronze_orders": t.orders,
            "silver_orders": t.orders.filter(F.col("o_orderstatus") == "F"),
            "silver_empty": t.orders.filter(F.col("o_orderstatus") == "none"),
        }
    )
    return Q.table_status(counts, {"bronze_orders": 1, "silver_orders": 1_000_000_000})


@query(
    _all(
        _row("not_null", "customer", "c_custkey", "count_if(c_custkey is null)", "observed = 0", "0 nulls", "customer"),
        _row("unique", "customer", "c_custkey", "count(*) - count(distinct c_custkey)", "observed = 0", "0 duplicates", "customer"),
        _row("unique", "customer", "c_name", "count(*) - count(distinct c_name)", "observed = 0", "0 duplicates", "customer"),
        _row("not_null", "customer", "c_name", "count_if(c_name is null)", "observed = 0", "0 nulls", "customer"),
        _row("not_null", "customer", "c_custkey", "count_if(c_custkey is null)", "observed = 0", "0 nulls", "customer"),
        _row("min_rows", "orders", "", "count(*)", "observed >= 1", ">= 1", "orders"),
        "select 'type', 'customer', 'c_custkey', true, 0.0::double, 'bigint'",
        "select 'type', 'customer', 'c_acctbal', false, 1.0::double, 'decimal(18,2)'",
        "select 'type', 'customer', 'c_nothing', false, 1.0::double, 'date'",
    )
)
def layer_checks(t):
    """Checks each layer requires, and expected column types."""
    return (
        Q.run_checks(t.customer, "customer", Q.required_checks("silver", ["c_custkey"]))
        .unionByName(Q.run_checks(t.customer, "customer", Q.required_checks("dimension", ["c_custkey"], "c_name")))
        .unionByName(Q.run_checks(t.orders, "orders", Q.required_checks("fact")))
        .unionByName(
            Q.has_types(
                t.customer, "customer",
                {"c_custkey": "Int64.Type", "c_acctbal": "decimal(18,2)", "c_nothing": "type date"},
            )
        )
    )
