"""Columns that belong together by their values."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallymark.operators import discovery
from workload.registry import Tables, query

# A copy of orders under other names, in another order, without some rows and cells.
RENAMED = """
SELECT o_orderpriority AS urgency, o_totalprice AS amount, CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE o_custkey END AS buyer,
       o_orderdate AS placed, o_orderkey AS number, CAST(o_orderkey % 13 AS INT) AS shelf, o_orderstatus AS state
FROM {orders} WHERE o_orderkey % 97 <> 0
"""
ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
COPY = ("urgency", "amount", "buyer", "placed", "number", "shelf", "state")


def _values(table: str, columns: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"SELECT DISTINCT '{n}' AS col, CAST({n} AS VARCHAR) AS v FROM {table} WHERE {n} IS NOT NULL" for n in columns)


@query("pairs_by_content", f"""
WITH copy AS ({RENAMED.format(orders="orders")}), s AS ({_values("orders", ORDERS)}), d AS ({_values("copy", COPY)}),
sn AS (SELECT col, count(*) AS n FROM s GROUP BY col), dn AS (SELECT col, count(*) AS n FROM d GROUP BY col),
p AS (SELECT s.col AS sc, d.col AS dc, count(*) AS n FROM s JOIN d USING (v) GROUP BY 1, 2)
SELECT sc AS source_column, dc AS destination_column, sn.n AS source_values, dn.n AS destination_values, p.n AS shared_values,
       least(p.n / sn.n, p.n / dn.n) AS overlap
FROM p JOIN sn ON sn.col = sc JOIN dn ON dn.col = dc WHERE least(p.n / sn.n, p.n / dn.n) >= 0.5
""")
def pairs_by_content(t: Tables) -> DataFrame:
    """Orders and a renamed copy: every column finds its own, and no other."""
    return discovery.content_pairs(t.orders, t.sql(RENAMED))


STAR = {
    "region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"), "orders": ORDERS,
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                 "l_returnflag", "l_linestatus", "l_shipdate"),
}
KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey", "n_regionkey"), "customer": ("c_custkey", "c_nationkey"),
    "supplier": ("s_suppkey", "s_nationkey"), "part": ("p_partkey",), "orders": ("o_orderkey", "o_custkey"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey"), "labels": ("doc_id",), "documents": ("doc_id",),
}


def _inclusion_sql(tables: dict[str, tuple[str, ...]]) -> str:
    values = " UNION ALL ".join(
        f"SELECT DISTINCT '{t}' AS t, '{n}' AS c, CAST({n} AS VARCHAR) AS v FROM {t} WHERE {n} IS NOT NULL" for t, names in tables.items() for n in names)
    return f"""
v AS ({values}), n AS (SELECT t, c, count(*) AS n FROM v GROUP BY ALL),
i AS (SELECT a.t AS ct, a.c AS cc, b.t AS pt, b.c AS pc, count(*) AS n FROM v a JOIN v b ON a.v = b.v AND (a.t, a.c) <> (b.t, b.c) GROUP BY ALL),
inc AS (SELECT ct AS child_table, cc AS child_column, pt AS parent_table, pc AS parent_column, x.n AS child_values, y.n AS parent_values
        FROM i JOIN n x ON x.t = ct AND x.c = cc JOIN n y ON y.t = pt AND y.c = pc WHERE i.n = x.n)"""


@query("inclusions", f"WITH {_inclusion_sql(STAR)} SELECT * FROM inc")
def inclusions(t: Tables) -> DataFrame:
    """Every column of seven tables against every other."""
    return discovery.inclusions({name: getattr(t, name) for name in STAR})


@query("foreign_keys", f"""
WITH {_inclusion_sql(KEYS)},
sizes AS ({" UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS rows FROM {t}" for t in KEYS)}),
named AS (SELECT *, regexp_replace(child_column, '^[a-z]_', '') = regexp_replace(parent_column, '^[a-z]_', '') AS alike FROM inc)
SELECT child_table, child_column, parent_table, parent_column, child_values, parent_values, child_values / parent_values AS coverage
FROM named JOIN sizes ON t = parent_table WHERE rows = parent_values AND alike AND child_table <> parent_table
""")
def foreign_keys(t: Tables) -> DataFrame:
    """The references among nine tables, found in the data: line items to orders, orders to customers, and so on."""
    return discovery.foreign_keys({name: getattr(t, name) for name in (*STAR, "labels", "documents")})
