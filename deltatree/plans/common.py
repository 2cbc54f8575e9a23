"""Registry of queries, and the pieces that many of them share.

``query(name, sql)`` registers a Spark plan together with the SQL that checks it.
The SQL names shared subqueries from ``CTES``; the ones it needs are put in front.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltatree.functions.periods import Period
from deltatree.operators.tree import MetricTree, load_dictionary
from deltatree.sources.facts import daily_cube

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register


def cte(name: str, sql: str) -> None:
    if name in CTES:
        raise ValueError(f"subquery {name} is declared twice")
    CTES[name] = sql.strip()


def compose(sql: str) -> str:
    """``sql`` with the shared subqueries it uses in front, in declared order."""
    needed: set[str] = set()
    names = set(CTES)

    def visit(text: str) -> None:
        for word in set(re.findall(r"[A-Za-z_]\w*", text)) & names:
            if word not in needed:
                needed.add(word)
                visit(CTES[word])

    visit(sql)
    if not needed:
        return sql.strip()
    parts = [f"{name} AS MATERIALIZED ({CTES[name]})" for name in CTES if name in needed]
    text = sql.strip()
    if text.startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + text[5:]
    return "WITH " + ",\n".join(parts) + "\n" + text


# Periods of the sales history.
BASE = Period("1997-12-04", "1997-12-31")
CURRENT = Period("1998-01-01", "1998-01-28")
WEEK = Period("1998-01-05", "1998-01-11")
OBSERVED = CURRENT.trailing(42)
#: What-if series end with the current period.
WHATIF = CURRENT.trailing(120)

IN_BASE = f"day BETWEEN DATE '{BASE.start}' AND DATE '{BASE.end}'"
IN_CURRENT = f"day BETWEEN DATE '{CURRENT.start}' AND DATE '{CURRENT.end}'"
IN_WEEK = f"day BETWEEN DATE '{WEEK.start}' AND DATE '{WEEK.end}'"
IN_OBSERVED = f"day BETWEEN DATE '{OBSERVED.start}' AND DATE '{OBSERVED.end}'"

SLICES = {
    "all": {},
    "urgent": {"channel": ["1-URGENT"]},
    "fast_asia": {"channel": ["1-URGENT", "2-HIGH"], "region": ["ASIA"]},
    "cars": {"segment": ["AUTOMOBILE"]},
    "west_low": {"channel": ["5-LOW"], "region": ["AMERICA", "EUROPE"]},
}


@cache
def trees() -> dict[str, MetricTree]:
    return load_dictionary()


def retail() -> MetricTree:
    return trees()["retail"]


def margin() -> MetricTree:
    return trees()["margin"]


def orders_cube(spark: SparkSession, sf_dir: str, dims: Sequence[str] = (), period: Period | None = None,
                measures: Sequence[str] | None = None) -> DataFrame:
    return daily_cube(spark, sf_dir, dims, measures, period and period.start, period and period.end)


def lines_cube(spark: SparkSession, sf_dir: str, dims: Sequence[str] = (), period: Period | None = None,
               measures: Sequence[str] = ("lines", "units", "revenue_cents", "discount_cents", "tax_cents",
                                          "material_cents")) -> DataFrame:
    return daily_cube(spark, sf_dir, dims, measures, period and period.start, period and period.end)


def span(first: Period, last: Period) -> Period:
    return Period(min(first.start, last.start), max(first.end, last.end))


def money(column: str, name: str | None = None):
    """Whole-cent sum as a long, for output."""
    return F.round(column).cast("long").alias(name or column)


def r(column, digits: int = 6):
    """Rounded for output; adding 0.0 turns a negative zero into zero."""
    return F.round(column, digits) + F.lit(0.0)


def sig(column):
    """As ``r`` for ratios that can be very large: nine digits from 1,000 on, which is what two engines agree on."""
    exponent = F.floor(F.log10(F.abs(column)))
    # powers of ten with whole exponents from 0 on are exact; one of the two is 1
    up, down = (F.pow(F.lit(10.0), F.greatest(x, F.lit(0))) for x in (8 - exponent, exponent - 8))
    return F.when(F.abs(column) < 1000, r(column)).otherwise(F.round(column * up / down) / up * down)


def sig_sql(expression: str) -> str:
    exponent = f"floor(log10(abs({expression})))"
    up, down = f"pow(10.0::DOUBLE, greatest(8 - {exponent}, 0))", f"pow(10.0::DOUBLE, greatest({exponent} - 8, 0))"
    return f"(CASE WHEN abs({expression}) < 1000 THEN {r_sql(expression)} ELSE round(({expression}) * {up} / {down}) / {up} * {down} END)"


#: Metrics in cents; the others are counts and ratios.
MONEY = ("revenue", "profit", "refund", "discount_cost", "tax_cost", "material_cost")


def in_money(column: str):
    return F.col(column).isin(*MONEY)


def in_money_sql(expression: str) -> str:
    return f"{expression} IN ({', '.join(repr(m) for m in MONEY)})"


def amount(column, name: str | None = None, money=None):
    """Whole cents where ``money`` holds (everywhere by default), four digits elsewhere: two engines agree on these."""
    value = F.col(column) if isinstance(column, str) else column
    shown = F.round(value) if money is None else F.when(money, F.round(value)).otherwise(F.round(value, 4))
    return (shown + F.lit(0.0)).alias(name or column)


def amount_sql(expression: str, money: str | None = None) -> str:
    if money is None:
        return f"(round({expression}) + 0.0::DOUBLE)"
    return f"(CASE WHEN {money} THEN round({expression}) ELSE round({expression}, 4) END + 0.0::DOUBLE)"


def r_sql(expression: str, digits: int = 6) -> str:
    return f"(round({expression}, {digits}) + 0.0::DOUBLE)"


# One row per line with every dimension code; the same roundings as the Spark fact.
cte("v", """
SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey AS order_id,
       o_orderpriority AS channel, COALESCE(c_mktsegment, 'unknown') AS segment,
       COALESCE(n_name, 'unknown') AS nation, COALESCE(r_name, 'unknown') AS region,
       COALESCE(p_type, 'unknown') AS category, COALESCE(p_brand, 'unknown') AS sku,
       l_returnflag AS status,
       CAST(round(l_quantity) AS BIGINT) AS units,
       CAST(round(l_extendedprice * 100) AS BIGINT) AS revenue_cents,
       CAST(round(l_extendedprice * l_discount * 100) AS BIGINT) AS discount_cents,
       CAST(round(l_extendedprice * l_tax * 100) AS BIGINT) AS tax_cents,
       CAST(round(p_retailprice * l_quantity * 100) AS BIGINT) AS material_cents
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
LEFT JOIN part ON l_partkey = p_partkey
LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey
""")

cte("cal_days", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders")

# Daily totals over everything.
cte("daily", """
SELECT day, COUNT(DISTINCT order_id) AS orders, COUNT(*) AS lines, CAST(SUM(units) AS BIGINT) AS units,
       CAST(SUM(revenue_cents) AS BIGINT) AS revenue_cents
FROM v GROUP BY day
""")

# Daily totals by channel.
cte("daily_channel", """
SELECT day, channel, COUNT(DISTINCT order_id) AS orders, COUNT(*) AS lines, CAST(SUM(units) AS BIGINT) AS units,
       CAST(SUM(revenue_cents) AS BIGINT) AS revenue_cents
FROM v GROUP BY day, channel
""")

# Slices (all, every channel, every region, channel x region) by month.
cte("month_sums", """
SELECT CAST(date_trunc('month', day) AS DATE) AS month,
       CASE WHEN GROUPING(channel) = 0 AND GROUPING(region) = 0 THEN 'channel=' || channel || '&region=' || region
            WHEN GROUPING(channel) = 0 THEN 'channel=' || channel
            WHEN GROUPING(region) = 0 THEN 'region=' || region ELSE 'all' END AS slice_id,
       CAST(COUNT(DISTINCT order_id) AS DOUBLE) AS orders, CAST(COUNT(*) AS DOUBLE) AS lines,
       CAST(SUM(units) AS DOUBLE) AS units, CAST(SUM(revenue_cents) AS DOUBLE) AS revenue,
       CAST(SUM(discount_cents) AS DOUBLE) AS discount, CAST(SUM(tax_cents) AS DOUBLE) AS tax,
       CAST(SUM(material_cents) AS DOUBLE) AS material
FROM v GROUP BY GROUPING SETS ((1), (1, channel), (1, region), (1, channel, region))
""")

MONTH_SETS = ((), ("channel",), ("region",), ("channel", "region"))
