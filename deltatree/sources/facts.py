"""Fact tables: line rows, order rows and the daily cube built from them.

All money is integer cents in LongType, so sums are exact whatever the order of
rows. The daily cube has one row per day and combination of dimension codes; it
is bounded by the calendar and the code lists, not by the number of orders, and
all metric plans start from it.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltatree.operators.ranks import range_ranks

UNKNOWN = "unknown"

#: dimension -> (table, key, code column); how a code is found from an order or a line
ORDER_DIMS = ("channel", "segment", "nation", "region")
LINE_DIMS = ("category", "sku", "status")
ORDER_MEASURES = ("orders", "lines", "units", "revenue_cents", "discount_cents", "tax_cents")
LINE_MEASURES = (
    "lines", "units", "revenue_cents", "discount_cents", "tax_cents", "material_cents",
)


#: Declared schemas: no job is started to infer them, and a wrong file fails early.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def cents(amount: Column) -> Column:
    """Round an amount to whole cents, halves away from zero."""
    return whole(amount * 100)


def whole(value: Column) -> Column:
    """Nearest whole number as a long.

    ``round`` on a double goes through BigDecimal for every row; this stays in
    double arithmetic and the generated code.
    """
    return F.signum(value).cast("long") * F.floor(F.abs(value) + 0.5)


def _timestamp_bounds(column: str, start: str | None, end: str | None) -> Column | None:
    """Closed day interval as a range on the stored timestamp, so parquet can use it."""
    conditions = []
    if start is not None:
        conditions.append(F.col(column) >= F.lit(datetime.fromisoformat(start)).cast("timestamp_ntz"))
    if end is not None:
        after = datetime.fromisoformat(end) + timedelta(days=1)
        conditions.append(F.col(column) < F.lit(after).cast("timestamp_ntz"))
    if not conditions:
        return None
    result = conditions[0]
    for condition in conditions[1:]:
        result = result & condition
    return result


def _check_period(start: str | None, end: str | None) -> None:
    if start and end and date.fromisoformat(end) < date.fromisoformat(start):
        raise ValueError(f"period ends before it starts: {start}..{end}")


def order_heads(
    spark: SparkSession,
    sf_dir: str,
    dims: Sequence[str] = (),
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """One row per order: ``order_id, day`` and the order's dimension codes.

    Only the dimension tables that ``dims`` needs are joined. A missing
    dimension row gives the code ``'unknown'``.
    """
    _check_period(start, end)
    orders = table(spark, sf_dir, "orders")
    bounds = _timestamp_bounds("o_orderdate", start, end)
    if bounds is not None:
        orders = orders.where(bounds)
    heads = orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey"),
        F.to_date("o_orderdate").alias("day"),
        F.coalesce("o_orderpriority", F.lit(UNKNOWN)).alias("channel"),
    )
    if any(d in dims for d in ("segment", "nation", "region")):
        customer = table(spark, sf_dir, "customer")
        heads = heads.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        heads = heads.withColumn("segment", F.coalesce("c_mktsegment", F.lit(UNKNOWN)))
    if any(d in dims for d in ("nation", "region")):
        nation = table(spark, sf_dir, "nation")
        heads = heads.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        heads = heads.withColumn("nation", F.coalesce("n_name", F.lit(UNKNOWN)))
    if "region" in dims:
        region = table(spark, sf_dir, "region")
        heads = heads.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        heads = heads.withColumn("region", F.coalesce("r_name", F.lit(UNKNOWN)))
    return heads.select("order_id", "day", *[d for d in ORDER_DIMS if d in dims])


def _line_measures(lines: DataFrame) -> DataFrame:
    price = F.col("l_extendedprice")
    return lines.select(
        "l_orderkey", "l_partkey",
        F.col("l_returnflag").alias("status"),
        "l_quantity",
        whole(F.col("l_quantity")).alias("units"),
        cents(price).alias("revenue_cents"),
        cents(price * F.col("l_discount")).alias("discount_cents"),
        cents(price * F.col("l_tax")).alias("tax_cents"),
    )


def order_rows(
    spark: SparkSession,
    sf_dir: str,
    dims: Sequence[str] = (),
    measures: Sequence[str] = ORDER_MEASURES,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """One row per order with its dimension codes and summed measures.

    Lines are summed per order before the join: the map-side combine folds an
    order key which holds a large share of all lines, and the join reuses the
    partitioning of the aggregate, so lines are shuffled once. With a period,
    lines of other orders are dropped before they are summed or shuffled for it; a question that is
    asked often reads the stored fact instead, whose months are pruned.
    """
    lines = _line_measures(table(spark, sf_dir, "lineitem"))
    summed = [m for m in measures if m in ("units", "revenue_cents", "discount_cents", "tax_cents")]
    aggregates = [F.sum(m).alias(m) for m in summed]
    aggregates.append(F.count(F.lit(1)).alias("lines"))
    heads = order_heads(spark, sf_dir, dims, start, end)
    if start or end:
        lines = lines.join(heads.select("order_id"), F.col("l_orderkey") == F.col("order_id"), "left_semi")
    per_order = lines.groupBy("l_orderkey").agg(*aggregates)
    rows = heads.join(per_order, F.col("order_id") == F.col("l_orderkey"))
    return rows.withColumn("orders", F.lit(1).cast("long")).select(
        "order_id", "day", *dims, *measures
    )


def line_rows(
    spark: SparkSession,
    sf_dir: str,
    dims: Sequence[str] = (),
    measures: Sequence[str] = LINE_MEASURES,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """One row per line with the dimension codes asked for.

    Each join has a unique key on its dimension side; a hot order or part key
    is split by AQE (skew join), and small dimension sides are broadcast by
    Catalyst when their measured size is below the session threshold.
    """
    lines = _line_measures(table(spark, sf_dir, "lineitem"))
    if any(d in dims for d in ("category", "sku")) or "material_cents" in measures:
        part = table(spark, sf_dir, "part")
        lines = lines.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        lines = (
            lines.withColumn("category", F.coalesce("p_type", F.lit(UNKNOWN)))
            .withColumn("sku", F.coalesce("p_brand", F.lit(UNKNOWN)))
            .withColumn("material_cents", cents(F.col("p_retailprice") * F.col("l_quantity")))
        )
    heads = order_heads(spark, sf_dir, [d for d in dims if d in ORDER_DIMS], start, end)
    rows = lines.join(heads, F.col("l_orderkey") == F.col("order_id"))
    return rows.withColumn("lines", F.lit(1).cast("long")).select(
        "order_id", "day", *dims, *measures
    )


def daily_cube(
    spark: SparkSession,
    sf_dir: str,
    dims: Sequence[str] = (),
    measures: Sequence[str] | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Order detail to daily fact: sums per day and combination of codes.

    Order-level dimensions use the order path, so that the number of orders is a
    plain count and stays additive. With a line-level dimension or material cost
    the line path is used and ``orders`` is not offered, because an order can
    then belong to several combinations.
    """
    line_level = any(d in LINE_DIMS for d in dims) or "material_cents" in (measures or ())
    chosen = tuple(measures or (LINE_MEASURES if line_level else ORDER_MEASURES))
    if line_level and "orders" in chosen:
        raise ValueError("orders cannot be summed over line-level dimensions")
    build = line_rows if line_level else order_rows
    rows = build(spark, sf_dir, dims, chosen, start, end)
    return rows.groupBy("day", *dims).agg(*[F.sum(m).alias(m) for m in chosen])


def open_fact(spark: SparkSession, path: str) -> DataFrame:
    """Handle of a stored daily fact; open it once, its files are listed then."""
    return spark.read.parquet(path)


def load_facts(fact: DataFrame, columns: Sequence[str] | None = None,
               start: str | None = None, end: str | None = None) -> DataFrame:
    """Days of a stored fact: month folders pruned, days filtered, columns pruned."""
    _check_period(start, end)
    if start:
        fact = fact.where((F.col("month") >= start[:7]) & (F.col("day") >= F.lit(date.fromisoformat(start))))
    if end:
        fact = fact.where((F.col("month") <= end[:7]) & (F.col("day") <= F.lit(date.fromisoformat(end))))
    return fact.select(*columns) if columns else fact.drop("month")


def write_fact(df: DataFrame, path: str, cluster_by: Sequence[str] = ()) -> str:
    """Store a daily fact in month folders, days sorted inside each file.

    One folder per month keeps files large; the rebalance splits a month by its measured
    size, so a large one is written by as many tasks as it needs.
    """
    (
        df.withColumn("month", F.date_format("day", "yyyy-MM"))
        .hint("rebalance", F.col("month"))
        .sortWithinPartitions("month", "day", *cluster_by)
        .write.mode("overwrite")
        .partitionBy("month")
        .parquet(path)
    )
    return path


def resolve_codes(requested: DataFrame, dimension: DataFrame, code: str, key: str) -> DataFrame:
    """Code to key, with unknown codes reported instead of dropped."""
    found = dimension.select(F.col(code).alias("_code"), F.col(key).alias("id"))
    return (
        requested.select("code").distinct()
        .join(found, F.col("code") == F.col("_code"), "left")
        .select("code", "id", F.when(F.col("id").isNull(), "unknown").otherwise("known").alias("status"))
    )


#: Codes of a dimension that are gathered to one array; a longer list is joined by number.
LISTED = 10_000
#: Cells of a grid; a larger one is refused.
MOST_CELLS = 10 ** 11
#: Numbers that one generated row unrolls to.
UNROLLED = 1_000


def densify(fact: DataFrame, codes: dict[str, DataFrame], keys: DataFrame, measures: Sequence[str],
            listed: int = LISTED, most: int = MOST_CELLS) -> DataFrame:
    """Every combination of the listed codes per key row, absent ones with measure 0.

    ``codes`` maps a dimension to its code list; nulls are no codes. The lists are counted first, and a grid of more than ``most`` cells
    is refused. A list of up to ``listed`` codes is one array, exploded where the key rows are. A longer one is numbered by ranges;
    key rows are dealt out with blocks of numbers, unrolled, and joined with the codes by number, so no task holds a list.
    """
    grid = keys.distinct()
    lists = {dim: listing.select(dim).where(F.col(dim).isNotNull()).distinct() for dim, listing in codes.items()}
    counts = {dim: rows.count() for dim, rows in lists.items()}
    cells = grid.count() * prod(counts.values())
    if cells > most:
        raise ValueError(f"a grid of {cells} cells; at most {most} are made")
    for dim in (d for d in codes if counts[d] <= listed):
        array = lists[dim].select(F.sort_array(F.collect_list(dim)).alias("a")).scalar()
        grid = grid.select("*", F.explode(array).alias(dim))
    for dim in (d for d in codes if counts[d] > listed):
        numbered = range_ranks(lists[dim], [], [F.col(dim)], "_number")
        blocks = F.sequence(F.lit(0), F.lit((counts[dim] - 1) // UNROLLED))
        first = F.col("_block") * UNROLLED + 1
        spread = grid.withColumn("_block", F.explode(blocks)).repartition(*grid.columns, "_block")
        unrolled = spread.withColumn("_number", F.explode(F.sequence(first, F.least(first + UNROLLED - 1, F.lit(counts[dim])))))
        grid = unrolled.join(numbered, "_number").select(*grid.columns, dim)
    order = [*keys.columns, *codes]
    joined = grid.select(*order).join(fact, order, "left")
    return joined.select(
        *order,
        *[F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in measures],
        F.col(measures[0]).isNull().alias("filled"),
    )
