"""Planning tables derived from the TPC-H-style test tables.

The allocation engine needs a macro table (one target per control group) and
a granular table (baseline per client and sku inside each group). Both are
aggregations of order lines:

    lineitem ⋈ orders ⋈ customer ⋈ nation [⋈ region] [⋈ part]

* period   = month of ``o_orderdate``
* market   = region name (``market='region'``) or nation name (``'nation'``)
* channel  = order priority (``channel='priority'``) or order status (``'status'``)
* client   = customer market segment
* sku      = part key as text
* granular = all lines, by month; macro = all lines moved back twelve months,
  so that a month's target is what was ordered in the same month a year later.
  The first year's months have no earlier baseline and the last year's no target:
  both sides have groups without a counterpart.

Every builder has a twin that returns the same table as DuckDB SQL (a CTE
body), used by the oracle queries.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plan_alloc.functions.columns import period_month
from plan_alloc.session import keep, spread

AMOUNT = "decimal(18,2)"
ROW_KEYS = ("period", "market", "channel", "client", "sku")


@dataclass(frozen=True)
class Cube:
    market: str = "region"  # 'region' | 'nation'
    channel: str = "priority"  # 'priority' | 'status'
    brands: tuple[str, ...] | None = None  # keep only parts of these brands
    returned_only: bool = False  # baseline counts only returned lines (zero-baseline groups)
    net_of_returns: bool = False  # returned lines count negative (negative baselines)
    null_market: str | None = None  # this market value becomes NULL (sentinel tests)


_READERS: dict[tuple[int, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; the reader (file listing, footer schema) is made once per
    session and path, and reusing the same relation lets Spark reuse scans."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (id(spark), path)
    df = _READERS.get(key)
    if df is None or df.sparkSession is not spark:
        df = _READERS[key] = spark.read.parquet(path)
    return df


def _line_count(spark: SparkSession, sf_dir: str) -> int:
    """Number of order lines (read from the files' footers)."""
    return table(spark, sf_dir, "lineitem").count()


def _lines(spark: SparkSession, sf_dir: str, cube: Cube) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    o = orders.join(customer, orders.o_custkey == customer.c_custkey).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    if cube.market == "region":
        region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
        o = o.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        market = F.col("r_name")
    else:
        market = F.col("n_name")
    if cube.null_market is not None:
        market = F.when(market != F.lit(cube.null_market), market)
    channel = F.col("o_orderpriority") if cube.channel == "priority" else F.col("o_orderstatus")
    lineitem = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag"
    )
    # As many tasks as the lines ask for, on both sides.
    n = _line_count(spark, sf_dir)
    rows = spread(lineitem, n, "l_orderkey").join(spread(o, n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    if cube.brands is not None:
        part = table(spark, sf_dir, "part").filter(F.col("p_brand").isin(*cube.brands)).select("p_partkey")
        rows = rows.join(part, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    qty = F.col("l_quantity")
    amount = F.col("l_extendedprice").cast(AMOUNT)
    if cube.returned_only:
        returned = F.col("l_returnflag") == F.lit("R")
        qty = F.when(returned, qty).otherwise(F.lit(0.0))
        amount = F.when(returned, amount).otherwise(F.lit(0).cast(AMOUNT))
    if cube.net_of_returns:
        returned = F.col("l_returnflag") == F.lit("R")
        qty = F.when(returned, -qty).otherwise(qty)
        amount = F.when(returned, -amount).otherwise(amount)
    return rows.select(
        F.trunc(F.col("o_orderdate").cast("date"), "month").alias("period"),
        market.alias("market"),
        channel.alias("channel"),
        F.col("c_mktsegment").alias("client"),
        F.col("l_partkey").cast("string").alias("sku"),
        qty.alias("qty"),
        amount.alias("amount"),
    )


_BUILT: dict[tuple, DataFrame] = {}


def _memo(kind: str, build):
    """DataFrames are immutable lazy plans: one built per (session, folder,
    cube) is reused instead of being planned again."""

    def wrapper(spark: SparkSession, sf_dir: str, cube: Cube = Cube()) -> DataFrame:
        key = (kind, id(spark), sf_dir.rstrip("/"), cube)
        df = _BUILT.get(key)
        if df is None or df.sparkSession is not spark:
            df = _BUILT[key] = build(spark, sf_dir, cube)
        return df

    wrapper.__doc__ = build.__doc__
    wrapper.__name__ = build.__name__
    return wrapper


def _by_row(spark: SparkSession, sf_dir: str, cube: Cube) -> DataFrame:
    """The one aggregation of order lines that both planning tables start from:
    Spark makes its exchange once in a query that reads both. The lines hardly
    repeat a key, so they are dealt by it as they are: summing them up before would
    hold nearly all of a task's lines in memory."""
    return (
        spread(_lines(spark, sf_dir, cube), _line_count(spark, sf_dir), *ROW_KEYS)
        .groupBy(*ROW_KEYS)
        .agg(F.sum("qty").alias("qty"), F.sum("amount").alias("amount"))
    )


def _granular_cube(spark: SparkSession, sf_dir: str, cube: Cube = Cube()) -> DataFrame:
    """period, market, channel, client, sku, baseline_qty, baseline_value."""
    return _granular_of(_by_row(spark, sf_dir, cube))


def _granular_of(by_row: DataFrame) -> DataFrame:
    values = [F.col("amount").cast("double").alias("baseline_value")] if "amount" in by_row.columns else []
    return by_row.select("period", "market", "channel", "client", "sku", F.col("qty").alias("baseline_qty"), *values)


def _macro_cube(spark: SparkSession, sf_dir: str, cube: Cube = Cube()) -> DataFrame:
    """period, market, channel, macro_target_qty, macro_target_value (the totals
    of the same month a year later)."""
    return _macro_of(_by_row(spark, sf_dir, cube))


def _macro_of(by_row: DataFrame) -> DataFrame:
    values = [F.sum("amount").cast("double").alias("macro_target_value")] if "amount" in by_row.columns else []
    return (
        by_row
        .groupBy(F.add_months("period", -12).alias("period"), "market", "channel")
        .agg(F.sum("qty").alias("macro_target_qty"), *values)
    )


def _market_totals(spark: SparkSession, sf_dir: str, cube: Cube = Cube()) -> DataFrame:
    """period, market, channel, total_market_qty, total_market_value over all
    parts (brand filter ignored): the market a share target applies to."""
    whole = Cube(market=cube.market, channel=cube.channel, null_market=cube.null_market)
    return (
        _lines(spark, sf_dir, whole)
        .groupBy("period", "market", "channel")
        .agg(
            F.sum("qty").alias("total_market_qty"),
            F.sum("amount").cast("double").alias("total_market_value"),
        )
    )


def kept_cubes(spark: SparkSession, sf_dir: str, cube: Cube = Cube(), values: bool = True) -> tuple[DataFrame, DataFrame]:
    """``granular_cube`` and ``macro_cube`` over one table of their common rows, for
    queries of several jobs: the lines are joined and summed up once, written to
    the shared checkpoint folder, and every job reads that. Without ``values`` the
    amounts are not even summed up."""
    by_row = _by_row(spark, sf_dir, cube)
    by_row = keep(by_row, "cube") if values else keep(by_row.drop("amount"), "cube", clean=True)
    granular = _granular_of(by_row)
    granular.kept_at = by_row.kept_at  # ``forget`` takes it
    return granular, _macro_of(by_row)


granular_cube = _memo("granular", _granular_cube)
macro_cube = _memo("macro", _macro_cube)
market_totals = _memo("market", _market_totals)


# How the text table spells periods, by (orderkey + linenumber) % 7
# (0-4: the five accepted formats; 5: accepted format wrapped in whitespace;
# 6: month 13, unreadable), and quantities, by line number (1: thousands
# separator, 2: blanks, 3: letters, 4: plain number, 5: NaN, 6: type suffix,
# 7: missing).
PERIOD_TEXT_FORMATS = ("yyyy-MM", "yyyy-MM-dd", "yyyy/MM", "yyyy/MM/dd", "dd/MM/yyyy")
PERIOD_TEXT_STRFTIME = ("%Y-%m", "%Y-%m-%d", "%Y/%m", "%Y/%m/%d", "%d/%m/%Y")


def text_lines(spark: SparkSession, sf_dir: str, cube: Cube = Cube()) -> DataFrame:
    """Every order line as an untyped upload would carry it: period and
    quantity as text in several spellings (the standardising inputs).

    l_orderkey, l_linenumber, period, market, channel, client, sku, baseline_qty
    """
    lineitem = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    rows = (
        lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    market = F.col("r_name") if cube.market == "region" else F.col("n_name")
    if cube.null_market is not None:
        market = F.when(market != F.lit(cube.null_market), market)
    channel = F.col("o_orderpriority") if cube.channel == "priority" else F.col("o_orderstatus")
    d = F.col("o_orderdate")
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 7
    period = F.when(k == 5, F.concat(F.lit(" \t"), F.date_format(d, "yyyy-MM"), F.lit(" ")))
    period = period.when(k == 6, F.concat(F.year(d).cast("string"), F.lit("-13")))
    for i, fmt in enumerate(PERIOD_TEXT_FORMATS):
        period = period.when(k == i, F.date_format(d, fmt))
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    qty = (
        F.when(n == 1, F.concat(F.lit("1,0"), F.lpad(q.cast("int").cast("string"), 2, "0"), F.lit(".5")))
        .when(n == 2, F.lit("   "))
        .when(n == 3, F.lit("abc"))
        .when(n == 4, q.cast("string"))
        .when(n == 5, F.lit("NaN"))
        .when(n == 6, F.lit("1.0d"))
    )
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        period.alias("period"),
        market.alias("market"),
        channel.alias("channel"),
        F.col("c_mktsegment").alias("client"),
        F.col("l_partkey").cast("string").alias("sku"),
        qty.alias("baseline_qty"),
    )


def text_lines_sql(cube: Cube = Cube()) -> str:
    market = "r.r_name" if cube.market == "region" else "n.n_name"
    if cube.null_market is not None:
        market = f"NULLIF({market}, '{cube.null_market}')"
    channel = "o.o_orderpriority" if cube.channel == "priority" else "o.o_orderstatus"
    k = "((l.l_orderkey + l.l_linenumber) % 7)"
    whens = " ".join(f"WHEN {k} = {i} THEN strftime(o.o_orderdate, '{f}')" for i, f in enumerate(PERIOD_TEXT_STRFTIME))
    return f"""
    SELECT l.l_orderkey, l.l_linenumber,
           CASE {whens}
                WHEN {k} = 5 THEN ' ' || chr(9) || strftime(o.o_orderdate, '%Y-%m') || ' '
                WHEN {k} = 6 THEN CAST(year(o.o_orderdate) AS VARCHAR) || '-13' END AS period,
           {market} AS market, {channel} AS channel, c.c_mktsegment AS client,
           CAST(l.l_partkey AS VARCHAR) AS sku,
           CASE l.l_linenumber
                WHEN 1 THEN '1,0' || lpad(CAST(CAST(l.l_quantity AS INTEGER) AS VARCHAR), 2, '0') || '.5'
                WHEN 2 THEN '   '
                WHEN 3 THEN 'abc'
                WHEN 4 THEN CAST(l.l_quantity AS VARCHAR)
                WHEN 5 THEN 'NaN'
                WHEN 6 THEN '1.0d' END AS baseline_qty
    FROM lineitem l
    JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nation n ON c.c_nationkey = n.n_nationkey
    JOIN region r ON n.n_regionkey = r.r_regionkey"""


# How an order line is spelt as CSV, by (orderkey + linenumber) % 6
# (1: the quantity's comma not quoted, a surplus field; 3: the quantity missing;
# 5: an unclosed quote; otherwise well formed, client quoted with a doubled quote
# in it, quantity quoted).
CSV_HEADER = "period,market,channel,client,sku,baseline_qty"


def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One CSV line for each order line of ``text_lines``, a half of them malformed."""
    t = text_lines(spark, sf_dir)
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 6
    client = F.concat(F.lit('"'), F.col("client"), F.lit(' ""A"""'))
    qty = F.concat(F.lit("1,0"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lit(".5"))
    ending = (
        F.when(k == 1, F.concat(F.lit(","), qty))
        .when(k == 3, F.lit(""))
        .when(k == 5, F.concat(F.lit(',"'), qty))
        .otherwise(F.concat(F.lit(',"'), qty, F.lit('"')))
    )
    period = F.date_format(F.coalesce(period_month(F.col("period"), t.schema["period"].dataType), F.lit("1990-01-01").cast("date")), "yyyy-MM")
    return t.select(F.concat(period, F.lit(","), "market", F.lit(","), "channel", F.lit(","), client, F.lit(","), "sku", ending).alias("line"))


# --------------------------------------------------------------------------
# DuckDB twins (CTE bodies)
# --------------------------------------------------------------------------
def lines_sql(cube: Cube) -> str:
    market = "r.r_name" if cube.market == "region" else "n.n_name"
    if cube.null_market is not None:
        market = f"NULLIF({market}, '{cube.null_market}')"
    channel = "o.o_orderpriority" if cube.channel == "priority" else "o.o_orderstatus"
    region_join = "JOIN region r ON r.r_regionkey = n.n_regionkey" if cube.market == "region" else ""
    brand_filter = ""
    if cube.brands is not None:
        names = ", ".join(f"'{b}'" for b in cube.brands)
        brand_filter = f"WHERE l.l_partkey IN (SELECT p_partkey FROM part WHERE p_brand IN ({names}))"
    qty = "l.l_quantity"
    amount = f"CAST(l.l_extendedprice AS DECIMAL(18,2))"
    if cube.returned_only:
        qty = f"CASE WHEN l.l_returnflag = 'R' THEN {qty} ELSE 0.0 END"
        amount = f"CASE WHEN l.l_returnflag = 'R' THEN {amount} ELSE CAST(0 AS DECIMAL(18,2)) END"
    if cube.net_of_returns:
        qty = f"CASE WHEN l.l_returnflag = 'R' THEN -{qty} ELSE {qty} END"
        amount = f"CASE WHEN l.l_returnflag = 'R' THEN -{amount} ELSE {amount} END"
    return f"""
    SELECT CAST(date_trunc('month', o.o_orderdate) AS DATE) AS period,
           {market} AS market,
           {channel} AS channel,
           c.c_mktsegment AS client,
           CAST(l.l_partkey AS VARCHAR) AS sku,
           {qty} AS qty,
           {amount} AS amount
    FROM lineitem l
    JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nation n ON c.c_nationkey = n.n_nationkey
    {region_join}
    {brand_filter}"""


def granular_sql(cube: Cube = Cube()) -> str:
    return f"""
    SELECT period, market, channel, client, sku,
           SUM(qty) AS baseline_qty,
           CAST(SUM(amount) AS DOUBLE) AS baseline_value
    FROM ({lines_sql(cube)}) x
    GROUP BY period, market, channel, client, sku"""


def macro_sql(cube: Cube = Cube()) -> str:
    return f"""
    SELECT CAST(period - INTERVAL 12 MONTH AS DATE) AS period, market, channel,
           SUM(qty) AS macro_target_qty,
           CAST(SUM(amount) AS DOUBLE) AS macro_target_value
    FROM ({lines_sql(cube)}) x
    GROUP BY 1, market, channel"""


def market_totals_sql(cube: Cube = Cube()) -> str:
    whole = Cube(market=cube.market, channel=cube.channel, null_market=cube.null_market)
    return f"""
    SELECT period, market, channel,
           SUM(qty) AS total_market_qty,
           CAST(SUM(amount) AS DOUBLE) AS total_market_value
    FROM ({lines_sql(whole)}) x
    GROUP BY period, market, channel"""
