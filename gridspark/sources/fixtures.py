"""Grid fixtures derived from the driver's tables.

Each builder reads a given table and aggregates it into a grid, so the work
grows with the table. The ``*_SQL`` strings compute the same grids in any
ANSI engine (they serve as oracle building blocks).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table
from ..functions.scalar import nan_to_null, nan_to_null_all

PAIR_DAILY_SQL = """
select cast(l_shipdate as date) as time, l_suppkey % 4 as x, l_partkey % 4 as y,
       avg(l_quantity) as o, avg(l_quantity * (1 + l_tax - l_discount)) as p
from lineitem group by 1, 2, 3"""

HOURLY_SQL = """
select date_trunc('hour', ts) as time, user_id % 2 as x,
       cast(floor(user_id / 2) as bigint) % 2 as y, avg(value) as v
from events group by 1, 2, 3"""

ELEVATION_SQL = """
select cast(floor(p_partkey / 50) as int) as y, cast(p_partkey % 50 as int) as x,
       p_retailprice as z
from part"""

LEVELS_SQL = """
select cast(l_shipdate as date) as time, l_suppkey % 4 as x, l_partkey % 4 as y,
       l_linenumber as level, avg(l_quantity) as v
from lineitem group by 1, 2, 3, 4"""

#: Close to one grid row for each row of the table, so it grows with the table.
GRID_WIDE_SQL = """
select cast(l_shipdate as date) as time, l_partkey % 8 as x, l_suppkey as y,
       avg(l_quantity) as o, avg(l_quantity * (1 + l_tax - l_discount)) as p
from lineitem group by 1, 2, 3"""

#: ``pair_daily`` with missing values in two thirds of the cells.
PAIR_HOLES_SQL = f"""
select time, x, y,
       case when (y + x) % 3 = 0 or (date_diff('day', date '1970-01-01', time) + y) % 97 <> 0 then o end as o,
       case when (y + x) % 3 = 0 or (date_diff('day', date '1970-01-01', time) * 7 + x) % 89 <> 0 then p end as p
from ({PAIR_DAILY_SQL}) d"""

FIXTURE_SQL = {
    "pair_daily": PAIR_DAILY_SQL,
    "grid_wide": GRID_WIDE_SQL,
    "pair_holes": PAIR_HOLES_SQL,
    "hourly": HOURLY_SQL,
    "elevation": ELEVATION_SQL,
    "levels": LEVELS_SQL,
}


def with_fixtures(sql: str, *names: str) -> str:
    """Prefix an oracle query with the fixture CTEs it uses."""
    ctes = ",\n".join(f"{n} as ({FIXTURE_SQL[n]})" for n in names)
    body = sql.lstrip()
    if body[:5].lower() == "with ":
        # merge the query's own CTE list into the fixture one
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"


def _pairs(spark: SparkSession, sf_dir: str, y: Column, x: Column) -> DataFrame:
    """Observed ``o`` and predicted ``p`` daily values of the cells (y, x)."""
    li = nan_to_null_all(table(spark, sf_dir, "lineitem").select(
        "l_shipdate", "l_suppkey", "l_partkey", "l_quantity", "l_tax", "l_discount"))
    return (li.groupBy(F.col("l_shipdate").cast("date").alias("time"), x.alias("x"), y.alias("y"))
              .agg(F.avg("l_quantity").alias("o"),
                   F.avg(F.col("l_quantity") * (1 + F.col("l_tax") - F.col("l_discount"))).alias("p")))


def pair_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs on a 4 x 4 grid."""
    return _pairs(spark, sf_dir, F.col("l_partkey") % 4, F.col("l_suppkey") % 4)


def grid_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs on a grid with a row of cells for each supplier: it grows with the table."""
    return _pairs(spark, sf_dir, F.col("l_suppkey"), F.col("l_partkey") % 8)


def pair_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pair_daily`` with missing values in two thirds of the cells."""
    day = F.unix_date("time")
    whole = (F.col("y") + F.col("x")) % 3 == 0
    return pair_daily(spark, sf_dir).withColumns({
        "o": F.when(whole | ((day + F.col("y")) % 97 != 0), F.col("o")),
        "p": F.when(whole | ((day * 7 + F.col("x")) % 89 != 0), F.col("p"))})


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly values ``v`` on a 2 x 2 grid."""
    ev = table(spark, sf_dir, "events")
    return (ev.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time"), (F.col("user_id") % 2).alias("x"),
                       (F.floor(F.col("user_id") / 2).cast("long") % 2).alias("y"))
              .agg(F.avg(nan_to_null("value")).alias("v")))


def elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A static field ``z`` on a 50-column raster."""
    pt = table(spark, sf_dir, "part")
    return pt.select(F.floor(F.col("p_partkey") / 50).cast("int").alias("y"),
                     (F.col("p_partkey") % 50).cast("int").alias("x"),
                     nan_to_null("p_retailprice").alias("z"))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long pressure-level rows ``(time, x, y, level, v)``."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.col("l_shipdate").cast("date").alias("time"),
                       (F.col("l_suppkey") % 4).alias("x"), (F.col("l_partkey") % 4).alias("y"),
                       F.col("l_linenumber").alias("level"))
              .agg(F.avg(nan_to_null("l_quantity")).alias("v")))
