"""Stand-in inputs built from the driver's TPC-H-style tables.

These functions only shape the given tables into the schemas the forecasting
job consumes (a raw season-stat table, a pitch-share side table and a game
log).  They do none of the job's work: renaming, filtering, features,
windows, joins and models all happen downstream in the library.

Mapping (entity = customer, period = order year), scaled so that the
reference's thresholds (K/9 tiers, 150/180 innings, 200 strikeouts, the
starter rule) split the data instead of being constant:
  Name/Team        c_name / c_mktsegment
  IP (exposure)    sum(l_quantity)
  SO               floor(1.5 x quantity of R lines + quantity of A lines)
  BB               floor(sum(l_quantity) of lines with flag N / 2)
  G / GS           6 x line items / 12 x orders with status F
  Pitches          floor(sum(l_extendedprice) / 100)
  Age              20 + custkey % 20 + year - 1995
  Stuff+/Location+ season-varying ratings, NULL for some customers
  rate and share columns are ratios of line-item counts and averages.

Plan note: line items are first aggregated per order (a map-side partial
aggregate on the scan's natural order-key clustering), so the join with
``orders`` sees one row per order instead of ~4 line items; the second
aggregation then runs on the much smaller per-order rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.sources.tables import read_table

c = F.col


def _cnt(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def _per_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", [
        "l_orderkey", "l_quantity", "l_returnflag", "l_linestatus",
        "l_discount", "l_tax", "l_extendedprice", "l_linenumber",
    ])
    return li.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("qty"),
        F.coalesce(F.sum(F.when(c("l_returnflag") == "R", c("l_quantity"))), F.lit(0.0)).alias("qty_r"),
        F.coalesce(F.sum(F.when(c("l_returnflag") == "A", c("l_quantity"))), F.lit(0.0)).alias("qty_a"),
        F.coalesce(F.sum(F.when(c("l_returnflag") == "N", c("l_quantity"))), F.lit(0.0)).alias("qty_n"),
        F.count(F.lit(1)).alias("n"),
        _cnt(c("l_returnflag") == "R").alias("n_r"),
        _cnt(c("l_returnflag") == "A").alias("n_a"),
        _cnt(c("l_returnflag") == "N").alias("n_n"),
        _cnt(c("l_linestatus") == "O").alias("n_o"),
        _cnt(c("l_discount") >= 0.09).alias("n_hr"),
        _cnt(c("l_discount") > 0.05).alias("n_brl"),
        _cnt(c("l_linenumber") == 1).alias("n_l1"),
        # two-decimal money/rate columns are summed as decimals: exact, so the
        # result does not depend on summation order
        F.sum(c("l_tax").cast("decimal(12,2)")).alias("s_tax"),
        F.sum(c("l_discount").cast("decimal(12,2)")).alias("s_disc"),
        F.sum(c("l_extendedprice").cast("decimal(12,2)")).alias("s_price"),
        F.sum("l_linenumber").alias("s_line"),
    )


def raw_season_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (customer, order year) with the raw season-stat headers."""
    per_order = _per_order_lines(spark, sf_dir)
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"])
    joined = orders.join(per_order, orders.o_orderkey == per_order.l_orderkey, "inner")
    yr = F.year("o_orderdate").cast("int")
    agg = joined.groupBy(c("o_custkey").alias("player_id"), yr.alias("Season")).agg(
        (F.sum("n") * 6).cast("int").alias("G"),
        (_cnt(c("o_orderstatus") == "F") * 12).cast("int").alias("GS"),
        F.sum("qty").cast("double").alias("IP"),
        F.floor(F.sum("qty_r") * 1.5 + F.sum("qty_a")).cast("int").alias("SO"),
        F.floor(F.sum("qty_n") / 2).cast("int").alias("BB"),
        F.sum("n").cast("int").alias("_n"),
        F.sum("n_r").alias("_n_r"),
        F.sum("n_a").alias("_n_a"), F.sum("n_n").alias("_n_n"), F.sum("n_o").alias("_n_o"), F.sum("n_hr").alias("_n_hr"),
        F.sum("n_brl").alias("_n_brl"), F.sum("n_l1").alias("_n_l1"),
        F.sum("s_tax").cast("double").alias("_s_tax"), F.sum("s_disc").cast("double").alias("_s_disc"),
        F.sum("s_price").cast("double").alias("_s_price"), F.sum("s_line").alias("_s_line"),
    )
    n = c("_n").cast("double")
    ip = c("IP")
    pid = c("player_id")
    stats = agg.select(
        "player_id", "Season", "G", "GS", "IP", "SO", "BB",
        F.floor(c("_s_price") / 100).cast("int").alias("Pitches"),
        (F.lit(20) + pid % 20 + c("Season") - 1995).cast("int").alias("Age"),
        (c("SO") * 9.0 / ip).alias("K/9"),
        (c("BB") * 9.0 / ip).alias("BB/9"),
        (c("_n_hr") * 9.0 / ip).alias("HR/9"),
        (c("_n_n") * 9.0 / ip).alias("H/9"),
        F.when(c("BB") != 0, c("SO") / c("BB").cast("double")).alias("K/BB"),
        (c("SO") * 100.0 / F.floor(c("_s_price") / 100)).alias("K%"),
        (c("_s_tax") / n * 100.0).alias("ERA"),
        ((c("SO") + c("BB")) / ip).alias("WHIP"),
        (c("_s_disc") / n * 100.0).alias("FIP"),
        ((c("_s_tax") + c("_s_disc")) / n * 50.0).alias("xFIP"),
        (c("_s_price") / n / 10000.0).alias("SIERA"),
        (c("_n_r") * 100.0 / n).alias("SwStr%"),
        ((c("_n_r") + c("_n_a")) * 100.0 / n).alias("CSW%"),
        (100.0 - c("_n_r") * 100.0 / n).alias("Contact%"),
        (c("_n_o") * 100.0 / n).alias("O-Swing%"),
        (100.0 - c("_n_o") * 100.0 / n).alias("Z-Swing%"),
        (c("_s_line") / n * 10.0).alias("Zone%"),
        (c("_n_l1") * 100.0 / n).alias("F-Strike%"),
        (c("_n_a") * 100.0 / n).alias("Hard%"),
        (c("_n_brl") * 100.0 / n).alias("Barrel%"),
        (c("_n_n") / n).alias("AVG"),
        (ip / n * 2.0).alias("LOB%"),
        F.when(pid % 7 != 0, (80 + (pid + 3 * c("Season")) % 41).cast("double")).alias("Stuff+"),
        F.when(pid % 11 != 0, (85 + (pid + 5 * c("Season")) % 31).cast("double")).alias("Location+"),
    )
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_mktsegment"])
    return stats.join(cust, stats.player_id == cust.c_custkey, "left").select(
        "player_id", c("c_name").alias("Name"), c("c_mktsegment").alias("Team"),
        *[x for x in stats.columns if x != "player_id"],
    )


def pitch_share_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side table keyed by (display name, season) with six type shares.

    Shares are line-item shares by line number 1..6 within (customer, ship
    year); a type never seen is NULL, and line 7 is left out, so shares need
    renormalising.  Names are spelt differently from the season table (upper
    case, trailing '.', leading blank), as in a second data vendor.
    """
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_shipdate"])
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    j = li.join(orders, li.l_orderkey == orders.o_orderkey, "inner")
    yr = F.year("l_shipdate").cast("int")
    shares = {}
    for k, name in enumerate(["FB%", "SL%", "CT%", "CB%", "CH%", "SF%"], start=1):
        cnt = _cnt(c("l_linenumber") == k)
        shares[name] = F.when(cnt > 0, cnt / F.count(F.lit(1)))
    agg = j.groupBy(c("o_custkey").alias("cust"), yr.alias("Season")).agg(
        *[v.alias(k) for k, v in shares.items()])
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name"])
    return agg.join(cust, agg.cust == cust.c_custkey, "inner").select(
        F.concat(F.lit(" "), F.upper("c_name"), F.lit(".")).alias("Name"), "Season",
        *shares.keys())


def game_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Game-log stand-in: one row per line item, ``season`` = ship year."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_shipdate"])
    return li.select(F.year("l_shipdate").cast("int").alias("season"), "l_orderkey")
