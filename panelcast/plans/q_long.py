"""Long careers: a handful of entities that hold all rows, scanned in pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.prefix_scan import long_career_features
from panelcast.plans.registry import query
from panelcast.sources.tables import read_table
from panelcast.spec import PanelSpec

c = F.col
# five priorities, each with a fifth of all orders; missing order keys are gaps
SPEC = PanelSpec(entity="o_orderpriority", period="o_orderkey", exposure="price", count="price", rate="price")

LONG_SQL = """
WITH o AS (SELECT o_orderpriority, o_orderkey, CAST(o_totalprice AS DOUBLE) / 1000 AS price FROM orders),
w0 AS (
  SELECT o_orderpriority, o_orderkey, price,
         lag(o_orderkey) OVER w AS prev, lag(price) OVER w AS prev_total_k,
         row_number() OVER w AS rn, min(o_orderkey) OVER r AS first_key,
         max(price) OVER r AS high, stddev_pop(price) OVER r AS sd,
         avg(price) OVER t AS avg3, stddev_samp(price) OVER t AS sd3
  FROM o
  WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey),
         r AS (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         t AS (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
w1 AS (SELECT *, prev IS NOT NULL AND o_orderkey - prev <> 1 AS brk FROM w0),
w2 AS (SELECT *, max(CASE WHEN prev IS NULL OR brk THEN rn END) OVER r AS start, max(CASE WHEN brk THEN prev END) OVER r AS broken
       FROM w1 WINDOW r AS (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT o_orderpriority, o_orderkey, prev_total_k, high AS career_high_k, high AS career_high_k9, avg3 AS k9_3yr_avg, sd3 AS k9_rolling_std,
       rn AS years_experience, CAST(COALESCE(o_orderkey - prev > 1, false) AS INTEGER) AS missed_previous_season,
       rn - start + 1 AS consecutive_active_years, COALESCE(o_orderkey - broken - 1, 99) AS years_since_injury,
       round(CASE WHEN o_orderkey > first_key THEN rn / (o_orderkey - first_key + 1) ELSE 1.0 END, 6) AS career_availability_rate,
       CASE WHEN rn >= 3 THEN sd ELSE 0.0 END AS ip_volatility,
       CAST(COALESCE(o_orderkey - prev > 1, false) AS INTEGER) AS coming_back_from_injury
FROM w2"""


@query("long_careers", "W2 W7-W11 W14-W18", LONG_SQL)
def long_careers_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Career measures of every order within its priority, whose orders lie in several tasks."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", (c("o_totalprice").cast("double") / 1000).alias("price"))
    return long_career_features(orders, SPEC).drop("price")
