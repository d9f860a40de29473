"""Global ordering operators: unique 1..N rank (W21), sort (T1), top-k.

``row_number() OVER (ORDER BY score)`` has no partition key, so Spark runs it
in a single task.  ``global_rank`` instead

1. range-partitions by (score, tie...) -- ties go through the tie columns, so
   even a score shared by a third of all rows is spread over many partitions;
2. numbers rows inside each sorted partition (``monotonically_increasing_id``
   encodes partition id and in-partition position);
3. sums partition sizes into offsets: a table with one row per partition,
   i.e. its size is bounded by the partition count, broadcast back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.session import ensure_checkpoint_dir

c = F.col

_POS_BITS = 33  # monotonically_increasing_id = partition_id << 33 | position


def _order(score: str, tie: Sequence[str], descending: bool) -> list[Column]:
    first = c(score).desc_nulls_last() if descending else c(score).asc_nulls_last()
    return [first, *[c(t).asc_nulls_last() for t in tie]]


def global_rank(df: DataFrame, score: str, tie: Sequence[str], name: str = "rank",
                descending: bool = True, partitions: int | None = None) -> DataFrame:
    """Unique 1..N rank over the whole frame, ordered by ``score`` then ``tie``
    (``tie`` should make the order total).

    The numbered frame is used twice (partition sizes and the final join), so
    it is materialised once with a reliable checkpoint in the cluster's
    checkpoint folder; a recomputed shuffle can then never renumber rows.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    order = _order(score, tie, descending)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    tagged = ranged.withColumn("_mid", F.monotonically_increasing_id()).checkpoint(eager=True)
    tagged = tagged.withColumn("_part", F.shiftright(c("_mid"), _POS_BITS))
    tagged = tagged.withColumn("_pos", c("_mid") - F.shiftleft(c("_part"), _POS_BITS))
    # one row per partition: the offset table is bounded by the partition count
    sizes = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(w), F.lit(0)).alias("_offset"))
    out = tagged.join(F.broadcast(offsets), "_part")
    return out.withColumn(name, (c("_offset") + c("_pos") + 1).cast("long")).drop("_mid", "_part", "_pos", "_offset")


def sort_by_score(df: DataFrame, score: str, tie: Sequence[str], descending: bool = True) -> DataFrame:
    """Total order with the key as tie-break (range-partitioned sort)."""
    return df.orderBy(*_order(score, tie, descending))


def top_k(df: DataFrame, score: str, k: int, tie: Sequence[str], descending: bool = True) -> DataFrame:
    """First k rows by score (TakeOrderedAndProject: k rows per task)."""
    return df.orderBy(*_order(score, tie, descending)).limit(k)


def best_by(df: DataFrame, metric: str, lowest: bool = True, tie: Sequence[str] = ()) -> DataFrame:
    """T4: the single best row of a small metrics table."""
    return top_k(df, metric, 1, tie, descending=not lowest)
