"""Partition-wise refresh of a landed panel.

New rows of some periods replace those periods' partitions.  The next-period target of
older rows may change too: of the rows whose entity gains, loses or changes its next row.  Only the partitions that
hold such rows are rewritten, by dynamic partition overwrite; the others keep their files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.windows import next_period_target
from panelcast.session import ensure_checkpoint_dir
from panelcast.sources.tables import read_partitioned
from panelcast.spec import DEFAULT_SPEC, PanelSpec

c = F.col


def refresh_panel(path: str, fresh: DataFrame, spec: PanelSpec = DEFAULT_SPEC, strict: bool = False) -> list[int]:
    """Put ``fresh`` (a panel's rows for whole periods, its target not looked at) into the panel
    at ``path``, partitioned by period, and return the periods rewritten.

    (entity, period) is the key.  Entity, period, count and target are read of every partition, whole rows only
    of the rewritten ones.  A period without a single fresh row is not touched: an
    empty one has to be removed by its owner.  A panel that is not there yet raises.
    """
    spark = fresh.sparkSession
    ensure_checkpoint_dir(spark)
    key, p = [spec.entity, spec.period], c(spec.period)
    fresh = fresh.drop(spec.target).checkpoint(eager=True)
    changed = [r[0] for r in fresh.select(spec.period).distinct().collect()]        # periods, not rows
    if not changed:
        return []
    stored = read_partitioned(spark, path, spec.period)
    narrow = stored.select(*key, spec.count, c(spec.target).alias("_old"))
    kept = narrow.filter(~p.isin(changed)).withColumn("_kept", F.lit(True)).unionByName(
        fresh.select(*key, spec.count, F.lit(None).cast("double").alias("_old"), F.lit(False).alias("_kept")))
    # only entities with a row in a changed period, before or now, can have another target
    touched = narrow.filter(p.isin(changed)).select(spec.entity).unionByName(fresh.select(spec.entity)).distinct()
    targets = next_period_target(kept.join(touched, spec.entity, "left_semi"), spec, strict=strict, name="_new")
    targets = targets.select(*key, "_old", "_new", "_kept").checkpoint(eager=True)
    moved = targets.filter(c("_kept") & ~c("_old").eqNullSafe(c("_new")))
    older = [r[0] for r in moved.select(spec.period).distinct().collect()]
    new_target = targets.select(*key, c("_new"), F.lit(True).alias("_known"))
    parts = fresh.withColumn("_stored", F.lit(None).cast("double"))
    if older:
        rows = read_partitioned(spark, path, spec.period, older).withColumnRenamed(spec.target, "_stored")
        parts = parts.unionByName(rows.select(*parts.columns))
    out = parts.join(new_target, key, "left").withColumn(
        spec.target, F.when(c("_known"), c("_new")).otherwise(c("_stored"))).select(*stored.columns)
    # read from the table that it goes to: settle it first
    out.checkpoint(eager=True).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy(spec.period).parquet(path)
    return sorted([*changed, *older])
