"""Writers (S2, S4-S6).

Outputs are written by Spark tasks in parallel (never collected); the panel
is partitioned by period so later period filters prune directories.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                mode: str = "overwrite") -> None:
    """Write a table (Parquet by default, CSV with a header on request)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_panel_outputs(panel: DataFrame, full_path: str, train_path: str, target: str,
                        period: str = "season") -> None:
    """The full panel and its labelled subset from one run.

    The full panel is written once; the training output is then read back from
    those files (filter pushed into the scan) instead of recomputing the plan.
    """
    write_table(panel, full_path, partition_by=[period])
    full = panel.sparkSession.read.parquet(full_path)
    write_table(full.filter(F.col(target).isNotNull()), train_path, partition_by=[period])


def write_list(df: DataFrame, column: str, path: str) -> None:
    """A one-column list (e.g. selected features) as a headed CSV."""
    write_table(df.select(column), path, fmt="csv")
