"""Panel build (query lifecycle A): source -> contract -> exposure filter ->
constant fills -> scalar features -> next-period target.

The only shuffles are the source aggregation and one exchange by entity that
every career window afterwards reuses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.features import scalar_features
from panelcast.operators.filters import min_exposure as min_exposure_filter
from panelcast.operators.impute import fill_constants
from panelcast.operators.windows import next_period_target
from panelcast.sources.contract import ingest
from panelcast.sources.standin import raw_season_table
from panelcast.spec import DEFAULT_SPEC, LEAGUE_AVERAGE_FILL, MIN_EXPOSURE, MIN_EXPOSURE_EXTENDED, PanelSpec


def prepare_panel(raw: DataFrame, spec: PanelSpec = DEFAULT_SPEC, min_exposure: float = MIN_EXPOSURE,
                  variant: str = "current", strict_target: bool = False) -> DataFrame:
    """Any raw season-stat frame -> model-ready panel (all periods, target may be NULL)."""
    df = ingest(raw)
    df = min_exposure_filter(df, spec, min_exposure)
    if variant == "current":
        df = fill_constants(df, LEAGUE_AVERAGE_FILL)
    df = scalar_features(df, variant)
    return next_period_target(df, spec, strict=strict_target)


def season_panel(spark: SparkSession, sf_dir: str, spec: PanelSpec = DEFAULT_SPEC,
                 variant: str = "current", min_exposure: float | None = None,
                 strict_target: bool = False) -> DataFrame:
    if min_exposure is None:
        min_exposure = MIN_EXPOSURE if variant == "current" else MIN_EXPOSURE_EXTENDED
    return prepare_panel(raw_season_table(spark, sf_dir), spec, min_exposure, variant, strict_target)


def training_rows(panel: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Rows whose next period is known."""
    return panel.filter(F.col(spec.target).isNotNull())
