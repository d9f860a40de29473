"""panelcast: entity-by-period panel analytics and next-period forecasting on Spark.

Every public operator takes and returns a ``pyspark.sql.DataFrame`` (or a
``Column`` for the expression helpers in ``panelcast.functions``).  Nothing is
collected to the driver except small metric tables and fitted model
parameters.
"""

from panelcast.spec import PanelSpec, DEFAULT_SPEC

__all__ = ["PanelSpec", "DEFAULT_SPEC"]
