"""Ingest and output queries (S1-S4, J7, P7, P8, P10): yearly sources are
landed in the shared folder, read back with an explicit schema, tagged and
combined; the panel's outputs are written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.filters import lookup, require_rows
from panelcast.plans import oracle_base as ob
from panelcast.plans.panel import prepare_panel, season_panel
from panelcast.plans.registry import query
from panelcast.session import ensure_checkpoint_dir
from panelcast.sources.contract import ingest, require
from panelcast.sources.refresh import refresh_panel
from panelcast.sources.sinks import write_panel_outputs, write_table
from panelcast.sources.standin import raw_season_table
from panelcast.sources.tables import read_csv, read_partitioned, union_periods
from panelcast.spec import DEFAULT_SPEC

c = F.col
SPEC = DEFAULT_SPEC
KEY = ["player_id", "season"]
REQUIRED = ["player_id", "full_name", "total_innings_pitched", "total_strikeouts", "k_per_9"]
MAX_SOURCES = 200       # yearly sources, not data


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ingest_sources(spark: SparkSession, sources: dict[int, tuple[str, T.StructType]]) -> DataFrame:
    """Yearly CSV files, each with its own schema, as one raw table: the contract's names and
    defaults are applied to each, so a source without an optional column gets its default, then
    they are tagged with their year and put together by name."""
    frames = [(year, require(ingest(read_csv(spark, path, schema)), REQUIRED)) for year, (path, schema) in sources.items()]
    return union_periods(frames, SPEC.period)


@query("yearly_ingest", "S1 S3 J7 P7 P8", ob.panel_query("""
SELECT player_id, season, total_strikeouts, k_per_9, next_season_strikeouts,
       CASE WHEN season % 2 = 1 THEN 'N/A' ELSE team END AS team
FROM panel""", keep=("team",)))
def yearly_ingest_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One CSV per year, those of odd years without the optional GS and Team columns,
    read back and built into the panel."""
    raw = raw_season_table(spark, sf_dir).checkpoint(eager=True)
    years = [r[0] for r in raw.select("Season").distinct().limit(MAX_SOURCES + 1).collect()]
    if len(years) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} yearly sources")
    top, sources = _folder(spark, "yearly"), {}
    for year in sorted(years):
        one = raw.where(c("Season") == year).drop("Season", *(("GS", "Team") if year % 2 else ()))
        write_table(one, f"{top}/{year}", fmt="csv")
        sources[int(year)] = (f"{top}/{year}", one.schema)
    panel = prepare_panel(ingest_sources(spark, sources), SPEC)
    return panel.select(*KEY, "total_strikeouts", "k_per_9", SPEC.target, "team")


@query("panel_outputs", "S2 S4", ob.panel_query("""
SELECT season, count(*) AS n_full, count(next_season_strikeouts) AS n_train,
       sum(total_strikeouts) AS strikeouts, coalesce(sum(next_season_strikeouts), 0) AS target_sum
FROM panel GROUP BY season"""))
def panel_outputs_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full and the training output, written partitioned by season and read back."""
    top = _folder(spark, "outputs")
    write_panel_outputs(season_panel(spark, sf_dir), f"{top}/full", f"{top}/train", SPEC.target, SPEC.period)
    full, train = spark.read.parquet(f"{top}/full"), spark.read.parquet(f"{top}/train")
    left = full.groupBy("season").agg(F.count(F.lit(1)).alias("n_full"), F.sum("total_strikeouts").alias("strikeouts"))
    right = train.groupBy("season").agg(F.count(F.lit(1)).alias("n_train"), F.sum(SPEC.target).alias("target_sum"))
    return left.join(right, "season", "left").select(
        "season", "n_full", F.coalesce("n_train", F.lit(0)).alias("n_train"), "strikeouts",
        F.coalesce("target_sum", F.lit(0)).alias("target_sum"))


@query("first_entity_seasons", "P10", ob.panel_query("""
SELECT player_id, season, total_strikeouts FROM panel
WHERE player_id = (SELECT min(player_id) FROM panel)
  AND season = (SELECT max(season) FROM panel WHERE player_id = (SELECT min(player_id) FROM panel))"""))
def first_entity_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point lookup of the first entity's latest season; an empty result raises."""
    panel = season_panel(spark, sf_dir)
    first = panel.agg(F.min(F.struct("player_id", -c("season"))).alias("k")).first()["k"]
    return require_rows(lookup(panel, first[0], -first[1], SPEC), "seasons").select(*KEY, "total_strikeouts")


@query("panel_refresh", "S2 S3 S4 W1", ob.panel_query("""
SELECT player_id, season, total_strikeouts, k_per_9, workload_stress, next_season_strikeouts FROM panel"""))
def panel_refresh_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel landed without its latest season, then refreshed with it: the same as built whole."""
    raw = raw_season_table(spark, sf_dir).checkpoint(eager=True)
    latest, path = raw.agg(F.max("Season")).first()[0], f"{_folder(spark, 'refresh')}/panel"
    write_table(prepare_panel(raw.where(c("Season") < latest), SPEC), path, partition_by=[SPEC.period])
    refresh_panel(path, prepare_panel(raw.where(c("Season") == latest), SPEC), SPEC)
    return read_partitioned(spark, path, SPEC.period).select(*KEY, "total_strikeouts", "k_per_9", "workload_stress", SPEC.target)
