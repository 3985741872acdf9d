"""Query name -> callable and DuckDB twin, gathered from the operator modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import alpha, animation, codec, container, entropy, lossy, pixels, predictors, spatial
from tessera.plans.dialect import duck_twin, for_duckdb, for_spark
from tessera.sources import containers, raster, tokens  # noqa: F401  registers the base relations

PLANS: dict[str, str] = {**pixels.PLANS, **predictors.PLANS, **entropy.PLANS, **spatial.PLANS, **alpha.PLANS, **container.PLANS, **animation.PLANS, **lossy.PLANS}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: for_spark(sql) for name, sql in PLANS.items()} | codec.QUERIES
#: Twins over base relations that are DuckDB text already and share nothing with the plan.
OWN_TWINS: dict[str, tuple[str, str]] = {name: (sql, "chunks") for name, sql in container.TWINS.items()} | {"le11_optimise_colour_transform": (pixels.OPTIMISED.replace("CROSS JOIN multipliers", "CROSS JOIN (SELECT unnest(range(-128, 128)) AS m) v"), "px"), "le12_palette_order": (pixels.PALETTES, "px")}
ORACLE_SQL: dict[str, str] = {name: for_duckdb(sql) for name, sql in {**PLANS, **codec.TWINS}.items()} | {name: duck_twin(sql, relation) for name, (sql, relation) in OWN_TWINS.items()}
FLAGSHIP = "color_cache_hits"
