"""Registry of the library's own queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenmesh.plans import bake_queries, mesh_queries, scene_queries, stream_queries, table_queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of surface points, blended from the views that show them."""
    return bake_queries.queries()["bake_texels"](spark, sf_dir)


def queries() -> dict:
    return mesh_queries.queries() | table_queries.queries() | scene_queries.queries() | scene_queries.MORE | bake_queries.queries() | stream_queries.queries()


def oracle_sql() -> dict:
    return mesh_queries.oracle_sql() | table_queries.oracle_sql() | scene_queries.oracle_sql() | scene_queries.MORE_SQL | bake_queries.oracle_sql() | stream_queries.oracle_sql()
