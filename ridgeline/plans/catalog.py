"""Every query of the ride engine by name, and SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import increments, journeys, panels, places, rides

PARTS = (rides, places, panels, increments, journeys)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for part in PARTS for k, f in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for part in PARTS for k, s in part.ORACLE_SQL.items()}
