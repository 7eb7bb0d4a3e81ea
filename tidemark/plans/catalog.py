"""Registered queries of the engine and their SQL. Names of operators are in README.md."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import acoustic, archive, trials

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {**trials.QUERIES, **archive.QUERIES, **acoustic.QUERIES}
ORACLES: dict[str, str] = {**trials.ORACLES, **archive.ORACLES, **acoustic.ORACLES}
