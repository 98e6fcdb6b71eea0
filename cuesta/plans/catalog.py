"""The registry of this engine's queries: name, DataFrame plan and, where SQL can express it, the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuesta.plans import attitudes, detection, directions, further, oracles, rasters, scenes, scoring, sources, terrain
from cuesta.plans.fixtures import oracle

Query = Callable[[SparkSession, str], DataFrame]

_ALL: dict[str, tuple[Query, str | None]] = {}
for _module in (terrain, rasters, attitudes, directions, scenes, scoring, detection, sources, further):
    _ALL |= _module.QUERIES

#: SQL of kernels whose queries stand in modules that the SQL itself builds on.
for _name, _sql in {"a5_simplified": oracles.A5_SIMPLIFIED, "c4_thinning": oracles.C4_THINNING, "e1_gradient": oracles.E1_GRADIENT, "e5_tensor": oracles.E5_TENSOR, "h4_filled": oracles.H4_FILLED, "l11_least_cost": oracles.L11_LEAST_COST, "x7_great_circles": oracles.X7_GREAT_CIRCLES, "x12_fabrics": oracles.fabrics(directions._UNITS), "x13_fold_axes": oracles.fold_axes("id % 7 = 0", 6), "x14_fold_axes": oracles.fold_axes()}.items():
    _ALL[_name] = (_ALL[_name][0], _sql)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attitudes.attitudes(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: oracle(sql) for name, (_, sql) in _ALL.items() if sql is not None}
